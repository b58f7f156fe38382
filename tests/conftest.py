import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Make every ordered operator take its range-split way."""
    from tallyline.session import CHUNK_ROWS, MAX_GROUP_ROWS
    spark.conf.set(MAX_GROUP_ROWS, "20")
    spark.conf.set(CHUNK_ROWS, "37")
    yield
    spark.conf.unset(MAX_GROUP_ROWS)
    spark.conf.unset(CHUNK_ROWS)


def rows(df, *order):
    """Rows as dicts, sorted."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda d: tuple((d[o] is None, d[o]) for o in order))
