"""Medians of overlapping groups by bisection over counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.functions.selection import group_medians


def folds_of(day):
    """Fold k holds days 5k to 5k + 19; so a day is in up to four folds."""
    low, high = F.greatest(F.ceil((F.col(day) - 19) / 5), F.lit(0)).cast("int"), F.floor(F.col(day) / 5).cast("int")
    return F.explode(F.sequence(low, high))


@pytest.mark.parametrize("bins", [2, 1024])
def test_medians_of_folds(spark, bins):
    rng = np.random.default_rng(8)
    n = 1500
    d = pd.DataFrame({
        "day": rng.integers(0, 60, n), "normal": rng.normal(size=n), "few": rng.integers(-2, 3, n).astype(float), "one": 7.25,
        "wide": np.sign(rng.normal(size=n)) * np.exp(rng.normal(size=n) * 60), "close": 1.0 + rng.integers(0, 50, n) * 2.0**-52})
    d.loc[::3, "normal"] = None
    d["none"] = None
    frame = spark.createDataFrame(d.astype(object).where(d.notna(), None), "day int, normal double, few double, one double, wide double, close double, none double").repartition(3)
    features, dealt = ["normal", "few", "one", "wide", "close", "none"], []

    def place(counts):
        dealt.append(counts.count())
        return counts.withColumn("fold", folds_of("day")).drop("day")

    got = group_medians(frame, ["day"], features, place, bins)
    want = {}
    for k in range(12):
        part = d[(d.day >= 5 * k) & (d.day <= 5 * k + 19)]
        want |= {(k, f): float(np.median(part[f].dropna().astype(float))) for f in features if part[f].notna().any()}
    assert got == want
    # Counts by day, never a row for each fold: four times the rows would be dealt otherwise.
    assert max(dealt) <= 5 * n


def test_no_groups_and_no_rows(spark):
    rows = spark.createDataFrame([(3.0,), (1.0,), (None,), (2.0,), (9.0,)], "x double")
    assert group_medians(rows, [], ["x"], lambda c: c.withColumn("fold", F.lit(0))) == {(0, "x"): 2.5}
    assert group_medians(rows.filter("x > 99"), [], ["x"], lambda c: c.withColumn("fold", F.lit(0))) == {}


def test_no_exchange_of_rows_by_fold(spark, monkeypatch):
    """Every table that the backtest deals to folds for its medians holds counts by day."""
    from datetime import date, timedelta

    from tallyline.operators import folds
    seen = []

    def watched(rows, by, features, place):
        def spy(counts):
            seen.append((counts.count(), counts.columns))
            plan = place(counts)._jdf.queryExecution().executedPlan().toString()
            assert plan.index("HashAggregate") < plan.index("unpivot" if "unpivot" in plan else "Expand")
            return place(counts)
        return group_medians(rows, by, features, spy)

    monkeypatch.setattr(folds, "group_medians", watched)
    rng = np.random.default_rng(1)
    n, names = 2000, [f"x{i}" for i in range(5)]
    rows = [(i, date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 200))), int(rng.random() < .4), 2.0, 1.0, *map(float, rng.integers(0, 6, 5))) for i in range(n)]
    df = spark.createDataFrame(rows, "builder_id int, game_date date, builder_hit int, decimal_odds double, stake double, " + ", ".join(f"{x} double" for x in names))
    results, _ = folds.run_backtest(df, folds.FoldConfig(30, 7, 50), names, kind="expanding")
    assert results.count() > 20
    # 200 days x 5 features x 6 values at most, where rows x folds x features would be some 120,000.
    assert seen and all(count <= 200 * 5 * 6 and "game_date" in columns for count, columns in seen)
