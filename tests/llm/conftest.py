import random

import pytest

SYLLABLES = "ba de fi go ku la me no pi ra su ti vo wen xar".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, repeated lines, blanks, one very long text, one without words."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += [texts[3], texts[3] + "\n", " " + texts[3].replace(" ", "\t"), texts[4].upper()]
    base = sentence(rng, 300)
    texts += [base, base.replace(" ", "  ", 5), " ".join(base.split()[:-1]), base + " ba"]
    shared = "this line is repeated often"
    texts += [f"{sentence(rng, 8)}\n{shared}\n{sentence(rng, 5)}", f"  {shared.upper()} \t\n{sentence(rng, 4)}", f"{shared}\n{shared}"]
    texts += ["", " \n\t ", None, None, sentence(rng, 30_000), "…　é́ ß\n\n", "\\### Assistant: </turn>"]
    return list(enumerate(texts))


#: Columns whose names operators use inside; they must neither be read nor cause a clash.
CLASHING = "id key hash hashes sha fp leaf home rank part ids words label n_words group component word same n found".split()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    return frame.select("*", *[F.lit(None).cast("string").alias(c) if i % 2 else F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id < -1")


@pytest.fixture(scope="session")
def odd(spark):
    """Missing ids and repeated rows."""
    rows = [(None, "alpha beta gamma delta"), (None, None), (5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "another text here now"), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")
