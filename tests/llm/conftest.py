import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = "the cat sat on mat while rain fell over quiet town and bells rang slow under grey light of winter morning when birds left".split()


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or [1, 2, 3])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, copies up to white space, ties, a long text, and characters beyond ASCII."""
    long = prose(20_000, 9)
    return [None, "", " \n\t", "a", "A", "a  b", "a b", "a\nb", "a b", "é \U0001f600 ß", long, long, prose(50, 1), prose(50, 1), prose(60, 2), "the same line " * 40, None, "x" * 5000]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Odd rows, one of them repeated, one without an id, and extra columns whose names operators use inside."""
    df = frame(spark, odd_texts)
    df = df.union(df.filter("doc_id = 12")).union(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    for extra in ("digest", "row", "rank", "size", "fp", "shard", "_k", "_key", "score", "length", "s", "n"):
        df = df.withColumn(extra, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
