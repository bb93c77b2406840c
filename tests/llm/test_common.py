import pytest
from pyspark.sql import functions as F

from marlstone.llm import common


def test_samples_by_hash(spark):
    df = spark.range(20_000).repartition(13)
    a, b = (sorted(r["id"] for r in common.sample_by_hash(x, 500, [F.col("id")], 20_000).collect()) for x in (df, df.repartition(3)))
    assert a == b and len(a) == 500
    assert common.sample_by_hash(df, 30_000, [F.col("id")], 20_000).count() == 20_000
    # what reaches one place is near the sample, whatever the number of partitions
    plan = common.sample_by_hash(df, 500, [F.col("id")], 20_000)
    assert df.withColumn("_h", F.xxhash64("id")).filter(F.col("_h") < int((1.5 * 500 / 20_000 - 0.5) * 2**64)).count() < 900 and plan.count() == 500


def test_dropped_tables_are_gone(spark):
    t = common.settle(spark.range(5), "t")
    assert t.count() == 5
    common.drop(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|NOT_EXIST"):
        t.count()
