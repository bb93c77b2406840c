"""What the operators of this folder share: shared storage, ranks that no hot key can hold up, and input checks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.sources import files

#: Words are what stands between these characters (space and the ASCII controls 9 to 13).
SPACE_CLASS = r"\x20\x09-\x0D"

_settled: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, a local one of a local master."""
    return files.shared_root(spark)


@atexit.register
def _sweep() -> None:
    """Deletes what is still settled when the driver ends; a session that is gone already is left alone."""
    for path, spark in _settled.items():
        if spark.sparkContext._jsc is not None:
            files.remove(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads it back.

    That cuts the lineage, so a lost executor costs no earlier stage, and later passes read columns that
    they need from Parquet. Each call has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(settled: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    path = settled._settled
    files.remove(_settled.pop(path), path)


def sample_by_hash(rows: DataFrame, most: int, keys: list[Column], count: int) -> DataFrame:
    """At most ``most`` of ``count`` rows: those whose keys have the smallest hashes, so reruns agree.

    A threshold on the hash, from the count, leaves little more than the sample: what meets in one place is bounded by it,
    not by the number of partitions. Where many rows have one key the sample may be smaller.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*keys))
    if count > 2 * most:
        hashed = hashed.filter(F.col("_h") < F.lit(int((1.5 * most / count - 0.5) * 2**64)))
    order = [F.col("_h"), *keys]
    return hashed.orderBy(*order).limit(most).drop("_h")


def row_hash(rows: DataFrame) -> Column:
    """A hash over all columns: rows that share it can't be told apart."""
    one = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[one(f) for f in rows.schema])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra or clashing ones can't reach a join."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of a text as long; null counts none."""
    return F.regexp_count(text_or_empty(column), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def spread_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", parts: int = 256) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``keys``, without gathering a key's rows in one task.

    Rows of a key are dealt over ``parts`` by a hash of ``order``, ranked within their part, and shifted by
    the counts of the parts before. A key that holds a third of the table is thus ranked by many tasks.
    The order is that of (hash part, ``order``): fixed by the rows' values, not sorted by ``order`` alone.
    ``df`` is read twice; pass a settled table. Null keys are keys like any other.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1)
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranked.join(shift, on)
    return joined.withColumn(out, (F.col("_shift") + F.col("_within")).cast("long")).select(*df.columns, out)


def keep_keyed(documents: DataFrame, key: Column, kept: DataFrame, copies: bool = False) -> DataFrame:
    """The documents whose ``key`` (a string) is in ``kept`` (k, and n where ``copies``), one for each key, n times.

    All columns travel as one struct, so their names can't clash with the join's. Of the rows of one key one stands for
    all. The join deals the rows by the key, which the last step uses again.
    """
    packed = documents.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    once = packed.join(kept, F.col("key") == F.col("k")).dropDuplicates(["key"])
    if copies:
        once = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return once.select("doc.*")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def partitions_for(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """How many shards of about ``each`` rows a table needs; the count follows the table."""
    return max(least, -(-rows // each))
