"""Dense numbers in the order of columns, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range; bits that Spark's increasing ids leave to the place within a partition.
RANGE_ROWS, PLACE_BITS = 1_000_000, 33


def number_in_order(rows: DataFrame, order: list[str], path: str, count: int, first: int, out: str = "seq", each: int = RANGE_ROWS) -> DataFrame:
    """The ``count`` rows with ``out`` running from ``first`` in the order of columns.

    Up to ``each`` rows are numbered by one task. More are dealt over ranges, staged at ``path`` (which the caller
    removes once the result is written), counted there and shifted: what is collected and sent has a row a range.
    """
    parts = -(-count // each)
    if parts <= 1:
        return rows.repartition(1).sortWithinPartitions(*order).withColumn(out, F.lit(first) + F.monotonically_increasing_id())
    stage_in_order(rows, order, path, parts)
    return numbered(rows.sparkSession.read.parquet(path), first, out)


def stage_in_order(rows: DataFrame, order: list[str], path: str, parts: int) -> None:
    """Writes the rows in ranges of ``order``, each sorted, with their place ``_at`` (partition and index)."""
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)


def numbered(staged: DataFrame, first: int, out: str = "seq") -> DataFrame:
    """Staged rows with ``out`` running from ``first`` without gaps. What is collected and sent has a row a range."""
    spark, part = staged.sparkSession, F.shiftright("_at", PLACE_BITS)
    offsets, total = [], first
    for p, n in sorted((r["p"], r["count"]) for r in staged.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets, "_p bigint, _first bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return staged.join(F.broadcast(table), part == F.col("_p")).withColumn(out, F.col("_first") + place).drop("_p", "_first", "_at")
