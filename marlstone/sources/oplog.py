"""Operation logs as Parquet: appending, replay with validation, and what a follower asks of a log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.ranking import number_in_order
from marlstone.model import LOG, CorruptRecord, InvalidKey, ReplicationGap, SequenceHole
from marlstone.sources import files

#: Bytes of a record at most; entries that a follower gets at once unless it says otherwise.
MOST_BYTES, DEFAULT_LIMIT = 64 << 20, 1000


def body_crc() -> Column:
    """CRC-32 over a record's seq, kind, key and value."""
    return F.crc32(F.concat(F.col("seq").cast("string").cast("binary"), F.lit(b"|"), F.col("kind").cast("string").cast("binary"), F.lit(b"|"), F.col("key").cast("binary"), F.lit(b"|"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))))


def _refused(most_bytes: int) -> Column:
    """Whether a record has no key, no valid kind, or too many bytes; what can't be told counts as such."""
    valid = (F.octet_length("key") > 0) & F.col("kind").isin(1, 2) & (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) <= most_bytes)
    return ~F.coalesce(valid, F.lit(False))


def append(rows: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Appends (key, value, seq, kind) rows; a batch with an invalid record is refused whole."""
    bad = rows.filter(_refused(most_bytes) | F.col("seq").isNull()).first()
    if bad:
        raise InvalidKey(f"not a valid record: seq {bad['seq']}")
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    rows.withColumn("crc", body_crc()).write.mode("append").parquet(path)


class OpLog:
    """A log that gives records their seqs: what a caller's rows say about theirs is ignored."""

    def __init__(self, spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> None:
        self.spark, self.path, self.most_bytes = spark, path.rstrip("/"), most_bytes
        self.seq = bounds(self.replay()).first()["latest_seq"] if files.exists(spark, self.path) else 0

    def append(self, rows: DataFrame) -> int:
        """Appends (key, value, kind, order) in that order; the last seq. A batch with an invalid record is refused whole."""
        rows = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("kind").cast("tinyint").alias("kind"), F.col("order").alias("_order"))
        count, bad = rows.agg(F.count(F.lit(1)), F.sum(_refused(self.most_bytes).cast("long"))).first()
        if bad:
            raise InvalidKey(f"{bad} of {count} records aren't valid")
        if count:
            staged = f"{self.path}-staged-{uuid.uuid4().hex}"
            _write(number_in_order(rows, ["_order", "key", "value", "kind"], staged, count, self.seq + 1).drop("_order"), self.path)
            files.remove(self.spark, staged)
            self.seq += count
        return self.seq

    def replay(self) -> DataFrame:
        return replay(self.spark, self.path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """All records in order of seq; a record that doesn't match its CRC, or has none, is an error."""
    rows = spark.read.parquet(path)
    damaged = rows.filter(~F.col("crc").eqNullSafe(body_crc())).select("seq").first()
    if damaged:
        raise CorruptRecord(f"record {damaged['seq']} doesn't match its checksum")
    return rows.select(*LOG.fieldNames()).orderBy("seq")


def entries_after(log: DataFrame, after: int, limit: int = DEFAULT_LIMIT, seq: str = "seq") -> DataFrame:
    """The next entries in order; a limit of zero or less means all. The filter reaches the scan, the limit is a top-k."""
    rows = log.filter(F.col(seq) > after).orderBy(seq)
    return rows.limit(limit) if limit > 0 else rows


def bounds(log: DataFrame, baseline: int = 0) -> DataFrame:
    """(first_available_seq, latest_seq, entries): 0 for the first of an empty log, the baseline for its latest."""
    return log.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("first_available_seq"), F.coalesce(F.max("seq"), F.lit(baseline)).alias("latest_seq"), F.count(F.lit(1)).alias("entries"))


def check_gap(log: DataFrame, after: int, baseline: int = 0) -> None:
    b = bounds(log, baseline).first()
    check_bounds(b["first_available_seq"], b["latest_seq"], after, baseline)


def check_bounds(first_available: int, latest: int, after: int, baseline: int = 0) -> None:
    """An empty log with a baseline beyond ``after`` is a gap, too."""
    first = first_available or (baseline + 1 if baseline else 0)
    if first and after + 1 < first:
        raise ReplicationGap(after, first, latest)


def gaps(cursors: DataFrame, log: DataFrame, baseline: int = 0) -> DataFrame:
    """(follower, cursor, first_available_seq, latest_seq, gap, lag) for rows (follower, cursor): who can go on by this log."""
    first = F.when(F.col("first_available_seq") > 0, F.col("first_available_seq")).otherwise(F.lit(baseline + 1 if baseline else 0))
    both = cursors.select("follower", "cursor").join(F.broadcast(bounds(log, baseline).drop("entries")))  # one row
    return both.withColumn("gap", (first > 0) & (F.col("cursor") + 1 < first)).withColumn("lag", F.greatest(F.lit(0), F.col("latest_seq") - F.col("cursor")))


def holes(log: DataFrame, baseline: int = 0, block: int = 1 << 16) -> DataFrame:
    """(seq, previous) where a seq doesn't follow its predecessor, or repeats.

    Blocks of seqs are checked each for themselves, their ends against the next block's start: no task sorts the
    whole log.
    """
    blocked = log.select("seq").withColumn("b", F.floor(F.col("seq") / block))
    w = Window.partitionBy("b").orderBy("seq")
    inner = blocked.withColumn("previous", F.lag("seq").over(w)).filter(F.col("previous").isNotNull() & (F.col("seq") != F.col("previous") + 1)).select("seq", "previous")
    return inner.unionByName(_across(blocked.groupBy("b").agg(F.min("seq").alias("seq"), F.max("seq").alias("last")), baseline))


def _across(ends: DataFrame, baseline: int) -> DataFrame:
    """Holes between blocks. A block whose predecessor is there is held against it by a join; the few others, which begin
    after empty blocks, by the ends of the blocks next before them."""
    before = ends.select((F.col("b") + 1).alias("_b"), F.col("last").alias("previous"))
    joined = ends.join(before, F.col("b") == F.col("_b"), "left").select("b", "seq", "previous")
    touching = joined.filter(F.col("previous").isNotNull() & (F.col("seq") != F.col("previous") + 1)).select("seq", "previous")
    # What has no predecessor begins a run of blocks; runs are as many as there are holes of a whole block or more.
    starts = joined.filter("previous is null").select("b", "seq")
    after = ends.select((F.col("b") - 1).alias("_b")).withColumn("_there", F.lit(True))
    stops = ends.join(after, F.col("b") == F.col("_b"), "left").filter("_there is null").select("b", F.col("last").alias("stop"))
    runs = starts.withColumn("stop", F.lit(None).cast("bigint")).unionByName(stops.withColumn("seq", F.lit(None).cast("bigint")), allowMissingColumns=True)
    order = Window.orderBy("b", F.col("seq").isNull())
    lagged = runs.withColumn("previous", F.coalesce(F.last("stop", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(baseline)))
    return touching.unionByName(lagged.filter(F.col("seq").isNotNull() & (F.col("seq") != F.col("previous") + 1)).select("seq", "previous"))


def require_contiguous(log: DataFrame, baseline: int = 0) -> None:
    hole = holes(log, baseline).orderBy("seq").first()
    if hole:
        raise SequenceHole(f"{hole['seq']} follows {hole['previous']}")
