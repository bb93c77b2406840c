"""Versioned key-value semantics over an operation log: the newest operation of a key wins, deletes hide it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.model import DELETE, PUT, require_key


def merge_latest(log: DataFrame) -> DataFrame:
    """The newest operation of each key (key, value, seq, kind), tombstones included.

    One aggregate over (seq, kind, value): rows of a key are reduced before the shuffle, so a key with a third of all
    operations costs no task more than one row a map task.
    """
    newest = F.max_by(F.struct("value", "seq", "kind"), F.col("seq"))
    return log.groupBy("key").agg(newest.alias("n")).select("key", "n.value", "n.seq", "n.kind")


def live(log: DataFrame) -> DataFrame:
    """(key, value, seq) of the keys that hold a value. An empty value is a value."""
    return merge_latest(log).filter(F.col("kind") == PUT).select("key", "value", "seq")


def in_range(start: bytes | str | None, end: bytes | str | None) -> Column:
    """``start <= key < end``; an absent or empty bound is open. A plain comparison, so it reaches the Parquet scan."""
    keep = F.lit(True)
    if start:
        keep = keep & (F.col("key") >= F.lit(start))
    if end:
        keep = keep & (F.col("key") < F.lit(end))
    return keep


def scan(log: DataFrame, start: bytes | str | None = None, end: bytes | str | None = None) -> DataFrame:
    """Live entries with ``start <= key < end`` in byte order of the keys."""
    return live(log.filter(in_range(start, end))).orderBy("key")


def get(log: DataFrame, key: bytes | str) -> DataFrame:
    """The live entry of a key, or no row. The empty key is never there and is no error here."""
    return live(log.filter(F.col("key") == F.lit(key)))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The live entries of the keys in ``keys`` (column ``key``); the join, not the driver, holds the keys."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"))


def put(key: bytes | str, value: bytes | str, seq: int) -> tuple:
    return require_key(key), value, seq, PUT


def delete(key: bytes | str, seq: int) -> tuple:
    """A tombstone, also for a key that was never there."""
    return require_key(key), None, seq, DELETE


def compacted(segments: DataFrame) -> DataFrame:
    """What a full compaction of all segments keeps: the newest put of each key with its own seq; tombstones go."""
    return merge_latest(segments).filter(F.col("kind") == PUT)


def approximate_bytes(log: DataFrame, overhead: int = 64) -> DataFrame:
    """Entries (one a key) and their size estimate: key and value lengths plus ``overhead`` each."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead
    return merge_latest(log).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("approx_bytes"))
