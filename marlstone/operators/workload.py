"""Workloads of keys and values, their generators, and percentiles without interpolation."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.model import InvalidOptions
from marlstone.sources.store import Store

#: The generator's constants (fixed values): a linear congruence over 64 bits whose top byte is used.
MULTIPLIER, INCREMENT, SPREAD = 6364136223846793005, 1442695040888963407, -7046029254386353131
SCALES = {"small": {"keys": 1000, "value_bytes": 128, "flush_every": 100, "range": 50, "scans": 100}, "medium": {"keys": 50000, "value_bytes": 256, "flush_every": 1000, "range": 500, "scans": 500}}


def key(index: int) -> str:
    return f"key-{index:010d}"


def key_column(index: Column) -> Column:
    return F.concat(F.lit("key-"), F.lpad(index.cast("string"), 10, "0"))


def value(index: int, size: int, seed: int = 42) -> bytes:
    h = (seed ^ (index * SPREAD)) % (1 << 64)
    out = bytearray()
    for _ in range(size):
        h = (h * MULTIPLIER + INCREMENT) % (1 << 64)
        out.append(h >> 56)
    return bytes(out)


def percentile(values: list[float], p: int) -> float:
    """The sorted value at (n - 1) * p / 100, cut to an integer; 0 for none."""
    return sorted(values)[(len(values) - 1) * p // 100] if values else 0.0


def percentiles(rows: DataFrame, value_col: str, ps: list[int], ranges: int = 32) -> DataFrame:
    """One row with a column p<n> each: the same rule over a column of any length; nulls don't count.

    Values are dealt over ranges by approximate quantiles and counted there; running sums over the ranges tell in which
    one a rank falls, and that one alone is ordered. Of equal values a range holds one row with their count.
    """
    counts = rows.filter(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{counts.schema['v'].dataType.simpleString()}>"), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    ranged = counts.withColumn("_range", at)
    sums, total = [], 0
    for r in sorted(ranged.groupBy("_range").agg(F.sum("n").alias("n")).collect()):  # a row a range
        sums.append((r["_range"], total, r["n"]))
        total += r["n"]
    wanted = [(f"p{p}", (total - 1) * p // 100) for p in ps]
    hit = {name: next(((k, rank - before) for k, before, n in sums if before <= rank < before + n), None) for name, rank in wanted}
    met = ranged.filter(F.col("_range").isin(sorted({h[0] for h in hit.values() if h}) or [-1]))
    up_to = met.withColumn("up_to", F.sum("n").over(Window.partitionBy("_range").orderBy("v")))
    pick = lambda h: (F.col("_range") == h[0]) & (F.col("up_to") > h[1]) if h else F.lit(False)
    return up_to.agg(*[F.min(F.when(pick(hit[name]), F.col("v"))).alias(name) for name, _ in wanted])


def values(index: np.ndarray, size: int, seed: int = 42) -> list[bytes]:
    """``value`` of many indices at once: one step of the generator for all of them a byte."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed) ^ (index.astype(np.uint64) * np.uint64(SPREAD % (1 << 64)))
        out = np.empty((len(index), size), np.uint8)
        for i in range(size):
            h = h * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
            out[:, i] = (h >> np.uint64(56)).astype(np.uint8)
    return [row.tobytes() for row in out]


def value_column(size: int, seed: int = 42):
    @F.pandas_udf("binary")
    def make(index: pd.Series) -> pd.Series:
        return pd.Series(values(index.to_numpy(np.int64), size, seed), dtype=object)

    return make


def operations(spark: SparkSession, n: int, size: int, first: int = 0) -> DataFrame:
    """Puts (key, value, kind, order) of the indices from ``first`` to n, made on the executors."""
    return spark.range(first, n).select(key_column(F.col("id")).cast("binary").alias("key"), value_column(size)("id").alias("value"), F.lit(1).cast("tinyint").alias("kind"), F.col("id").alias("order"))


class Recorder:
    """Operations with their times. Operations that one job answers each have the time of that job."""

    def __init__(self) -> None:
        self.times: list[tuple[float, int]] = []
        self.answered = 0
        self.notes: dict[str, object] = {}

    def batch(self, operations: int, work: Callable[[], int]) -> None:
        at = time.perf_counter()
        self.answered += work()
        self.times.append((time.perf_counter() - at, operations))

    @property
    def operations(self) -> int:
        return sum(n for _, n in self.times)

    def percentile(self, p: int) -> float:
        return percentile([t for t, n in self.times for _ in range(n)], p)


def _load(store: Store, first: int, last: int, s: dict) -> None:
    """Puts the indices from ``first`` to ``last``, a flush after each ``flush_every`` of them and at the end."""
    for at in range(first, last, s["flush_every"]):
        store.write(operations(store.spark, min(at + s["flush_every"], last), s["value_bytes"], at))
        store.flush()


def _gets(store: Store, index: DataFrame) -> int:
    return store.get_many(index.select(key_column(F.col("id")).cast("binary").alias("key"))).count()


def _ranges(keys: int, count: int, width: int) -> list[tuple[bytes, bytes]]:
    starts = [(i * max(1, keys // count)) % keys for i in range(count)]
    return [(key(a).encode(), key(min(a + width, keys)).encode()) for a in starts]


def write_heavy(store: Store, s: dict, rec: Recorder) -> None:
    for at in range(0, s["keys"], s["flush_every"]):
        last = min(at + s["flush_every"], s["keys"])
        rec.batch(last - at, lambda at=at, last=last: store.write(operations(store.spark, last, s["value_bytes"], at)))
        store.flush()


def read_heavy(store: Store, s: dict, rec: Recorder) -> None:
    """As many gets as keys, one in twenty of a key that isn't there."""
    n = s["keys"]
    _load(store, 0, n, s)
    rec.batch(n, lambda: _gets(store, store.spark.range(n).select(F.when(F.col("id") % 20 == 0, F.col("id") + n).otherwise(F.col("id")).alias("id"))))


def mixed(store: Store, s: dict, rec: Recorder) -> None:
    """By the last digit of the index: 0 to 4 puts, 5 to 7 gets, 8 and 9 deletes, over a store that holds half of the keys."""
    n, every = s["keys"], s["flush_every"]
    _load(store, 0, n // 2, s)
    digit = F.col("order") % 10
    for at in range(0, n, every):
        last = min(at + every, n)
        ops = operations(store.spark, last, s["value_bytes"], at)
        writes = ops.filter((digit < 5) | (digit > 7)).withColumn("value", F.when(digit < 5, F.col("value"))).withColumn("kind", F.when(digit < 5, 1).otherwise(2))
        gets = store.spark.range(at, last).filter("id % 10 between 5 and 7")
        # No key is met twice, so the gets of a batch see the same before and after its writes.
        rec.batch(sum(5 <= i % 10 <= 7 for i in range(at, last)), lambda gets=gets: _gets(store, gets))
        rec.batch(sum(not 5 <= i % 10 <= 7 for i in range(at, last)), lambda writes=writes: store.write(writes))
        store.flush()


def scans(store: Store, s: dict, rec: Recorder) -> None:
    _load(store, 0, s["keys"], s)
    rec.batch(s["scans"], lambda: store.scan_many(_ranges(s["keys"], s["scans"], s["range"])).count())


def compaction(store: Store, s: dict, rec: Recorder) -> None:
    """Gets and scans before and after five segments become one."""
    n = s["keys"] // 5 * 5
    _load(store, 0, n, s | {"flush_every": n // 5})
    gets, count = min(100, n // 5), min(20, s["scans"])
    rec.notes["segments_before"] = len(store.manifest["segments"])

    def sample() -> None:
        rec.batch(gets, lambda: _gets(store, store.spark.range(gets)))
        rec.batch(count, lambda: store.scan_many(_ranges(n, count, s["range"])).count())

    sample()
    at = time.perf_counter()
    store.compact()
    rec.notes |= {"compact_seconds": time.perf_counter() - at, "segments_after": len(store.manifest["segments"])}
    sample()


def restart(store: Store, s: dict, rec: Recorder) -> None:
    """Half of the keys in segments and half in the delta; the store is opened again and a key of each half is read."""
    n = s["keys"]
    _load(store, 0, n // 2, s)
    store.write(operations(store.spark, n, s["value_bytes"], n // 2))
    store.close()

    def reopen() -> int:
        again = Store(store.spark, store.path)
        return sum(again.get(key(i).encode()) == value(i, s["value_bytes"]) for i in (0, n - 1))

    rec.batch(1, reopen)


WORKLOADS: dict[str, Callable[[Store, dict, Recorder], None]] = {"write-heavy": write_heavy, "read-heavy": read_heavy, "mixed": mixed, "scan": scans, "compaction": compaction, "restart": restart}


def run(spark: SparkSession, path: str, name: str, scale: str = "small") -> dict:
    """One of the six workloads: name, operations, rows that answered them, seconds, operations a second, P50, P95, P99."""
    if name not in WORKLOADS or scale not in SCALES:
        raise InvalidOptions(f"no such workload or scale: {name}, {scale}")
    rec, began = Recorder(), time.perf_counter()
    WORKLOADS[name](Store(spark, path), SCALES[scale], rec)
    seconds = time.perf_counter() - began
    return {"workload": name, "scale": scale, "operations": rec.operations, "answered": rec.answered, "seconds": seconds, "ops_per_second": rec.operations / seconds, **{f"p{p}": rec.percentile(p) for p in (50, 95, 99)}, **rec.notes}


def report(results: list[dict]) -> str:
    """A Markdown table."""
    rows = [f"| {r['workload']} | {r['operations']} | {r['seconds']:.3f} | {r['ops_per_second']:.0f} | {r['p50']:.4f} | {r['p95']:.4f} | {r['p99']:.4f} |" for r in results]
    return "\n".join(["| workload | operations | seconds | operations a second | P50 s | P95 s | P99 s |", "|---|---|---|---|---|---|---|", *rows])
