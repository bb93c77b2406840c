"""Traces: what a read or write met on its way, from counts that Spark made, never from steps that didn't happen."""

from __future__ import annotations

import base64
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import bloom
from marlstone.model import STEP, InvalidOptions, require_key, require_vector
from marlstone.operators import kv, vector


@dataclass
class Step:
    component: str
    step_type: str
    status: str
    duration_ns: int
    detail: str = ""
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Trace:
    operation: str
    key: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: int = field(default_factory=time.time_ns)
    finished_at: int = 0
    steps: list[Step] = field(default_factory=list)
    error: str = ""

    def step(self, component: str, step_type: str, status: str, since: int, detail: str = "", **metadata: object) -> None:
        self.steps.append(Step(component, step_type, status, time.time_ns() - since, detail, {k: str(v) for k, v in metadata.items()}))

    @contextmanager
    def timed(self, component: str, step_type: str, detail: str = "", **metadata: object) -> Iterator[dict[str, object]]:
        """A step around a block, which may add metadata; if the block fails, the step and the trace say so."""
        since = time.time_ns()
        try:
            yield metadata
        except Exception as e:
            self.step(component, step_type, "error", since, detail or type(e).__name__, **metadata)
            self.finish(str(e))
            raise
        self.step(component, step_type, "ok", since, detail, **metadata)

    def finish(self, error: str = "") -> Trace:
        self.finished_at, self.error = time.time_ns(), error
        return self

    @property
    def duration_ns(self) -> int:
        return max(0, self.finished_at - self.started_at)

    @property
    def steps_ns(self) -> int:
        return sum(s.duration_ns for s in self.steps)

    def with_status(self, status: str) -> list[Step]:
        return [s for s in self.steps if s.status == status]

    def of_component(self, component: str) -> list[Step]:
        return [s for s in self.steps if s.component == component]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def __str__(self) -> str:
        lines = [f"{s.component} {s.step_type} {s.status} {s.duration_ns} ns {s.detail}".rstrip() for s in self.steps]
        return "\n".join([f"{self.operation} {self.key}", *lines])

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(s).values()) for s in self.steps], STEP)


def get_versions(log: DataFrame, key: str) -> DataFrame:
    """Every version of a key that a read meets: (source, seq, kind, status).

    The newest one decides: HIT for a value, TOMBSTONE for a delete; the others are SUPERSEDED. Versions are held against
    the newest seq, an aggregate of one row, so a key with very many of them is no task's alone.
    """
    versions = log.filter(F.col("key") == key)
    newest = F.broadcast(versions.agg(F.max("seq").alias("_newest")))
    first = F.col("seq") == F.col("_newest")
    status = F.when(first & (F.col("kind") == 1), "HIT").when(first, "TOMBSTONE").otherwise("SUPERSEDED")
    return versions.join(newest).select("source", "seq", "kind", status.alias("status"))


#: Keys that are traced at once; each is a pass over the segments' keys.
MOST_KEYS = 64


def get_steps(log: DataFrame, keys: list[str], rate: float = 0.01) -> DataFrame:
    """What reading each key meets in the segments of a log, newest first: (key, place, source, step).

    A segment whose bounds exclude the key is BOUNDS_SKIP, one whose Bloom filter does is BLOOM_SKIP; others are
    BLOOM_CHECK and then SSTABLE_HIT or SSTABLE_MISS. A hit ends it, also one of a tombstone; without one NOT_FOUND
    comes last, with no source. Segments come in the order of their newest operation. ``place`` counts from 0.
    """
    if not 0 < len(keys) <= MOST_KEYS:
        raise InvalidOptions(f"from 1 to {MOST_KEYS} keys can be traced at once")
    bits, hashes = bloom.size_columns(F.col("n"), F.lit(rate))
    held = log.groupBy("source", "key").agg(F.max("seq").alias("seq"))
    sized = held.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("newest")).select("source", "low", "high", "newest", bits.alias("bits"), hashes.cast("long").alias("hashes"))
    first, second = bloom.hash_columns(F.col("key"))
    hashed = held.select("source", "key", first.alias("a"), second.alias("b")).join(sized.select(F.col("source").alias("_s"), "bits", "hashes"), F.col("source") == F.col("_s"))
    marks = [F.bit_or(bloom.covered(k)("a", "b", "bits", "hashes")).alias(f"mask{i}") for i, k in enumerate(keys)]
    found = [F.max((F.col("key") == k).cast("int")).alias(f"has{i}") for i, k in enumerate(keys)]
    asked = hashed.groupBy("source").agg(*marks, *found).withColumnRenamed("source", "_s")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"mask{i}").alias("mask"), (F.col(f"has{i}") == 1).alias("has")) for i, k in enumerate(keys)]))
    seen = sized.join(asked, F.col("source") == F.col("_s")).select("source", "low", "high", "newest", "hashes", each.alias("k")).select("source", "low", "high", "newest", "hashes", "k.*")
    full = F.bit_count("mask") == F.col("hashes")
    steps = F.when((F.col("key") < F.col("low")) | (F.col("key") > F.col("high")), F.array(F.lit("BOUNDS_SKIP"))).when(~full, F.array(F.lit("BLOOM_SKIP"))).when(F.col("has"), F.array(F.lit("BLOOM_CHECK"), F.lit("SSTABLE_HIT"))).otherwise(F.array(F.lit("BLOOM_CHECK"), F.lit("SSTABLE_MISS")))
    # A row a segment and key from here on.
    hit = F.max(F.when(F.element_at(steps, -1) == "SSTABLE_HIT", F.col("newest"))).over(Window.partitionBy("key"))
    read = seen.withColumn("steps", steps).withColumn("hit", hit).filter(F.col("hit").isNull() | (F.col("newest") >= F.col("hit")))
    rows = read.select("key", "source", "newest", F.posexplode("steps").alias("i", "step"))
    missing = read.filter("hit is null").select("key").distinct().select("key", F.lit(None).cast("string").alias("source"), F.lit(-1).cast("long").alias("newest"), F.lit(0).alias("i"), F.lit("NOT_FOUND").alias("step"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("newest"), "source", "i")) - 1
    return rows.unionByName(missing).select("key", place.cast("int").alias("place"), "source", "step")


def scan_sources(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(source, entries) of the range, one row a source that the scan reads."""
    return log.filter(kv.in_range(start, end)).groupBy("source").agg(F.count(F.lit(1)).alias("entries"))


def scan_merge(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(entries, keys, live, suppressed): what merging the range's sources keeps and hides."""
    latest = log.filter(kv.in_range(start, end)).groupBy("key").agg(F.max_by("kind", "seq").alias("kind"), F.count(F.lit(1)).alias("n"))
    live = F.sum((F.col("kind") == 1).cast("long"))
    return latest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("keys"), F.coalesce(live, F.lit(0)).alias("live"), F.coalesce(F.sum("n") - live, F.lit(0)).alias("suppressed"))


def explain_get(store, key: bytes) -> Trace:
    """A read's way: the delta, then segments from the newest on until one has the key, a tombstone included.

    A segment is skipped by its bounds, or by the Bloom filters of its own files. The last step's status is the outcome:
    "hit" for a value, "miss" for none, a tombstone's included.
    """
    t, at = Trace("GET", key.decode("utf-8", "replace")), time.time_ns()
    store._open()
    t.step("ENGINE", "KEY_VALIDATED", "ok", at, key_len=len(key))
    if not key:
        return t.finish()

    def met(where: DataFrame, hit: str, miss: str, component: str, **about: object) -> bool:
        at = time.time_ns()
        row = where.groupBy().agg(F.max_by(F.struct("kind", F.octet_length("value").alias("n")), "seq").alias("r")).first()["r"]
        if row is None:
            t.step(component, miss, "miss", at, **about)
            return False
        value = row["kind"] == 1
        t.step(component, hit, "hit" if value else "miss", at, **about, **({"value_len": row["n"]} if value else {"tombstone": "true"}))
        return True

    if met(store.delta().filter(F.col("key") == F.lit(key)), "MEMTABLE_HIT", "MEMTABLE_MISS", "MEMTABLE"):
        return t.finish()
    for s in reversed(store.manifest["segments"]):
        at = time.time_ns()
        low, high = base64.b64decode(s["min_key"]), base64.b64decode(s["max_key"])
        if not low <= key <= high:
            t.step("SSTABLE", "BOUNDS_SKIP", "skipped", at, sstable_id=s["id"], reason="below_min" if key < low else "above_max")
            continue
        segment = store.segment(s)
        if not segment.may_contain(key):
            t.step("BLOOM", "BLOOM_SKIP", "skipped", at, sstable_id=s["id"])
            continue
        t.step("BLOOM", "BLOOM_CHECK", "ok", at, sstable_id=s["id"])
        if met(segment.get(key), "SSTABLE_HIT", "SSTABLE_MISS", "SSTABLE", sstable_id=s["id"]):
            return t.finish()
    t.step("ENGINE", "NOT_FOUND", "miss", time.time_ns(), sstables_checked=len(store.manifest["segments"]))
    return t.finish()


def _write(t: Trace, store, key: bytes, act, **about: object) -> Trace:
    with t.timed("ENGINE", "KEY_VALIDATED", key_len=len(key)):
        require_key(key)
    with t.timed("WAL", "WAL_APPEND", **about) as m:
        act()
        m["seq"] = store.manifest["next_seq"] - 1
    # The delta is the memtable: what was appended is what reads see.
    t.step("delta", "MEMTABLE_PUT", "ok", time.time_ns(), deltas=len(store.manifest["deltas"]), **about)
    return t.finish()


def explain_put(store, key: bytes, value: bytes) -> Trace:
    return _write(Trace("PUT", key.decode("utf-8", "replace")), store, key, lambda: store.put(key, value), bytes=len(value))


def explain_delete(store, key: bytes) -> Trace:
    return _write(Trace("DELETE", key.decode("utf-8", "replace")), store, key, lambda: store.delete(key), tombstone="true")


def explain_scan(store, start: bytes | None = None, end: bytes | None = None) -> Trace:
    t = Trace("SCAN", "")
    tables = [(s["path"], store._tables([s["path"]])) for s in store.manifest["segments"]] + [("delta", store.delta())]
    for name, table in tables:
        at = time.time_ns()
        t.step(name, "SCAN_SOURCE", "ok", at, count=table.filter(kv.in_range(start, end)).count())
    at = time.time_ns()
    m = scan_merge(store.log(), start, end).first()
    t.step("engine", "SCAN_MERGE", "ok", at, **m.asDict())
    return t.finish()


def explain_upsert(store: vector.VectorStore, name: str, values: list[float], metadata: bytes | None = None) -> Trace:
    """Lengths alone; vectors are never part of a trace."""
    t = Trace("VECTOR_INSERT", name)
    with t.timed("VECTOR", "VECTOR_VALIDATE", dimension=store.dimension, metric=store.metric):
        key, record = store.key(name), None
        require_vector([float(x) for x in values], store.dimension, store.metric)
    with t.timed("VECTOR", "VECTOR_ENCODE") as m:
        record = store.record(values, metadata)
        m["encoded_len"] = len(record)
    with t.timed("VECTOR", "VECTOR_ENGINE_WRITE", key_len=len(key), value_len=len(record)):
        store.store.put(key, record)
    with t.timed("VECTOR", "VECTOR_INDEX_UPDATE") as m:
        m["index_size"] = store.count()
    return t.finish()


def explain_vector_delete(store: vector.VectorStore, name: str) -> Trace:
    t = Trace("VECTOR_DELETE", name)
    with t.timed("VECTOR", "VECTOR_VALIDATE", id_len=len(name)):
        key = store.key(name)
    with t.timed("VECTOR", "VECTOR_ENGINE_WRITE", key_len=len(key), tombstone="true") as m:
        m["existed"] = store.store.get(key) is not None
        store.delete(name)
    with t.timed("VECTOR", "VECTOR_INDEX_DELETE") as m:
        m["index_size"] = store.count()
    return t.finish()


def explain_search(store: vector.VectorStore, query: list[float], k: int) -> Trace:
    """Counts alone; vectors are never part of a trace."""
    t = Trace("VECTOR_SEARCH", store.namespace)
    with t.timed("VECTOR", "VECTOR_LOAD") as m:
        m["vectors"] = store.count()
    with t.timed("VECTOR", "VECTOR_TOPK", metric=store.metric, k=k) as m:
        m["hits"] = len(store.search(query, k).collect())
    return t.finish()
