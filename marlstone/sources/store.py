"""A durable key-value store: sorted Parquet segments, a delta of later operations, and a manifest that names them.

One sequence counter serves all operations and survives flushes, so reads by key and by range always agree on which
operation is the newest. Files are never changed in place: new ones are written, then the manifest is swapped.
"""

from __future__ import annotations

import base64
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ranking import number_in_order
from marlstone.model import DELETE, LOG, PUT, Closed, CorruptRecord, InvalidKey, InvalidOptions, require_key
from marlstone.operators import kv
from marlstone.sources import files

VERSION = 1
#: Key ranges that one read answers: they are held by every task.
MOST_RANGES = 10_000


def validate_manifest(m: dict) -> dict:
    ids = [s.get("id", 0) for s in m.get("segments", [])]
    if m.get("version") != VERSION or m.get("next_id", 0) < 1 or m.get("next_seq", 0) < 1:
        raise CorruptRecord("the manifest's version or counters are invalid")
    if len(set(ids)) != len(ids) or any(i < 1 or i >= m["next_id"] for i in ids):
        raise CorruptRecord("segment ids repeat or are out of range")
    for s in m["segments"]:
        if s["count"] < 1 or not s["path"] or "/" in s["path"] or ".." in s["path"]:
            raise CorruptRecord(f"segment {s['id']} has no rows or an unsafe path")
        try:
            low, high = (base64.b64decode(s[k], validate=True) for k in ("min_key", "max_key"))
        except ValueError as e:
            raise CorruptRecord(f"segment {s['id']} has a key that isn't base64") from e
        if low > high:
            raise CorruptRecord(f"segment {s['id']} ends before it begins")
    return m


def require_unique(rows: DataFrame) -> int:
    """The number of rows of a segment: there must be some, and keys must be there and be unique."""
    n, keyed, distinct = rows.agg(F.count(F.lit(1)), F.sum((F.octet_length("key") > 0).cast("long")), F.count_distinct("key")).first()
    if not n:
        raise InvalidOptions("a segment needs rows")
    if keyed != n:
        require_key(b"")
    if distinct != n:
        raise InvalidOptions("keys of a segment must be unique")
    return n


class Segment:
    """An immutable file of operations, one a key, in the order of keys. Reads show tombstones."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        if not files.exists(spark, path):
            raise CorruptRecord(f"no segment at {path}")
        self.table = spark.read.schema(LOG).parquet(path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, rate: float = 0.01, segment_rows: int = 5_000_000, count: int | None = None) -> Segment:
        """Rows (key, value, seq, kind) in files of disjoint key ranges, each with a Bloom filter on the key.

        ``count``, the most rows there can be, is given by who knows already that keys are unique; else they are checked.
        """
        n = require_unique(rows) if count is None else count
        parts = max(1, -(-n // segment_rows))
        ordered = (rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)).sortWithinPartitions("key")
        writer = ordered.select(*LOG.fieldNames()).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(rate))
        writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, n // parts))).parquet(path)
        return cls(rows.sparkSession, path)

    def get(self, key: bytes) -> DataFrame:
        """The key's operation, tombstones included, or no row: the filter meets statistics and Bloom filters."""
        return self.table.filter(F.col("key") == F.lit(key))

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self.table.filter(kv.in_range(start, end)).orderBy("key")

    def metadata(self) -> DataFrame:
        """(count, min_key, max_key), of live entries and tombstones."""
        return self.table.agg(F.count(F.lit(1)).alias("count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))

    def may_contain(self, key: bytes) -> bool:
        """What the files' own Bloom filters say about a key."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        for status in folder.getFileSystem(conf).listStatus(folder):
            if not status.getPath().getName().endswith(".parquet"):
                continue
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            try:
                for block in reader.getRowGroups():
                    column = next(c for c in block.getColumns() if c.getPath().toDotString() == "key")
                    held = reader.readBloomFilter(column)
                    if held is None or held.findHash(held.hash(jvm.org.apache.parquet.io.api.Binary.fromConstantByteArray(bytearray(key)))):
                        return True
            finally:
                reader.close()
        return False


class Store:
    """Writes by row or by DataFrame; reads are DataFrames. Only one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, false_positive_rate: float = 0.01, segment_rows: int = 5_000_000) -> None:
        if not 0 < false_positive_rate < 1:
            raise InvalidOptions("the false positive rate must lie between 0 and 1")
        self.spark, self.path, self.rate, self.segment_rows, self.closed = spark, path.rstrip("/"), false_positive_rate, segment_rows, False
        text = files.read_text(spark, f"{self.path}/MANIFEST.json")
        try:
            self.manifest = validate_manifest(json.loads(text)) if text else {"version": VERSION, "next_id": 1, "next_seq": 1, "segments": [], "deltas": []}
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptRecord("the manifest can't be read") from e
        self.reads = self.scans = self.flushes = self.compactions = 0

    def _swap(self, **changes: object) -> None:
        new = validate_manifest(self.manifest | changes)
        files.write_text(self.spark, f"{self.path}/MANIFEST.json", json.dumps(new, sort_keys=True))
        self.manifest = new

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    def _append(self, rows: DataFrame, count: int) -> None:
        name = f"delta-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self._swap(deltas=[*self.manifest["deltas"], name], delta_rows=self.manifest.get("delta_rows", 0) + count, next_seq=self.manifest["next_seq"] + count)

    def _row(self, key: bytes, value: bytes | None, kind: int) -> None:
        self._open()
        seq = self.manifest["next_seq"]
        self._append(self.spark.createDataFrame([(bytearray(require_key(key)), None if value is None else bytearray(value), seq, kind)], LOG), 1)

    def put(self, key: bytes, value: bytes) -> None:
        self._row(key, value, PUT)

    def delete(self, key: bytes) -> None:
        self._row(key, None, DELETE)

    def write(self, rows: DataFrame) -> int:
        """Operations (key, value, kind, order) in bulk: each has a seq of its own, in the order of ``order``.

        Equal ``order`` goes by key, value and kind. A row without key, or neither put nor delete, rejects all.
        """
        self._open()
        rows = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("kind").cast("tinyint").alias("kind"), F.col("order").alias("_order"))
        bad_key = F.coalesce(F.octet_length("key") == 0, F.lit(True))
        bad_kind = ~F.coalesce(F.col("kind").isin(PUT, DELETE), F.lit(False)) | ((F.col("kind") == PUT) & F.col("value").isNull())
        count, keyless, kindless = rows.agg(F.count(F.lit(1)), F.sum(bad_key.cast("long")), F.sum(bad_kind.cast("long"))).first()
        if keyless:
            require_key(b"")
        if kindless:
            raise InvalidKey(f"{kindless} rows are neither puts with a value nor deletes")
        if not count:
            return 0
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        placed = number_in_order(rows, ["_order", "key", "value", "kind"], staged, count, self.manifest["next_seq"])
        self._append(placed.select("key", "value", F.col("seq").cast("bigint").alias("seq"), "kind"), count)
        files.remove(self.spark, staged)
        return count

    def _tables(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{n}" for n in names])

    def segments(self) -> DataFrame:
        return self._tables([s["path"] for s in self.manifest["segments"]])

    def segment(self, entry: dict) -> Segment:
        return Segment(self.spark, f"{self.path}/{entry['path']}")

    def delta(self) -> DataFrame:
        return self._tables(self.manifest["deltas"])

    def log(self) -> DataFrame:
        return self._tables([s["path"] for s in self.manifest["segments"]] + self.manifest["deltas"])

    def bounds(self) -> DataFrame:
        """The manifest's segments: (id, count, min_key, max_key)."""
        rows = [(s["id"], s["count"], bytearray(base64.b64decode(s["min_key"])), bytearray(base64.b64decode(s["max_key"]))) for s in self.manifest["segments"]]
        return self.spark.createDataFrame(rows, "id int, count bigint, min_key binary, max_key binary")

    def get(self, key: bytes) -> bytes | None:
        """The value or None. Segments whose key bounds exclude the key aren't read; in the others the equality filter
        meets row-group statistics and the Parquet Bloom filter."""
        self._open()
        self.reads += 1
        if not key:
            return None
        code = lambda s: base64.b64decode(s)
        names = [s["path"] for s in self.manifest["segments"] if code(s["min_key"]) <= key <= code(s["max_key"])]
        row = kv.get(self._tables(names + self.manifest["deltas"]), key).first()
        return None if row is None else bytes(row["value"])

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The live entries of the column ``key``, in one read."""
        self._open()
        self.reads += 1
        return kv.get_many(self.log(), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self._open()
        self.scans += 1
        return kv.scan(self.log(), start, end)

    def scan_many(self, ranges: list[tuple[bytes, bytes]]) -> DataFrame:
        """(range, key, value, seq) for many ranges [start, end) in one read; an entry is in each range that holds it."""
        self._open()
        if len(ranges) > MOST_RANGES:
            raise InvalidOptions(f"more than {MOST_RANGES} ranges; ask for them in parts")
        self.scans += len(ranges)
        wanted = self.spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(ranges)], "range int, _from binary, _to binary")
        return kv.live(self.log()).join(F.broadcast(wanted), (F.col("key") >= F.col("_from")) & (F.col("key") < F.col("_to"))).select("range", "key", "value", "seq")

    def _write_segment(self, rows: DataFrame, most: int) -> list[dict]:
        """A segment's entry; [] if there are no rows. ``rows`` come from an aggregate by key, so keys are unique; there
        are no more than ``most`` of them."""
        name, ident = f"segment-{uuid.uuid4().hex}", self.manifest["next_id"]
        b = Segment.create(rows, f"{self.path}/{name}", self.rate, self.segment_rows, most).metadata().first()
        if not b["count"]:
            files.remove(self.spark, f"{self.path}/{name}")
            return []
        return [{"id": ident, "path": name, "count": b["count"], "min_key": base64.b64encode(bytes(b["min_key"])).decode(), "max_key": base64.b64encode(bytes(b["max_key"])).decode()}]

    def flush(self) -> None:
        """The delta becomes a segment, tombstones included; nothing happens if it is empty."""
        self._open()
        if not self.manifest["deltas"]:
            return
        old, new = self.manifest["deltas"], self._write_segment(kv.merge_latest(self.delta()), self.manifest.get("delta_rows") or self.delta().count())
        self._swap(segments=self.manifest["segments"] + new, deltas=[], delta_rows=0, next_id=self.manifest["next_id"] + len(new))
        for n in old:
            files.remove(self.spark, f"{self.path}/{n}")
        self.flushes += 1

    def compact(self) -> None:
        """All segments become one: newest puts stay with their seq, tombstones go. The delta is left alone."""
        self._open()
        old = self.manifest["segments"]
        if len(old) < 2:
            return
        new = self._write_segment(kv.compacted(self.segments()), sum(s["count"] for s in old))
        self._swap(segments=new, next_id=self.manifest["next_id"] + len(new))
        for s in old:
            files.remove(self.spark, f"{self.path}/{s['path']}")
        self.compactions += 1

    def stats(self) -> dict[str, int]:
        size = kv.approximate_bytes(self.delta()).first()
        return {
            "memtable_entries": size["entries"], "memtable_bytes": size["approx_bytes"], "segments": len(self.manifest["segments"]), "segment_entries": sum(s["count"] for s in self.manifest["segments"]),
            "next_seq": self.manifest["next_seq"], "reads": self.reads, "scans": self.scans, "flushes": self.flushes, "compactions": self.compactions, "live_keys": kv.live(self.log()).count(),
        }

    def should_flush(self, most_bytes: int = 64 << 20) -> bool:
        return self.stats()["memtable_bytes"] >= most_bytes

    def close(self) -> None:
        self.closed = True
