"""A leader and its followers over one durable log: what each replica shows is a predicate on the log index."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ranking import number_in_order
from marlstone.model import DELETE, PUT, Closed, InvalidKey, InvalidOptions, NotLeader, require_key
from marlstone.operators import kv
from marlstone.sources import files

LOG = "log_index bigint, kind tinyint, key string, value string"


def visible(log: DataFrame, applied: int) -> DataFrame:
    """The operations that a replica has applied, as a key-value log."""
    return log.filter(F.col("log_index") <= applied).select("key", "value", F.col("log_index").alias("seq"), "kind")


def advance(replicas: DataFrame, commit: int, everything: bool = False) -> DataFrame:
    """One round over (replica, leader, paused, batch, applied): each follower takes its batch (default 1), never beyond the commit."""
    target = F.lit(commit) if everything else F.least(F.lit(commit), F.col("applied") + F.when(F.col("batch") > 0, F.col("batch")).otherwise(1))
    return replicas.withColumn("applied", F.when(F.col("leader"), F.lit(commit)).when(F.col("paused"), F.col("applied")).otherwise(F.greatest("applied", target)).cast("long"))


@dataclass
class Replica:
    id: int
    applied: int = 0
    paused: bool = False
    batch: int = 0


class ReplicaSet:
    """Replica 0 leads. The commit record names the log's files and its last index, so a write that failed stays invisible.

    What replicas have applied survives a reopen; pauses and batch sizes don't. Without a path the set lies in a scratch
    folder.
    """

    def __init__(self, spark: SparkSession, count: int, path: str | None = None) -> None:
        if count < 1:
            raise InvalidOptions("a set needs a leader")
        self.spark, self.count, self.path, self.closed = spark, count, (path or files.scratch(spark, "replicas")).rstrip("/"), False
        record = files.read_record(spark, f"{self.path}/COMMIT.json") or {"version": 1, "commit": 0, "files": [], "applied": [0] * count}
        if len(record["applied"]) != count:
            raise InvalidOptions(f"{count} replicas asked for, the folder has {len(record['applied'])}")
        self.commit, self.files = record["commit"], record["files"]
        self.replicas = [Replica(i, min(a, self.commit)) for i, a in enumerate(record["applied"])]
        self.replicas[0].applied = self.commit

    def _save(self) -> None:
        files.write_record(self.spark, f"{self.path}/COMMIT.json", {"version": 1, "commit": self.commit, "files": self.files, "applied": [r.applied for r in self.replicas]})

    def _open(self) -> None:
        if self.closed:
            raise Closed("the set is closed")

    def log(self) -> DataFrame:
        if not self.files:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{f}" for f in self.files])

    def _append(self, rows: DataFrame, count: int) -> int:
        name = f"log-{uuid.uuid4().hex}"
        rows.select("log_index", "kind", "key", "value").write.parquet(f"{self.path}/{name}")
        self.files, self.commit = [*self.files, name], self.commit + count
        self.replicas[0].applied = self.commit
        self._save()
        return self.commit

    def _row(self, kind: int, key: str, value: str | None) -> int:
        self._open()
        return self._append(self.spark.createDataFrame([(self.commit + 1, kind, require_key(key), value)], LOG), 1)

    def put(self, key: str, value: str) -> int:
        return self._row(PUT, key, value)

    def delete(self, key: str) -> int:
        return self._row(DELETE, key, None)

    def write(self, rows: DataFrame) -> int:
        """Operations (key, value, kind, order) in bulk, in that order; the last index."""
        self._open()
        rows = rows.select("key", "value", F.col("kind").cast("tinyint").alias("kind"), F.col("order").alias("_order"))
        valid = (F.length("key") > 0) & ((F.col("kind") == DELETE) | ((F.col("kind") == PUT) & F.col("value").isNotNull()))
        count, good = rows.agg(F.count(F.lit(1)), F.sum(F.coalesce(valid, F.lit(False)).cast("long"))).first()
        if not count:
            return self.commit
        if good != count:
            raise InvalidKey(f"{count - good} rows have no key, or are neither puts with a value nor deletes")
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        last = self._append(number_in_order(rows, ["_order", "key", "value", "kind"], staged, count, self.commit + 1, "log_index"), count)
        files.remove(self.spark, staged)
        return last

    def _reader(self, mode: str, replica: int) -> Replica:
        self._open()
        if mode == "leader":
            return self.replicas[0]
        if mode == "follower":
            if not 0 < replica < self.count:
                raise NotLeader(f"{replica} is no follower")
            return self.replicas[replica]
        if mode == "any":
            if replica >= self.count:
                raise InvalidOptions(f"no replica {replica}")
            return self.replicas[max(0, replica)]
        raise InvalidOptions(f"no such read mode: {mode}")

    def get(self, key: str, mode: str = "leader", replica: int = -1):
        row = kv.get(visible(self.log(), self._reader(mode, replica).applied), key).first()
        return None if row is None else row["value"]

    def scan(self, start: str | None = None, end: str | None = None, mode: str = "leader", replica: int = -1) -> DataFrame:
        return kv.scan(visible(self.log(), self._reader(mode, replica).applied), start, end)

    def _replicate(self) -> int:
        moved = 0
        for r in self.replicas[1:]:
            if not r.paused:
                step = min(self.commit - r.applied, r.batch or 1)
                r.applied += step
                moved += step
        return moved

    def replicate_once(self) -> int:
        """Each follower that isn't paused takes its batch; how many operations that were."""
        self._open()
        moved = self._replicate()
        if moved:
            self._save()
        return moved

    def replicate_all(self) -> int:
        """Rounds until nothing moves; batches decide their number, not the outcome, so the rounds are taken at once."""
        self._open()
        total = sum(self.commit - r.applied for r in self.replicas[1:] if not r.paused)
        for r in self.replicas[1:]:
            if not r.paused:
                r.applied = self.commit
        if total:
            self._save()
        return total

    def _follower(self, replica: int) -> Replica:
        if not 0 < replica < self.count:
            raise NotLeader(f"{replica} is no follower")
        return self.replicas[replica]

    def pause(self, replica: int, paused: bool = True) -> None:
        self._follower(replica).paused = paused

    def set_batch(self, replica: int, batch: int) -> None:
        if batch < 0:
            raise InvalidOptions("a batch can't be negative")
        self._follower(replica).batch = batch

    def _replace(self, rows: DataFrame, name: str) -> None:
        old = self.files
        rows.select("log_index", "kind", "key", "value").write.parquet(f"{self.path}/{name}")
        self.files = [name]
        self._save()
        for f in old:
            files.remove(self.spark, f"{self.path}/{f}")

    def flush(self) -> None:
        """The log's files become one folder of ranges of the index; what it says stays the same."""
        self._open()
        if len(self.files) > 1:
            self._replace(self.log().repartitionByRange("log_index").sortWithinPartitions("log_index"), f"log-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """What every replica has applied shrinks to the newest put of each key; the rest of the log stays as it is."""
        self._open()
        floor = min(r.applied for r in self.replicas)
        if floor:
            old = kv.compacted(visible(self.log(), floor)).withColumnRenamed("seq", "log_index")
            self._replace(old.unionByName(self.log().filter(F.col("log_index") > floor).select(*old.columns)), f"log-{uuid.uuid4().hex}")

    def status(self) -> DataFrame:
        rows = [(r.id, r.id == 0, r.paused, r.batch, r.applied, self.commit - r.applied) for r in self.replicas]
        return self.spark.createDataFrame(rows, "replica int, leader boolean, paused boolean, batch int, applied bigint, lag bigint")

    def stats(self) -> dict[str, int]:
        return {"replicas": self.count, "commit_index": self.commit, "applied_index": min(r.applied for r in self.replicas), "log_entries": self.log().count()}

    def close(self) -> None:
        self.closed = True
