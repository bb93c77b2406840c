"""Replication of an ordered journal with Structured Streaming.

A primary's journal is a folder of Parquet files with dense seqs. A follower reads it as a stream and applies each
micro-batch: what is at or below its cursor is skipped, what doesn't follow the cursor is an error, and the cursor moves
after the rows are there. A batch that runs twice therefore changes nothing.
"""

from __future__ import annotations

import random
import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.model import (
    JOURNAL, AlreadyPromoted, InvalidKey, InvalidOptions, NodeQuiesced, NotFollower, PromotionNotReady, PromotionRecordInvalid, PromotionSequenceMismatch, PromotionSourceMismatch, QuiesceFailedFenced,
    ReplicationGap, SequenceHole, SyncInProgress)
from marlstone.operators import kv
from marlstone.sources import files, oplog

#: The largest seq there may be: one more wouldn't fit.
LAST_SEQ = (1 << 63) - 1


def as_log(entries: DataFrame) -> DataFrame:
    """Journal rows as a key-value log."""
    return entries.select("key", "value", "seq", F.when(F.col("op") == "delete", 2).otherwise(1).cast("tinyint").alias("kind"))


def fresh(entries: DataFrame, cursor: int) -> tuple[DataFrame, int, int]:
    """The entries beyond the cursor, how many, and their last seq; they must continue it without a hole or a repeat.

    An entry without a key, or that is neither put nor delete, rejects them all; so does a null in what decides that.
    """
    new = entries.filter(F.coalesce(F.col("seq") > cursor, F.lit(True)))
    valid = F.col("op").isin("put", "delete") & (F.length("key") > 0) & F.col("seq").isNotNull()
    b = new.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d"), F.sum((~F.coalesce(valid, F.lit(False))).cast("long")).alias("bad")).first()
    if not b["n"]:
        return new, 0, cursor
    if b["bad"]:
        raise InvalidKey(f"{b['bad']} entries have no seq or key, or are neither put nor delete")
    if b["low"] != cursor + 1:
        raise SequenceHole(f"{b['low']} follows {cursor}")
    if b["n"] != b["high"] - cursor or b["d"] != b["n"]:
        raise SequenceHole(f"entries after {cursor} up to {b['high']} have holes or repeats")
    return new, b["n"], b["high"]


def lag(latest: int | None, applied: int) -> int | None:
    """Entries behind the primary, never negative; unknown if the primary's latest seq is."""
    return None if latest is None else max(0, latest - applied)


class Journal:
    """A primary's journal. ``baseline`` is the seq that a promoted primary starts after.

    Each append is a folder that its first and last seq name, moved into place when it is whole; so the folders' names
    alone tell the bounds, and a read opens those folders only that its range meets.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        record = files.read_record(spark, f"{self.path}/BASELINE.json")
        self.baseline = record["seq"] if record else 0
        self.gate = threading.Lock()

    @property
    def entries_path(self) -> str:
        return f"{self.path}/entries"

    def parts(self) -> list[tuple[int, int, str]]:
        """(first, last, folder) of the appends, in order."""
        found = []
        for name in files.names(self.spark, self.entries_path):
            if m := re.fullmatch(r"seq-(\d+)-(\d+)", name):
                found.append((int(m[1]), int(m[2]), f"{self.entries_path}/{name}"))
        found.sort()
        for (_, last, _), (first, _, name) in zip(found, found[1:], strict=False):
            if first != last + 1:
                raise SequenceHole(f"{name} follows {last}")
        return found

    def bounds(self) -> tuple[int, int, int]:
        """First available seq (0 if there is none), latest seq (the baseline if there is none), entries."""
        found = self.parts()
        return (found[0][0], found[-1][1], found[-1][1] - found[0][0] + 1) if found else (0, self.baseline, 0)

    def entries(self, after: int = 0, to: int | None = None) -> DataFrame:
        """The entries with ``after`` < seq <= ``to``, from the folders that hold such."""
        met = [p for first, last, p in self.parts() if last > after and (to is None or first <= to)]
        if not met:
            return self.spark.createDataFrame([], JOURNAL)
        rows = self.spark.read.schema(JOURNAL).parquet(*met).filter(F.col("seq") > after)
        return rows if to is None else rows.filter(F.col("seq") <= to)

    def fence(self) -> str | None:
        """Why the journal takes no more writes: a quiesce that was begun or is done."""
        record = files.read_record(self.spark, f"{self.path}/FENCE.json")
        return record["state"] if record else None

    def set_fence(self, state: str) -> None:
        files.write_record(self.spark, f"{self.path}/FENCE.json", {"version": 1, "state": state})

    def _require_open(self) -> None:
        if state := self.fence():
            raise (NodeQuiesced if state == "quiesced" else QuiesceFailedFenced)(f"the journal takes no writes: {state}")

    def append(self, rows: DataFrame, part_rows: int = 1_000_000) -> int:
        """Appends (seq, op, key, value, timestamp) that continue the journal; they are there at once or not at all.

        The fence is looked at before the rows are written and again before they are moved into place.
        """
        with self.gate:
            self._require_open()
            latest = self.latest()
            new, count, top = fresh(rows.select(*JOURNAL.fieldNames()), latest)
            if not count:
                return latest
            if top == LAST_SEQ:
                raise InvalidOptions("the journal is full")
            parts = -(-count // part_rows)
            dealt = new.repartitionByRange(parts, "seq") if parts > 1 else new.coalesce(1)
            aside = f"{self.path}/aside-{uuid.uuid4().hex}"
            dealt.sortWithinPartitions("seq").write.parquet(aside)
            self._require_open()
            files.move(self.spark, aside, f"{self.entries_path}/seq-{latest + 1:020d}-{top:020d}")
            return top

    def latest(self) -> int:
        return self.bounds()[1]

    def check_gap(self, after: int) -> None:
        first, latest, _ = self.bounds()
        oplog.check_bounds(first, latest, after, self.baseline)

    def after(self, after: int, limit: int = oplog.DEFAULT_LIMIT) -> DataFrame:
        """The next ``limit`` entries in order; all of them for a limit of zero or less. Seqs are dense, so the limit is a range."""
        self.check_gap(after)
        return self.entries(after, after + limit if limit > 0 else None).orderBy("seq")

    def stats(self) -> dict[str, int]:
        first, latest, n = self.bounds()
        return {"first_available_seq": first, "latest_seq": latest, "entries": n, "baseline": self.baseline}

    def drop_before(self, seq: int) -> int:
        """Takes away the appends that end before ``seq``; the first seq that is left."""
        for _, last, path in self.parts():
            if last < seq:
                files.remove(self.spark, path)
        return self.bounds()[0]

    def set_baseline(self, seq: int) -> None:
        """A journal that starts after ``seq``. The same baseline again is no change; another one is a conflict."""
        if not 0 <= seq < LAST_SEQ:
            raise InvalidOptions(f"not a baseline: {seq}")
        known = files.read_record(self.spark, f"{self.path}/BASELINE.json")
        if known and known["seq"] != seq:
            raise InvalidOptions(f"the journal's baseline is {known['seq']}")
        if not known:
            first, _, n = self.bounds()
            if n and first != seq + 1:
                raise InvalidOptions("the journal's entries don't follow that baseline")
            files.write_record(self.spark, f"{self.path}/BASELINE.json", {"version": 1, "seq": seq})
        self.baseline = seq


class Cursor:
    """A follower's last applied seq, bound to who follows whom, never going back."""

    def __init__(self, spark: SparkSession, path: str, follower: str, primary: str) -> None:
        self.spark, self.path, self.follower, self.primary = spark, path, follower, primary
        record = files.read_record(spark, path)
        if record and (record["follower"], record["primary"]) != (follower, primary):
            raise InvalidOptions("the cursor belongs to another follower or primary")
        self.seq = record["last_applied_seq"] if record else 0

    def save(self, seq: int) -> None:
        if seq < self.seq:
            raise SequenceHole(f"the cursor can't go from {self.seq} back to {seq}")
        files.write_record(self.spark, self.path, {"version": 1, "follower": self.follower, "primary": self.primary, "last_applied_seq": seq, "updated_at": int(time.time())})
        self.seq = seq


@dataclass
class SyncResult:
    fetched: int
    applied: int
    last_applied: int
    lag: int | None


class Follower:
    """Applies a primary's journal to a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, name: str, primary: Journal) -> None:
        self.spark, self.path, self.primary, self.role = spark, path.rstrip("/"), primary, "follower"
        self.cursor = Cursor(spark, f"{self.path}/cursor.json", name, primary.path)
        self._busy = threading.Lock()

    def applied(self) -> DataFrame:
        """Rows beyond the cursor belong to a batch that wasn't finished and don't count yet.

        A batch has the folder that its first seq names, so one that runs twice is there once.
        """
        if not files.exists(self.spark, f"{self.path}/applied"):
            return self.spark.createDataFrame([], JOURNAL)
        rows = self.spark.read.schema(JOURNAL).option("recursiveFileLookup", "true").parquet(f"{self.path}/applied")
        return rows.filter(F.col("seq") <= self.cursor.seq)

    def scan(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return kv.scan(as_log(self.applied()), start, end)

    def get(self, key: str):
        row = kv.get(as_log(self.applied()), key).first()
        return None if row is None else row["value"]

    def apply(self, entries: DataFrame) -> int:
        """Applies what continues the cursor, and saves the cursor once for the whole batch."""
        if self.role != "follower":
            raise NotFollower(f"a {self.role} applies no entries")
        new, count, top = fresh(entries, self.cursor.seq)
        if count:
            new.write.mode("overwrite").parquet(f"{self.path}/applied/from-{self.cursor.seq + 1:020d}")
            self.cursor.save(top)
        return count

    def _exclusively(self, work):
        if not self._busy.acquire(blocking=False):
            raise SyncInProgress("another sync is running")
        try:
            return work()
        finally:
            self._busy.release()

    def sync(self, limit: int = oplog.DEFAULT_LIMIT) -> SyncResult:
        """One pull of at most ``limit`` entries."""

        def once() -> SyncResult:
            before = self.cursor.seq
            entries = self.primary.after(before, limit)
            latest = self.primary.latest()
            fetched = max(0, (min(latest, before + limit) if limit > 0 else latest) - before)  # seqs are dense
            return SyncResult(fetched, self.apply(entries), self.cursor.seq, lag(latest, self.cursor.seq))

        return self._exclusively(once)

    def stream(self, files_each: int = 1, timeout: float | None = None) -> SyncResult:
        """Catches up by a stream over the journal's files, a micro-batch for each ``files_each`` of them.

        The source lists files by time, which may swap two appends. So a batch stands for its last seq: what the journal
        holds from the cursor up to there is applied, in order, and a batch that came late has nothing left to add.
        """

        def upto(batch: DataFrame, _: int) -> None:
            top = batch.agg(F.max("seq")).first()[0]
            if top is not None and top > self.cursor.seq:
                self.apply(self.primary.entries(self.cursor.seq, top))

        def run() -> SyncResult:
            self.primary.check_gap(self.cursor.seq)
            before = self.cursor.seq
            if not self.primary.parts():
                return SyncResult(0, 0, before, lag(self.primary.latest(), before))
            source = self.spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_each).option("recursiveFileLookup", "true").parquet(self.primary.entries_path)
            query = source.writeStream.foreachBatch(upto).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination(timeout)
            if query.exception():
                raise query.exception()
            n = self.cursor.seq - before
            return SyncResult(n, n, self.cursor.seq, lag(self.primary.latest(), self.cursor.seq))

        return self._exclusively(run)


@dataclass
class Worker:
    """Syncs at once and then at intervals; after errors it waits longer each time, and a gap stops it for good."""

    follower: Follower
    interval: float = 1.0
    first_wait: float = 0.1
    most_wait: float = 5.0
    jitter: float = 0.2
    state: str = "idle"
    failures: int = 0
    last: SyncResult | None = None
    _stop: threading.Event = field(default_factory=threading.Event)

    def wait_after(self, failures: int, chance: float | None = None) -> float:
        """Doubles from ``first_wait`` to ``most_wait``, with up to a ``jitter`` share on top."""
        base = min(self.most_wait, self.first_wait * 2 ** max(0, failures - 1))
        return base * (1 + self.jitter * (random.random() if chance is None else chance))

    def step(self) -> float | None:
        """One attempt: how long to wait for the next, or None after a gap."""
        try:
            self.last, self.failures, self.state = self.follower.sync(), 0, "healthy"
        except SyncInProgress:
            return self.interval
        except ReplicationGap:
            self.state = "blocked"
            return None
        except Exception:
            self.failures, self.state = self.failures + 1, "backing_off"
            return self.wait_after(self.failures)
        return self.interval

    def run(self) -> None:
        while not self._stop.is_set():
            wait = self.step()
            if wait is None or self._stop.wait(wait):
                return

    def stop(self) -> None:
        self._stop.set()


class Handover:
    """The planned change of primaries: the old one is quiesced, then a follower that has everything is promoted.

    Records are files; each step may be repeated. Intent, then the final record, then the intent goes. A promotion
    needs the operator's word, the record of the quiesced primary, and a cursor exactly at its last seq.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> dict | None:
        return files.read_record(self.spark, f"{self.path}/{name}.json")

    def _write(self, name: str, record: dict) -> dict:
        files.write_record(self.spark, f"{self.path}/{name}.json", record)
        return record

    def quiesce(self, journal: Journal, primary: str) -> dict:
        """Fences the journal, waits for a write that is under way, and records the last seq. Repeats give the same record."""
        if done := self._read("quiesced"):
            journal.set_fence("quiesced")
            files.remove(self.spark, f"{self.path}/intent.json")
            return done
        self._write("intent", {"version": 1, "primary": primary})
        journal.set_fence("quiesce_failed_fenced")
        with journal.gate:
            record = self._write("quiesced", {"version": 1, "primary": primary, "path": journal.path, "last_seq": journal.latest()})
        journal.set_fence("quiesced")
        files.remove(self.spark, f"{self.path}/intent.json")
        return record

    def may_write(self) -> bool:
        """A primary with an intent or a final record takes no more writes; its journal's fence sees to that."""
        return self._read("intent") is None and self._read("quiesced") is None

    def promote(self, follower: Follower, quiesced: dict, journal_path: str, confirmed: bool) -> Journal:
        if not confirmed:
            raise PromotionNotReady("a promotion needs the operator's confirmation")
        if quiesced != self._read("quiesced"):
            raise PromotionRecordInvalid("that isn't the quiesced primary's record")
        if quiesced["path"] != follower.primary.path:
            raise PromotionSourceMismatch("the follower follows another primary")
        if (others := [n for n in self.promoted() if n != follower.cursor.follower]):
            raise AlreadyPromoted(f"{others[0]} was promoted already")
        durable = Cursor(self.spark, follower.cursor.path, follower.cursor.follower, follower.cursor.primary).seq
        if not durable == follower.cursor.seq == quiesced["last_seq"]:
            raise PromotionSequenceMismatch(f"the follower is at {durable}, the primary stopped at {quiesced['last_seq']}")
        journal = Journal(self.spark, journal_path)
        journal.set_baseline(quiesced["last_seq"])
        self._write(f"promoted-{follower.cursor.follower}", {"version": 1, "node": follower.cursor.follower, "baseline": quiesced["last_seq"]})
        follower.role = "primary"
        return journal

    def promoted(self) -> list[str]:
        return [m[1] for n in files.names(self.spark, self.path) if (m := re.fullmatch(r"promoted-(.+)\.json", n))]

    def role(self, node: str, configured: str) -> str:
        """What a node is when it starts: a promotion outranks quiescing, which outranks the configuration."""
        if self._read(f"promoted-{node}"):
            return "primary"
        for name, role in (("quiesced", "quiesced"), ("intent", "quiesce_failed_fenced")):
            if (r := self._read(name)) and r["primary"] == node:
                return role
        return configured
