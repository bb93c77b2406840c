"""Ordered, idempotent replication: batches, streams, cursors, gaps, handover."""

import pytest
from pyspark.sql import functions as F

from marlstone.model import CorruptRecord, InvalidOptions, NotFollower, NotLeader, ReplicationGap, SequenceHole
from marlstone.operators.replica import ReplicaSet
from marlstone.sources import files, oplog
from marlstone.streaming.replication import Cursor, Follower, Handover, Journal, Worker, lag


def entries(spark, *seqs, value="v"):
    return spark.createDataFrame([(s, "put", f"k{s % 5}", f"{value}{s}") for s in seqs], "seq bigint, op string, key string, value string").withColumn("timestamp", F.lit(0).cast("timestamp"))


@pytest.fixture
def pair(spark):
    root = files.scratch(spark, "repl")
    journal = Journal(spark, f"{root}/primary")
    return root, journal, Follower(spark, f"{root}/follower", "f", journal)


def test_sync_applies_in_order_and_once(spark, pair):
    root, journal, follower = pair
    journal.append(entries(spark, *range(1, 11)))
    r = follower.sync(limit=4)
    assert (r.fetched, r.applied, r.last_applied, r.lag) == (4, 4, 4, 6)
    assert follower.apply(entries(spark, 3, 4)) == 0
    with pytest.raises(SequenceHole):
        follower.apply(entries(spark, 7, 8))
    with pytest.raises(SequenceHole):
        follower.apply(entries(spark, 5, 7))
    assert follower.sync().lag == 0 and follower.get("k0") == "v10"
    again = Follower(spark, f"{root}/follower", "f", journal)
    assert again.cursor.seq == 10 and again.scan().count() == 5


def test_stream_catches_up_and_restarts(spark, pair):
    root, journal, follower = pair
    journal.append(entries(spark, *range(1, 6)))
    journal.append(entries(spark, *range(6, 9)))
    assert follower.stream().last_applied == 8
    journal.append(entries(spark, 9))
    assert Follower(spark, f"{root}/follower", "f", journal).stream().applied == 1
    with pytest.raises(SequenceHole):
        journal.append(entries(spark, 12))


def test_gap(spark):
    log = entries(spark, 5, 6)
    oplog.check_gap(log, 4)
    with pytest.raises(ReplicationGap) as e:
        oplog.check_gap(log, 3)
    assert (e.value.requested_after, e.value.first_available_seq, e.value.latest_seq) == (3, 5, 6)
    oplog.check_gap(log.filter("seq < 0"), 0)
    with pytest.raises(ReplicationGap):
        oplog.check_gap(log.filter("seq < 0"), 3, baseline=9)


def test_cursor_is_bound_and_monotonic(spark):
    path = f"{files.scratch(spark, 'cursor')}/c.json"
    c = Cursor(spark, path, "f", "p")
    c.save(5)
    with pytest.raises(SequenceHole):
        c.save(4)
    with pytest.raises(InvalidOptions):
        Cursor(spark, path, "other", "p")
    files.write_text(spark, path, files.read_text(spark, path).replace('"last_applied_seq": 5', '"last_applied_seq": 6'))
    with pytest.raises(CorruptRecord):
        Cursor(spark, path, "f", "p")


def test_handover(spark, pair):
    root, journal, follower = pair
    journal.append(entries(spark, 1, 2, 3))
    h = Handover(spark, f"{root}/handover")
    assert h.may_write() and h.role("p", "primary") == "primary"
    record = h.quiesce(journal, "p")
    assert h.quiesce(journal, "p") == record and not h.may_write() and h.role("p", "primary") == "quiesced"
    for confirmed in (False, True):
        with pytest.raises(InvalidOptions):
            h.promote(follower, record, f"{root}/new", confirmed)
    follower.sync()
    new = h.promote(follower, record, f"{root}/new", True)
    assert new.baseline == 3 and new.stats()["latest_seq"] == 3 and h.role("f", "follower") == "primary"
    new.set_baseline(3)
    with pytest.raises(InvalidOptions):
        new.set_baseline(4)
    with pytest.raises(NotFollower):
        follower.apply(entries(spark, 4))
    assert new.append(entries(spark, 4)) == 4


def test_worker(spark, pair):
    _, journal, follower = pair
    journal.append(entries(spark, 1))
    w = Worker(follower)
    assert w.step() == w.interval and w.state == "healthy"
    assert [w.wait_after(n, 0) for n in (1, 2, 3, 99)] == [0.1, 0.2, 0.4, 5.0] and w.wait_after(1, 1) == pytest.approx(0.12)
    follower.primary = Journal(spark, journal.path + "-x")
    follower.primary.set_baseline(50)
    assert w.step() is None and w.state == "blocked"
    assert lag(None, 3) is None and lag(2, 3) == 0


def test_replica_set(spark):
    s = ReplicaSet(spark, 3)
    s.put("a", "1")
    s.delete("a")
    s.put("b", "2")
    assert s.replicate_once() == 2 and s.get("a", "follower", 1) == "1" and s.get("a") is None
    s.pause(2)
    s.replicate_all()
    assert [r["lag"] for r in s.status().orderBy("replica").collect()] == [0, 0, 2] and s.stats()["applied_index"] == 1
    assert s.scan(mode="any", replica=-1).count() == 1 and s.scan(mode="any", replica=2).first()["key"] == "a"
    for call in (lambda: s.pause(0), lambda: s.get("a", "follower", 0), lambda: s.set_batch(0, 1)):
        with pytest.raises(NotLeader):
            call()


def test_a_quiesced_journal_takes_no_writes(spark, pair):
    from marlstone.model import NodeQuiesced, QuiesceFailedFenced

    root, journal, _ = pair
    journal.append(entries(spark, 1))
    h = Handover(spark, f"{root}/handover")
    h._write("intent", {"version": 1, "primary": "p"})
    journal.set_fence("quiesce_failed_fenced")
    with pytest.raises(QuiesceFailedFenced):
        journal.append(entries(spark, 2))
    assert h.quiesce(journal, "p")["last_seq"] == 1
    for j in (journal, Journal(spark, journal.path)):
        with pytest.raises(NodeQuiesced):
            j.append(entries(spark, 2))
    assert journal.latest() == 1


def test_a_fence_that_falls_during_an_append_stops_it(spark, pair, monkeypatch):
    from marlstone.model import StoreError

    _, journal, _ = pair
    states = iter([None, "quiesced"])
    monkeypatch.setattr(journal, "fence", lambda: next(states))
    with pytest.raises(StoreError):
        journal.append(entries(spark, 1))
    assert journal.latest() == 0


def test_nulls_stay_out_of_a_journal(spark, pair):
    from marlstone.model import InvalidKey

    _, journal, _ = pair
    for bad in [(1, None, "k", "v"), (1, "put", None, "v"), (1, "put", "", "v"), (None, "put", "k", "v"), (1, "set", "k", "v")]:
        rows = spark.createDataFrame([bad], "seq bigint, op string, key string, value string").withColumn("timestamp", F.lit(0).cast("timestamp"))
        with pytest.raises(InvalidKey):
            journal.append(rows)
    assert journal.latest() == 0 and journal.parts() == []


def test_files_that_a_stream_lists_late_do_no_harm(spark, pair):
    import os
    import time

    root, journal, follower = pair
    for a in (1, 4, 7):
        journal.append(entries(spark, *range(a, a + 3)))
    folder = journal.entries_path.removeprefix("file://")
    for age, name in enumerate(sorted(os.listdir(folder))):  # the newest append looks like the oldest
        for f in os.listdir(f"{folder}/{name}"):
            os.utime(f"{folder}/{name}/{f}", (time.time() - 100 * age, time.time() - 100 * age))
    r = follower.stream()
    assert (r.applied, r.last_applied, r.lag) == (9, 9, 0) and follower.applied().count() == 9


def test_journal_reads_the_parts_it_needs(spark, pair):
    _, journal, follower = pair
    for a in (1, 4, 7):
        journal.append(entries(spark, *range(a, a + 3)))
    assert [r["seq"] for r in journal.after(4, 3).collect()] == [5, 6, 7] and len(journal.entries(3, 6).inputFiles()) == 1
    assert journal.drop_before(5) == 4 and journal.stats() == {"first_available_seq": 4, "latest_seq": 9, "entries": 6, "baseline": 0}
    with pytest.raises(ReplicationGap):
        follower.sync()


def test_one_promotion_only(spark, pair):
    from marlstone.model import AlreadyPromoted

    root, journal, follower = pair
    journal.append(entries(spark, 1))
    h = Handover(spark, f"{root}/handover")
    record = h.quiesce(journal, "p")
    other = Follower(spark, f"{root}/other", "g", journal)
    follower.sync()
    other.sync()
    h.promote(follower, record, f"{root}/new", True)
    with pytest.raises(AlreadyPromoted):
        h.promote(other, record, f"{root}/new2", True)


def test_replica_set_reopens(spark):
    path = files.scratch(spark, "replicas")
    s = ReplicaSet(spark, 3, path)
    s.put("a", "1")
    s.write(spark.createDataFrame([("b", "2", 1, 1), ("a", None, 2, 2)], "key string, value string, kind int, order int"))
    s.pause(2)
    s.replicate_once()
    # what a failed write left behind isn't in the commit record
    s.log().write.parquet(f"{path}/log-orphan")
    again = ReplicaSet(spark, 3, path)
    assert again.commit == 3 and [r.applied for r in again.replicas] == [3, 1, 0] and not again.replicas[2].paused
    assert again.get("a", "follower", 1) == "1" and again.get("a") is None
    again.replicate_all()
    again.flush()
    again.compact()
    assert again.stats() == {"replicas": 3, "commit_index": 3, "applied_index": 3, "log_entries": 1} and ReplicaSet(spark, 3, path).get("b", "follower", 2) == "2"
    with pytest.raises(InvalidOptions):
        ReplicaSet(spark, 2, path)


def test_nodes_hand_over(spark):
    from marlstone.model import NodeQuiesced
    from marlstone.operators.node import Node

    root = files.scratch(spark, "nodes")
    h = Handover(spark, f"{root}/handover")
    p = Node(spark, f"{root}/p", "p", "primary", handover=h)
    p.put("a", "1")
    p.put("b", "2")
    p.delete("a")
    f = Node(spark, f"{root}/f", "f", "follower", p.journal, h)
    assert f.handle("PUT", "/kv/x", {"value": "1"})[0] == 403 and f.handle("POST", "/replication/sync")[1]["lag"] == 0
    assert f.get("a") is None and f.get("b") == "2" and f.handle("GET", "/scan")[1]["entries"] == [{"key": "b", "value": "2", "seq": 2}]
    assert [e["seq"] for e in p.handle("GET", "/replication/log", query={"after": "1"})[1]["entries"]] == [2, 3]
    status, record = p.handle("POST", "/replication/quiesce")
    assert status == 200 and p.handle("PUT", "/kv/c", {"value": "3"})[0] == 503
    with pytest.raises(NodeQuiesced):
        Node(spark, f"{root}/p", "p", "primary", handover=h).put("c", "3")
    assert f.handle("POST", "/replication/promote", {"record": record})[0] == 409
    assert f.handle("POST", "/replication/promote", {"record": record, "confirm": True})[1]["baseline"] == 3
    f.put("c", "3")
    f.delete("b")
    assert [r["key"] for r in f.scan().collect()] == ["c"] and f.journal.latest() == 5
    assert f.handle("POST", "/explain/put", {"key": "d", "value": "4"})[0] == 200 and f.journal.latest() == 6
    assert f.handle("GET", "/nope")[0] == 404 and f.handle("POST", "/scan")[0] == 405
