"""Key-value, vector, ring, sharding, what-if, trace, Bloom and workload semantics on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import bloom, ring
from marlstone.functions.hashing import fnv1a64, fnv1a64_column, signed
from marlstone.model import Closed, CorruptRecord, InvalidKey, InvalidOptions, InvalidVector, ShardMismatch
from marlstone.operators import dashboard, explain, kv, ops, shard, vector, workload
from marlstone.sources import cluster, files, oplog
from marlstone.sources.store import Store, validate_manifest

LOG = "key string, value string, seq bigint, kind tinyint"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 2, 1), ("a", "3", 3, 1), ("b", None, 4, 2), ("c", "", 5, 1), ("d", None, 6, 2), ("b2", "x", 7, 1)], LOG)


def test_scan_keeps_newest_and_hides_deletes(log):
    assert rows(kv.scan(log), "key", "value", "seq") == [("a", "3", 3), ("b2", "x", 7), ("c", "", 5)]


def test_scan_bounds(log):
    assert rows(kv.scan(log, "b", "c"), "key") == [("b2",)]
    assert rows(kv.scan(log, "", None), "key") == [("a",), ("b2",), ("c",)]


def test_get_agrees_with_scan(log):
    live = {k: v for k, v in rows(kv.scan(log), "key", "value")}
    for k in ["a", "b", "b2", "c", "d", "nope", ""]:
        got = kv.get(log, k).first()
        assert (got["value"] if got else None) == live.get(k)


def test_byte_order(spark):
    df = spark.createDataFrame([(bytearray(k), bytearray(b"v"), i, 1) for i, k in enumerate([b"\x80", b"\x7f\x00", b"\x00", b"\x7f"])], "key binary, value binary, seq bigint, kind tinyint")
    assert [bytes(r["key"]) for r in kv.scan(df).collect()] == [b"\x00", b"\x7f", b"\x7f\x00", b"\x80"]


def test_empty_key_is_refused():
    with pytest.raises(InvalidKey):
        kv.put(b"", b"v", 1)


def test_store_survives_flush_reopen_and_compaction(spark):
    path = files.scratch(spark, "t")
    s = Store(spark, path)
    s.put(b"x", b"0")
    s.put(b"a", b"old")
    s.put(b"gone", b"1")
    s.flush()
    s.put(b"a", b"new")
    s.delete(b"gone")
    want = [(b"a", b"new"), (b"x", b"0")]
    for step in ("written", "reopened", "flushed", "compacted", "again"):
        if step in ("reopened", "again"):
            s = Store(spark, path)
        if step == "flushed":
            s.flush()
        if step == "compacted":
            s.compact()
            assert len(s.manifest["segments"]) == 1
        assert [(bytes(r["key"]), bytes(r["value"])) for r in s.scan().collect()] == want, step
        assert s.get(b"a") == b"new" and s.get(b"gone") is None and s.get(b"") is None
    s.delete(b"a")
    s.delete(b"x")
    s.flush()
    s.compact()
    assert s.manifest["segments"] == [] and s.scan().isEmpty()
    s.close()
    with pytest.raises(Closed):
        s.get(b"a")


def test_manifest_validation():
    good = {"version": 1, "next_id": 2, "next_seq": 5, "segments": [{"id": 1, "path": "p", "count": 1, "min_key": "YQ==", "max_key": "Yg=="}]}
    assert validate_manifest(good)
    for change in ({"version": 2}, {"next_seq": 0}, {"segments": good["segments"] * 2}, {"segments": [good["segments"][0] | {"path": "../x"}]}, {"segments": [good["segments"][0] | {"min_key": "Yw=="}]}, {"segments": [good["segments"][0] | {"min_key": "%"}]}):
        with pytest.raises(CorruptRecord):
            validate_manifest(good | change)


def test_oplog_detects_damage_and_holes(spark, tmp_path, log):
    oplog.append(log, f"file://{tmp_path}/log")
    assert oplog.replay(spark, f"file://{tmp_path}/log").count() == 7
    damaged = spark.read.parquet(f"file://{tmp_path}/log").withColumn("value", F.lit("z"))
    damaged.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(CorruptRecord):
        oplog.replay(spark, f"file://{tmp_path}/bad")
    seqs = spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 5, 70000)], "seq bigint")
    assert sorted(rows(oplog.holes(seqs), "seq", "previous")) == [(4, 2), (5, 5), (70000, 5)]


VEC = "id string, vector array<float>"


@pytest.mark.parametrize(("metric", "vectors", "order"), [
    ("cosine", {"a": [1, 0, 0, 0], "b": [0, 1, 0, 0], "c": [-1, 0, 0, 0]}, ["a", "b", "c"]),
    ("l2", {"exact": [1, 0, 0, 0], "close": [1, 1, 0, 0], "far": [0, 0, 0, 0]}, ["exact", "close", "far"]),
    ("dot", {"high": [5, 0, 0, 0], "mid": [2, 0, 0, 0], "low": [1, 0, 0, 0]}, ["high", "mid", "low"]),
    ("cosine", {"z": [1, 0, 0, 0], "a": [1, 0, 0, 0], "m": [1, 0, 0, 0]}, ["a", "m", "z"]),
])
def test_search_order(spark, metric, vectors, order):
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], VEC)
    assert [r["id"] for r in vector.search(df, [1.0, 0.0, 0.0, 0.0], 100, metric).collect()] == order


def test_zero_vector_scores_lowest(spark):
    df = spark.createDataFrame([("z", [0.0, -0.0]), ("n", [-1.0, 0.0])], VEC)
    assert rows(vector.search(df, [1.0, 0.0], 5), "id", "score", "distance") == [("n", -1.0, 2.0), ("z", -1.0, 2.0)]


def test_vector_store(spark):
    s = vector.VectorStore(spark, 2)
    s.upsert("a", [1, 0], b"m")
    s.upsert("a", [0, 1])
    s.upsert("b", [1, 1])
    s.delete("b")
    s.delete("never")
    assert s.count() == 1 and s.get("a")["vector"] == [0.0, 1.0] and s.get("b") is None
    s.compact()
    assert [r["id"] for r in s.search([0, 1], 3).collect()] == ["a"]
    assert explain.explain_search(s, [0, 1], 3).with_status("ok")[1].metadata["hits"] == "1"
    for bad in (("", [1, 0]), ("a/b", [1, 0]), ("a\n", [1, 0]), ("a", [1]), ("a", [float("nan"), 0]), ("a", [float("inf"), 0]), ("a", [0, 0])):
        with pytest.raises(InvalidVector):
            s.upsert(*bad)
    with pytest.raises(InvalidOptions):
        s.search([0, 1], 0)
    with pytest.raises(InvalidOptions):
        vector.VectorStore(spark, 2, namespace="a_b")


def test_search_many_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "MOST_QUERIES", 7, raising=False)
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 7, raising=False)
    points = {i: [float(i % 7 - 3), float(i * i % 11 - 5), float(i % 5)] for i in range(60)}
    table = spark.createDataFrame([(str(i), v) for i, v in points.items()], VEC)
    queries = spark.createDataFrame([(i, points[i]) for i in range(0, 60, 2)], "query_id bigint, query array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vector.search_many(table, queries, 3, "dot").collect()}
    for q in range(0, 60, 2):
        best = sorted((-sum(x * y for x, y in zip(points[q], v, strict=True)), str(i)) for i, v in points.items())[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -d) for d, i in best]
    assert len(got) == 90


def test_fnv_and_routes(spark):
    keys = {"user:1": ("f7fd9aaa75081ceb", "node-2"), "user:2": ("f7fd9baa75081e9e", "node-2"), "order:9": ("deb8789f34999fea", "node-1"), "item:42": ("77ef156bbd2f64d6", "node-3"), "session:abc": ("e3263ff97b271d79", "node-1")}
    nodes = ring.node_ring([("node-3", 1), ("node-1", 1), ("node-2", 1)])
    df = ring.route(spark.createDataFrame([(k,) for k in keys] + [("",), (None,)], "key string"), F.col("key"), nodes).withColumn("h", fnv1a64_column(F.col("key")))
    got = {r["key"]: (r["h"], r["owner"]) for r in df.collect()}
    for k, (h, node) in keys.items():
        assert fnv1a64(k) == int(h, 16) and got[k] == (signed(int(h, 16)), node) and nodes.owner(k) == node
    assert got[""] == (None, None) and got[None] == (None, None)
    assert all(nodes.without("node-2").owner(k) == "node-1" for k in ("user:1", "user:2", "order:9"))
    with pytest.raises(InvalidKey):
        nodes.owner("")


def test_ring_join_equals_driver(spark):
    r = ring.shard_ring(5, 16)
    df = ring.route(spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")), F.col("key"), r)
    assert all(row["owner"] == r.owner(row["key"]) for row in df.collect())


def test_weights():
    r = ring.node_ring([("a", 3), ("b", 1)], 256)
    assert len(r.points) == 1024
    assert sum(r.owner(f"key-{i}") == "a" for i in range(2000)) >= 1100
    for bad in ([], [("", 1)], [("a", 1), ("a", 1)]):
        with pytest.raises(InvalidOptions):
            ring.node_ring(bad)


def test_failure_and_rebalance(spark):
    keys = spark.range(500).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    r = ring.node_ring([("n1", 1), ("n2", 1), ("n3", 1)])
    s = ops.failure_summary(ops.simulate_failure(keys, r, ["n2"])).first()
    assert s["moved_keys"] == 0 and s["unavailable_keys"] == 0 and s["affected_keys"] == sum(r.owner(f"key-{i}") == "n2" for i in range(500))
    assert ops.failure_summary(ops.simulate_failure(keys, r, ["n1", "n2", "n3"])).first()["unavailable_keys"] == 500
    plan = ops.plan_rebalance(keys, r, r.without("n2"))
    assert plan.filter("moved").count() == s["affected_keys"]
    health = ops.check_health(spark, ["b", "a"], lambda n: (200, "ok") if n == "a" else (500, "down"))
    assert rows(health, "node", "healthy") == [("a", True), ("b", False)]


def test_sharded_store(spark):
    path = files.scratch(spark, "shards")
    s = shard.ShardedStore(spark, path, 3)
    s.write(workload.operations(spark, 60, 8))
    s.delete(workload.key(3).encode())
    assert s.get(workload.key(4).encode()) == workload.value(4, 8) and s.get(workload.key(3).encode()) is None
    s.flush()
    assert s.scan().count() == 59 and s.stats()["total"]["live_keys"] == 59
    assert shard.ShardedStore(spark, path).scan(b"key-0000000010", b"key-0000000020").count() == 10
    with pytest.raises(ShardMismatch):
        shard.ShardedStore(spark, path, 4)
    with pytest.raises(InvalidKey):
        s.get(b"")


def test_bloom(spark):
    assert bloom.size(1000, 0.01) == (9586, 7)
    keys = workload.operations(spark, 500, 1).select("key")
    b = bloom.Bloom.from_bytes(bloom.build(keys, "key", 500, 0.01).to_bytes())
    assert b.added == 500 and all(b.might_contain(workload.key(i).encode()) for i in range(500))
    assert sum(b.might_contain(f"no-{i}".encode()) for i in range(2000)) < 60
    with pytest.raises(CorruptRecord):
        bloom.Bloom.from_bytes(b.to_bytes()[:-1] + b"\x00")


def test_cluster_config(tmp_path):
    c = cluster.Cluster.default()
    again = cluster.Cluster.parse(c.to_json()).validate()
    assert again.ring().owner("user:1") == "node-2" and again.ring("node-2").owner("user:1") == "node-1"
    (tmp_path / "c.json").write_text(json.dumps(json.loads(c.to_json()) | {"unknown": 1}))
    assert cluster.Cluster.load(str(tmp_path / "c.json")).name == "local"
    for spoil in (lambda x: x.nodes.append(x.nodes[0]), lambda x: setattr(x.scope, "no_raft", False), lambda x: setattr(x, "algorithm", "other"), lambda x: setattr(x.nodes[0].replication, "role", "king")):
        bad = cluster.Cluster.default()
        spoil(bad)
        with pytest.raises(InvalidOptions):
            bad.validate()


def test_scenarios_pass(spark):
    for scenario in (dashboard.pause_scenario, dashboard.lag_scenario, dashboard.catchup_scenario):
        assert scenario(spark)["passed"]
    parts = [dashboard.component("engine", "e", {"a": 1})]
    assert dashboard.snapshot(spark, parts).first()["stats"] == {"a": "1"} and "<table>" in dashboard.render("t", parts, ["<e>"])


def test_traces(spark):
    s = Store(spark, files.scratch(spark, "trace"))
    assert explain.explain_put(s, b"k", b"v").of_component("delta")[0].metadata["bytes"] == "1"
    assert explain.explain_get(s, b"k").steps[-1].status == "hit"
    explain.explain_delete(s, b"k")
    merged = explain.explain_scan(s).steps[-1].metadata
    assert (merged["entries"], merged["live"], merged["suppressed"]) == ("2", "0", "2")
    t = explain.explain_get(s, b"k")
    assert t.steps[-1].status == "miss" and t.rows(spark).count() == len(t.steps) and "GET" in str(t) and json.loads(t.to_json())["operation"] == "GET"


def test_percentiles(spark):
    assert workload.percentile(list(range(10)), 95) == 8 and workload.percentile([], 50) == 0
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    assert tuple(workload.percentiles(df, "v", [0, 50, 95, 100]).first()) == (0.0, 4.0, 8.0, 9.0)


@pytest.mark.parametrize("name", ["write-heavy", "read-heavy", "mixed", "scan", "compaction", "restart"])
def test_workloads_run(spark, name):
    assert workload.run(spark, files.scratch(spark, "work"), name)["operations"] > 0


def test_store_gives_each_operation_a_seq(spark):
    s = Store(spark, files.scratch(spark, "seqs"))
    ops = spark.createDataFrame([("b", "1", 1, 3), ("a", "1", 1, 1), ("b", None, 2, 4), ("c", "", 1, 2)], "key string, value string, kind int, order int")
    assert s.write(ops) == 4 and s.write(ops.filter("key = 'a'")) == 1
    assert sorted((r["seq"], bytes(r["key"]).decode(), r["kind"]) for r in s.log().collect()) == [(1, "a", 1), (2, "c", 1), (3, "b", 1), (4, "b", 2), (5, "a", 1)]
    for bad in [(None, "1", 1, 1), ("", "1", 1, 1), ("a", None, 1, 1), ("a", "1", None, 1), ("a", "1", 3, 1)]:
        with pytest.raises(InvalidKey):
            s.write(ops.union(spark.createDataFrame([bad], ops.schema)))
    assert s.manifest["next_seq"] == 6 and s.write(ops.filter("false")) == 0


def test_numbering_over_many_ranges(spark):
    from marlstone.functions.ranking import number_in_order

    for each in (400, 5000):
        path = f"{files.scratch(spark, 'numbers')}/t"
        rows_ = spark.range(5000).withColumn("o", F.pmod(F.xxhash64("id"), F.lit(900)))
        got = [(r["o"], r["id"], r["seq"]) for r in number_in_order(rows_, ["o", "id"], path, 5000, 11, each=each).orderBy("seq").collect()]
        assert [s for _, _, s in got] == list(range(11, 5011)) and got == sorted(got)


def test_log_refuses_what_it_cannot_tell(spark, log):
    from marlstone.sources.oplog import OpLog

    path = f"{files.scratch(spark, 'nulls')}/log"
    for bad in [("a", "1", 1, None), (None, "1", 1, 1), ("a", "1", None, 1), ("", "1", 1, 1)]:
        with pytest.raises(InvalidKey):
            oplog.append(spark.createDataFrame([bad], LOG), path)
    oplog.append(log, path)
    spark.read.parquet(path).withColumn("crc", F.when(F.col("seq") != 3, F.col("crc"))).write.parquet(f"{path}-null")
    with pytest.raises(CorruptRecord):
        oplog.replay(spark, f"{path}-null")
    own = OpLog(spark, f"{path}-own")
    assert own.append(log.withColumnRenamed("seq", "order")) == 7 and OpLog(spark, f"{path}-own").seq == 7


def test_holes_behind_empty_blocks(spark):
    seqs = [1, 2, 3, 9, 10, 11, 12, 40, 41, 90]
    got = oplog.holes(spark.createDataFrame([(s,) for s in seqs], "seq bigint"), block=4)
    assert sorted(rows(got, "seq", "previous")) == [(9, 3), (40, 12), (90, 41)]


def test_segment_wants_unique_keys(spark, log):
    from marlstone.sources.store import Segment

    path, binary = files.scratch(spark, "segment"), log.withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary"))
    for bad in (binary, binary.filter("false")):
        with pytest.raises(InvalidOptions):
            Segment.create(bad, f"{path}/bad")
    s = Segment.create(kv.merge_latest(binary), f"{path}/good")
    assert s.get(b"b").first()["kind"] == 2 and s.get(b"zz").isEmpty() and s.metadata().first()["count"] == 5
    assert all(s.may_contain(k) for k in (b"a", b"b", b"c")) and not all(s.may_contain(f"no-{i}".encode()) for i in range(20))


def test_search_wants_the_dimension(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None), ("d", [1.0, None]), ("e", [float("nan"), 1.0]), ("f", [])], VEC)
    for metric in vector.METRICS:
        assert [r["id"] for r in vector.search(df, [1.0, 2.0], 9, metric).collect()] == ["a"]
        many = vector.search_many(df, spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query array<float>"), 9, metric)
        assert [r["id"] for r in many.collect()] == ["a"]
    with pytest.raises(InvalidVector):
        vector.search(df, [1.0], 9, dimension=2)
    with pytest.raises(InvalidVector):
        vector.search_many(df, spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "query_id int, query array<float>"), 9)
    assert vector.search_many(df, spark.createDataFrame([], "query_id int, query array<float>"), 9).count() == 0


def test_search_many_breaks_ties_by_id(spark):
    same = [0.1 * i - 0.3 for i in range(7)]
    df = spark.createDataFrame([(f"{i:03d}", same if i % 3 else [x + 1 for x in same]) for i in range(300)], VEC)
    for metric in vector.METRICS:
        got = vector.search_many(df, spark.createDataFrame([(1, same)], "query_id int, query array<float>"), 12, metric).orderBy("rank").collect()
        want = vector.search(df, same, 12, metric).collect()
        assert [r["id"] for r in got] == [r["id"] for r in want]


def test_vector_store_reopens(spark):
    path = files.scratch(spark, "vectors")
    s = vector.VectorStore(spark, 2, "l2", "ns", path)
    s.upsert_all(spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], bytearray(b"m"))], "id string, vector array<float>, metadata binary"))
    s.flush()
    s.upsert("a", [5, 5])
    s.close()
    with pytest.raises(Closed):
        s.upsert("c", [1, 1])
    s = vector.VectorStore(spark, 2, "l2", "ns", path)
    assert s.get("a")["vector"] == [5.0, 5.0] and s.get("b")["metadata"] == b"m" and s.count() == 2
    assert vector.VectorStore(spark, 2, "l2", "other", path).count() == 0
    s.delete("a")
    s.flush()
    s.compact()
    assert [r["id"] for r in vector.VectorStore(spark, 2, "l2", "ns", path).live().collect()] == ["b"]
    with pytest.raises(InvalidVector):
        s.upsert_all(spark.createDataFrame([("x", [1.0], None)], "id string, vector array<float>, metadata binary"))
    assert explain.explain_upsert(s, "z", [1, 2]).steps[-1].metadata == {"index_size": "2"}
    assert explain.explain_vector_delete(s, "z").steps[1].metadata["existed"] == "True"


def test_codecs(spark, tmp_path):
    from marlstone.sources import codecs

    frames = [(1, 1, b"a", b"x"), (2, 2, b"a", b""), (3, 1, b"k\x00", b"")]
    raw = b"".join(codecs.encode_frame(*f) for f in frames)
    assert list(codecs.decode_frames(raw)) == frames and list(codecs.decode_frames(raw[:-3])) == frames[:2] and list(codecs.decode_frames(raw + b"\x01")) == frames
    with pytest.raises(CorruptRecord):
        list(codecs.decode_frames(raw[:-1] + b"\x07"))
    (tmp_path / "wal").write_bytes(raw)
    assert [(r["seq"], r["kind"], bytes(r["key"]), r["value"] and bytes(r["value"])) for r in codecs.read_frames(spark, f"file://{tmp_path}/wal").orderBy("seq").collect()] == [(1, 1, b"a", b"x"), (2, 2, b"a", None), (3, 1, b"k\x00", bytearray(b""))]
    record = codecs.encode_vector([1.5, -2.0], b"meta")
    vector_, meta = codecs.decode_vector(record, 2)
    assert vector_.tolist() == [1.5, -2.0] and meta == b"meta" and len(record) == 42 and record[:8] == b"CEVDRAHS"
    for bad in (record + b"x", record[:-1], b"\x00" + record[1:], record[:20] + b"\xff" + record[21:]):
        with pytest.raises(CorruptRecord):
            codecs.decode_vector(bad, 2)
    with pytest.raises(CorruptRecord):
        codecs.decode_vector(record, 3)


def test_explain_get_steps(spark):
    s = Store(spark, files.scratch(spark, "steps"))
    for part in (["a", "b", "c"], ["x", "y", "z"], ["b", "m"]):
        for k in part:
            s.put(k.encode(), k.encode())
        if "a" in part:
            s.delete(b"c")
        s.flush()
    s.put(b"q", b"1")
    steps = lambda k: [x.step_type for x in explain.explain_get(s, k).steps[1:]]
    assert steps(b"q") == ["MEMTABLE_HIT"]
    assert steps(b"b") == ["MEMTABLE_MISS", "BLOOM_CHECK", "SSTABLE_HIT"]
    assert steps(b"a") == ["MEMTABLE_MISS", "BOUNDS_SKIP", "BOUNDS_SKIP", "BLOOM_CHECK", "SSTABLE_HIT"]
    assert steps(b"zz") == ["MEMTABLE_MISS", *["BOUNDS_SKIP"] * 3, "NOT_FOUND"]
    t = explain.explain_get(s, b"c")
    assert t.steps[-1].metadata["tombstone"] == "true" and t.steps[-1].status == "miss"
    absent = next(k for k in (f"b{i}".encode() for i in range(99)) if "BLOOM_SKIP" in steps(k))
    assert steps(absent)[-1] == "NOT_FOUND"
    with pytest.raises(InvalidKey):
        explain.explain_put(s, b"", b"v")
    with pytest.raises(InvalidOptions):
        explain.get_steps(s.log().withColumn("source", F.lit("s")), [])


def test_gateway_and_proxy(spark):
    from marlstone.model import UnknownNode
    from marlstone.operators.gateway import Gateway, Proxy

    g = Gateway.of(spark, cluster.Cluster.default(), files.scratch(spark, "gateway"))
    p = Proxy(g)
    assert p.handle("PUT", "/kv/user:1", {"value": "v"}) == (200, {"key": "user:1", "ok": True, "node": "node-2"})
    assert g.get("user:1") == "v" and p.handle("GET", "/kv/user:1")[1]["value"] == "v" and p.handle("GET", "/route/order:9")[1]["node"] == "node-1"
    assert [r["key"] for r in g.scan_node("node-2").collect()] == ["user:1"] and g.scan_node("node-1").isEmpty()
    assert p.handle("GET", "/scan-node/nope")[0] == 404 and p.handle("GET", "/kv/")[0] == 400 and p.handle("POST", "/kv/a")[0] == 405 and p.handle("GET", "/x")[0] == 404
    g.delete("user:1")
    assert g.get("user:1") is None
    assert p.handle("POST", "/flush-all")[0] == 200 and [r["healthy"] for r in g.health_all().collect()] == [True] * 3
    g.nodes["node-3"].close()
    assert [r["node"] for r in g.health_all().filter("not healthy").collect()] == ["node-3"] and p.handle("POST", "/compact-all")[0] == 502
    assert set(g.forward_to_all("GET", "/healthz")) == {"node-1", "node-2", "node-3"}
    with pytest.raises(UnknownNode):
        g.scan_node("nope")
    g.close()
    assert p.handle("GET", "/kv/a")[0] == 503


def test_servers_and_command_line(spark, tmp_path, capsys):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from marlstone.__main__ import main
    from marlstone.operators.node import Node
    from marlstone.serve import server

    http = server(Node(spark, files.scratch(spark, "http"), "node-1"))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    ask = lambda method, path, body=None: json.loads(urlopen(Request(base + path, json.dumps(body).encode() if body else None, method=method)).read())  # noqa: E731, S310
    assert ask("PUT", "/kv/a%20b", {"value": "1"})["key"] == "a b" and ask("GET", "/kv/a%20b")["value"] == "1"
    with pytest.raises(HTTPError) as e:
        ask("PUT", "/kv/", {"value": "1"})
    assert e.value.code == 400
    c = cluster.Cluster.default()
    c.nodes[0].base_url = base
    (tmp_path / "c.json").write_text(c.to_json())
    (tmp_path / "two.json").write_text(cluster.Cluster.default(2).to_json())
    at = str(tmp_path / "c.json")
    assert main(["cluster", "validate", at]) == 0 and main(["cluster", "health", at]) == 0
    assert '"healthy": 1' in capsys.readouterr().out
    http.shutdown()
    assert main(["cluster", "simulate-failure", at, "--down", "node-2", "--key", "user:1", "--key", "order:9"]) == 0
    assert '"affected_keys": 1' in capsys.readouterr().out
    assert main(["cluster", "plan-rebalance", at, str(tmp_path / "two.json"), "--key", "item:42"]) == 0
    assert '"moved_keys": 1' in capsys.readouterr().out
    assert main(["cluster", "example-read-replica-3node"]) == 0 and main(["version"]) == 0
    assert cluster.Cluster.read_replicas().validate().nodes[1].replication.primary == "node-1"
    assert main(["cluster", "validate", str(tmp_path / "none.json")]) == 1


def test_config():
    pytest.importorskip("yaml")
    from marlstone.sources.config import Config

    assert Config.parse("") == Config() and Config.parse("server:\n  port: 1\n  other: 2\nlog: {level: warn}\n").level == "warn"
    for bad in ("server: {port: 0}", "server: {port: x}", "log: {level: loud}", "log: {format: xml}", "- 1", "a: ["):
        with pytest.raises(InvalidOptions):
            Config.parse(bad)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, _, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(InvalidOptions):
        files.shared_root(Session())


def test_generated_values_agree():
    import numpy as np

    index = [0, 1, 5, 10**9]
    assert workload.values(np.array(index), 20) == [workload.value(i, 20) for i in index]


def test_percentiles_over_ranges(spark):
    import random

    r = random.Random(1)
    values = [r.choice([0.0, 1.5, r.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert tuple(workload.percentiles(df, "v", [1, 50, 95, 99], ranges=16).first()) == tuple(workload.percentile(values, p) for p in (1, 50, 95, 99))
    assert tuple(workload.percentiles(df.filter("false"), "v", [50]).first()) == (None,)
