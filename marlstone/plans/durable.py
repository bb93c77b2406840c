"""Queries that go through stores, nodes, replicas and journals on disk, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.model import NodeQuiesced
from marlstone.operators import dashboard, explain, kv, ops, shard, vector, workload
from marlstone.operators.gateway import Gateway, Proxy
from marlstone.operators.node import Node
from marlstone.operators.replica import ReplicaSet
from marlstone.plans.queries import _KEYS, FULL, LATEST, LOG, REST, SHARD_RING, SHARDS, _keys, _query, _ring_sql, _routed_sql, _table, entries_of, event_journal, event_log
from marlstone.sources import codecs, files, oplog
from marlstone.sources.cluster import Cluster
from marlstone.sources.store import Segment, Store
from marlstone.streaming.replication import Follower, Handover, Journal, Worker

#: The log with seqs as a store gives them, from 1.
DENSE = f"{LOG}, dense AS (SELECT key, value, kind, row_number() OVER (ORDER BY seq) AS seq, count(*) OVER () AS n FROM log), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM dense) WHERE r = 1)"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("key", F.when(F.col("kind") == 1, F.col("value")).alias("value"), "kind", F.col("seq").alias("order"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _operations(spark, sf_dir)
    n, low = rows.agg(F.count(F.lit(1)), F.min("order")).first()
    return rows.filter(F.col("order") < low + n // 2), rows.filter(F.col("order") >= low + n // 2)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


def _store(spark: SparkSession, sf_dir: str, flush: tuple[bool, bool]) -> Store:
    """The events in two writes, each flushed or not, opened again."""
    store = Store(spark, files.scratch(spark, "store"))
    for rows, done in zip(_halves(spark, sf_dir), flush, strict=True):
        store.write(rows)
        if done:
            store.flush()
    store.close()
    return Store(spark, store.path)


@_query(f"WITH {DENSE} SELECT key, CASE WHEN kind = 1 THEN value END AS value, seq, kind FROM dense")
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operation has a seq of its own."""
    return _text(_store(spark, sf_dir, (False, False)).log()).withColumn("kind", F.col("kind").cast("int"))


@_query(f"WITH {DENSE} SELECT key, value, seq FROM newest WHERE kind = 1")
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half in a segment, half in the delta, then opened again: reads are what they were on the log."""
    return _text(_store(spark, sf_dir, (True, False)).scan())


@_query(f"""WITH {DENSE}, d AS (SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM dense WHERE seq > n // 2 GROUP BY key)
  SELECT (SELECT count(*) FROM d) AS memtable_entries, (SELECT sum(strlen(key) + CASE WHEN kind = 1 THEN strlen(value) ELSE 0 END + 64)::BIGINT FROM d) AS memtable_bytes, 1::BIGINT AS segments,
    (SELECT count(DISTINCT key) FROM dense WHERE seq <= n // 2) AS segment_entries, (SELECT count(*) + 1 FROM dense) AS next_seq, (SELECT count(*) FROM newest WHERE kind = 1) AS live_keys""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, (True, False)).stats()
    names = ["memtable_entries", "memtable_bytes", "segments", "segment_entries", "next_seq", "live_keys"]
    return spark.createDataFrame([tuple(s[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@_query(f"WITH {DENSE} SELECT 1 + (seq > n // 2)::INTEGER AS id, count(DISTINCT key) AS count, min(key) AS min_key, max(key) AS max_key FROM dense GROUP BY 1")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, (True, True)).bounds().withColumn("min_key", F.col("min_key").cast("string")).withColumn("max_key", F.col("max_key").cast("string"))


@_query(f"WITH {DENSE} SELECT range, key, value, seq FROM newest, (VALUES (0, 'user:1', 'user:2'), (1, 'user:15', 'user:3'), (2, 'x', 'y'), (3, 'user:7', 'user:70')) AS t(range, a, b) WHERE kind = 1 AND key >= a AND key < b")
def store_scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that overlap, and one that holds nothing."""
    ranges = [(b"user:1", b"user:2"), (b"user:15", b"user:3"), (b"x", b"y"), (b"user:7", b"user:70")]
    return _text(_store(spark, sf_dir, (True, False)).scan_many(ranges))


def _segment(spark: SparkSession, sf_dir: str) -> Segment:
    log = event_log(spark, sf_dir).withColumn("key", F.col("key").cast("binary")).withColumn("value", F.when(F.col("kind") == 1, F.col("value")).cast("binary"))
    return Segment.create(kv.merge_latest(log), f"{files.scratch(spark, 'segment')}/s")


@_query(f"WITH {LATEST} SELECT key, CASE WHEN kind = 1 THEN value END AS value, seq, kind FROM latest WHERE key >= 'user:3' AND key < 'user:6'")
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's reads show tombstones."""
    return _text(_segment(spark, sf_dir).scan(b"user:3", b"user:6")).withColumn("kind", F.col("kind").cast("int"))


@_query(f"WITH {LATEST} SELECT key, seq, kind FROM latest WHERE key IN (SELECT min(key) FROM latest WHERE kind = 2 UNION ALL SELECT max(key) FROM latest WHERE kind = 1)")
def segment_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key that is deleted and the last that is not; one read each."""
    s = _segment(spark, sf_dir)
    gone, there = s.table.agg(F.min(F.when(F.col("kind") == 2, F.col("key"))), F.max(F.when(F.col("kind") == 1, F.col("key")))).first()
    found = [s.get(bytes(k)) for k in (gone, there) if k is not None]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("key").cast("string").alias("key"), "seq", F.col("kind").cast("int").alias("kind"))


@_query(f"WITH {LATEST} SELECT count(*) AS count, min(key) AS min_key, max(key) AS max_key FROM latest")
def segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment(spark, sf_dir).metadata().select("count", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"))


@_query(f"WITH {DENSE} SELECT key, CASE WHEN kind = 1 THEN value END AS value, seq, kind FROM dense")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, the second one by a log that was opened again; it gives the seqs itself."""
    path = f"{files.scratch(spark, 'log')}/log"
    for rows in _halves(spark, sf_dir):
        oplog.OpLog(spark, path).append(rows)
    return _text(oplog.OpLog(spark, path).replay()).withColumn("kind", F.col("kind").cast("int"))


@_query(f"WITH {LOG} SELECT key, CASE WHEN kind = 1 THEN value END AS value, seq, kind FROM log")
def log_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary frames of all operations, a file for each task's rows, read again."""

    def encode(batches):
        import pandas as pd

        for b in batches:
            raw = b"".join(codecs.encode_frame(int(s), int(k), key.encode(), (v or "").encode()) for s, k, key, v in zip(b["order"], b["kind"], b["key"], b["value"], strict=True))
            yield pd.DataFrame({"raw": [raw]})

    def decode(batches):
        import pandas as pd

        for b in batches:
            rows = [(k.decode(), v.decode() if kind == 1 else None, s, kind) for raw in b["raw"] for s, kind, k, v in codecs.decode_frames(bytes(raw))]
            yield pd.DataFrame(rows, columns=["key", "value", "seq", "kind"])

    return _operations(spark, sf_dir).mapInPandas(encode, "raw binary").mapInPandas(decode, "key string, value string, seq bigint, kind int")


@_query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, label::VARCHAR AS metadata, (30 + 4 * len(embedding) + strlen(label::VARCHAR))::INTEGER AS bytes FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as binary records and back."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", codecs.encode_column(64)("embedding", F.col("label").cast("string").cast("binary")).alias("record"))
    out = rows.select("vec_id", F.octet_length("record").alias("bytes"), codecs.decode_column(64)("record").alias("r"))
    total = F.aggregate("r.vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", F.round(total, 4).alias("total"), F.col("r.metadata").cast("string").alias("metadata"), "bytes")


def _vector_store(spark: SparkSession, sf_dir: str) -> vector.VectorStore:
    """All vectors; then those with id 3 mod 10 deleted and those with 5 mod 10 reversed; flushed between, opened again, compacted."""
    store = vector.VectorStore(spark, 64, path=files.scratch(spark, "vectors"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").cast("binary").alias("metadata"))
    store.upsert_all(rows.drop("vec_id"))
    store.flush()
    store.delete_all(rows.filter("vec_id % 10 = 3"))
    store.upsert_all(rows.filter("vec_id % 10 = 5").select("id", F.reverse("vector").alias("vector"), "metadata"))
    store.flush()
    store.compact()
    store.close()
    return vector.VectorStore(spark, 64, path=store.store.path)


_STORED = "stored AS (SELECT vec_id, vec_id::VARCHAR AS id, CASE WHEN vec_id % 10 = 5 THEN list_reverse(embedding) ELSE embedding END AS vector, label::VARCHAR AS metadata FROM embeddings WHERE vec_id % 10 <> 3)"


@_query(f"WITH {_STORED} SELECT id, round(vector[1]::DOUBLE, 5) AS first, round(vector[64]::DOUBLE, 5) AS last, metadata FROM stored")
def vector_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _vector_store(spark, sf_dir).live()
    return live.select("id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(F.col("vector")[63].cast("double"), 5).alias("last"), F.col("metadata").cast("string").alias("metadata"))


@_query(f"WITH {_STORED} SELECT id, round(score, 6) AS score FROM (SELECT id, list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM stored ORDER BY score DESC, id LIMIT 10)")
def vector_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of a vector that was deleted."""
    gone = _table(spark, sf_dir, "embeddings").filter("vec_id = 3").first()["embedding"]
    return _vector_store(spark, sf_dir).search(gone, 10).select("id", F.round("score", 6).alias("score"))


@_query(f"WITH {_STORED} SELECT count(*) AS vectors, 1::BIGINT AS segments, count(*) AS segment_entries FROM stored")
def vector_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _vector_store(spark, sf_dir).stats()
    return spark.createDataFrame([(s["vectors"], s["segments"], s["segment_entries"])], "vectors bigint, segments bigint, segment_entries bigint")


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1 AND key >= 'user:1' AND key < 'user:8'")
def shard_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.scan(shard.with_shard(event_log(spark, sf_dir), SHARDS), "user:1", "user:8")


def _sharded(spark: SparkSession, sf_dir: str) -> shard.ShardedStore:
    path = files.scratch(spark, "sharded")
    store = shard.ShardedStore(spark, path, SHARDS)
    store.write(_operations(spark, sf_dir))
    store.flush()
    return shard.ShardedStore(spark, path)


@_query(f"WITH {LATEST} SELECT key, value FROM latest WHERE kind = 1")
def shard_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store for each shard, opened again, read over all of them."""
    return _text(_sharded(spark, sf_dir).scan().drop("seq"))


@_query(f"WITH {LATEST}, {_KEYS}, {_ring_sql('ring', SHARD_RING)}, {_routed_sql('r', 'ring')} SELECT owner::INTEGER AS shard, count(*) AS segment_entries, sum((kind = 1)::INTEGER)::BIGINT AS live_keys FROM latest JOIN r USING (key) GROUP BY 1")
def shard_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _sharded(spark, sf_dir).stats()["shards"]
    return spark.createDataFrame([(i, s["segment_entries"], s["live_keys"]) for i, s in enumerate(each) if s["segment_entries"]], "shard int, segment_entries bigint, live_keys bigint")


def _gateway(spark: SparkSession, sf_dir: str) -> Gateway:
    gateway = Gateway.of(spark, Cluster.default(), files.scratch(spark, "cluster"))
    gateway.write(_operations(spark, sf_dir))
    return gateway


_NODES = f"{LATEST}, {_KEYS}, {_ring_sql('ring', FULL)}, {_routed_sql('r', 'ring')}"


@_query(f"WITH {_NODES} SELECT key, value FROM latest JOIN r USING (key) WHERE kind = 1 AND owner = 'node-2'")
def gateway_scan_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    gateway = _gateway(spark, sf_dir)
    gateway.flush_all()
    gateway.compact_all()
    return gateway.scan_node("node-2").select("key", "value")


@_query(f"""WITH {_NODES}, asked AS (SELECT unnest(['user:1', 'user:2', 'user:3', 'user:4']) AS key), routed AS (SELECT key, owner FROM r)
  SELECT a.key, owner AS node, coalesce(kind, 2) = 1 AND a.key <> 'user:2' AS found, CASE WHEN kind = 1 AND a.key <> 'user:2' THEN value END AS value FROM asked a JOIN routed USING (key) LEFT JOIN latest l USING (key)""")
def gateway_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets by key through the proxy, after one of the keys was deleted through it."""
    proxy = Proxy(_gateway(spark, sf_dir))
    proxy.handle("DELETE", "/kv/user:2")
    known = {r["key"] for r in _keys(spark, sf_dir).filter(F.col("key").isin("user:1", "user:2", "user:3", "user:4")).collect()}
    answers = [proxy.handle("GET", f"/kv/{k}")[1] for k in sorted(known)]
    return spark.createDataFrame([(a["key"], a["node"], a["found"], a.get("value")) for a in answers], "key string, node string, found boolean, value string")


@_query("SELECT event_type AS node, event_type <> 'error' AS healthy FROM events GROUP BY 1")
def cluster_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each event type; the one for errors answers with a failure."""
    nodes = [r["event_type"] for r in _table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return ops.check_health(spark, nodes, lambda n: (500, "down") if n == "error" else (200, "ok")).select("node", "healthy")


@_query(f"WITH {_KEYS}, {_ring_sql('ring', FULL)}, {_routed_sql('r', 'ring')} SELECT key, owner AS node FROM r")
def cluster_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by the ring of a cluster's description, written and read again."""
    return ops.route_keys(_keys(spark, sf_dir), Cluster.parse(Cluster.default().to_json()).validate().ring())


@_query(f"WITH {_KEYS}, {_ring_sql('ring', REST)}, {_routed_sql('r', 'ring')} SELECT key, owner AS node FROM r")
def ops_route_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route_keys(_keys(spark, sf_dir), Cluster.default().ring("node-2"))


def _replicas(spark: SparkSession, sf_dir: str) -> ReplicaSet:
    """Two followers: one takes two thirds of the log in a round, the other is paused. Then the set is opened again."""
    path = files.scratch(spark, "replicas")
    s = ReplicaSet(spark, 3, path)
    for rows in _halves(spark, sf_dir):
        s.write(rows)
    s.set_batch(1, s.commit * 2 // 3)
    s.pause(2)
    s.replicate_once()
    s.close()
    return ReplicaSet(spark, 3, path)


@_query(f"WITH {DENSE} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM dense WHERE seq <= n * 2 // 3) WHERE r = 1 AND kind = 1")
def replica_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replicas(spark, sf_dir).scan(mode="follower", replica=1)


@_query("SELECT r AS replica, r = 0 AS leader, CASE r WHEN 0 THEN n WHEN 1 THEN n * 2 // 3 ELSE 0 END AS applied, CASE r WHEN 0 THEN 0 WHEN 1 THEN n - n * 2 // 3 ELSE n END AS lag FROM (SELECT count(*) AS n FROM events), (VALUES (0), (1), (2)) t(r)")
def replica_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replicas(spark, sf_dir).status().select("replica", "leader", "applied", "lag")


@_query(f"WITH {DENSE} SELECT key, value, seq FROM newest WHERE kind = 1")
def replica_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All caught up, the log compacted: a follower shows what the leader does."""
    s = _replicas(spark, sf_dir)
    s.replicate_all()
    s.flush()
    s.compact()
    return s.scan(mode="follower", replica=2)


_ENTRIES = f"{LOG}, entries AS (SELECT key, value, kind, seq - min(seq) OVER () + 1 AS seq, count(*) OVER () AS n FROM log)"


@_query(f"WITH {_ENTRIES} SELECT seq, CASE WHEN kind = 2 THEN 'delete' ELSE 'put' END AS op, key, value FROM entries WHERE seq > 500 AND seq <= 1500")
def replication_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_journal(spark, sf_dir)[1].after(500, 1000).select("seq", "op", "key", "value")


@_query(f"WITH {_ENTRIES}, t AS (SELECT max(n) AS n, max(n) // 3 + 1 AS c FROM entries) SELECT i::INTEGER AS round, least(c, n - c * i) AS fetched, least(c, n - c * i) AS applied, least(c * (i + 1), n) AS last_applied, greatest(0, n - c * (i + 1)) AS lag FROM t, range(0, 3) r(i)")
def replication_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pulls, each by a follower that was opened again: its cursor is what the one before left."""
    root, journal, _, n = event_journal(spark, sf_dir)
    results = [Follower(spark, f"{root}/f", "f", journal).sync(n // 3 + 1) for _ in range(3)]
    return spark.createDataFrame([(i, r.fetched, r.applied, r.last_applied, r.lag) for i, r in enumerate(results)], "round int, fetched bigint, applied bigint, last_applied bigint, lag bigint")


@_query("""WITH t AS (SELECT min(event_id) + 100 AS first, max(event_id) AS latest FROM events), c AS (SELECT event_type AS follower, min(event_id) AS cursor FROM events GROUP BY 1 UNION ALL SELECT event_type || '-late', max(event_id) FROM events GROUP BY 1)
  SELECT follower, cursor, first AS first_available_seq, latest AS latest_seq, cursor + 1 < first AS gap, greatest(0, latest - cursor) AS lag FROM c, t""")
def replication_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers at the first and the last event of each type, against a log whose first hundred entries are gone."""
    log = event_log(spark, sf_dir)
    low = log.agg(F.min("seq")).first()[0]
    by = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    cursors = by.select(F.col("event_type").alias("follower"), F.col("a").alias("cursor")).union(by.select(F.concat("event_type", F.lit("-late")), "b"))
    return oplog.gaps(cursors, log.filter(F.col("seq") >= low + 100))


@_query(f"WITH {_ENTRIES} SELECT CASE WHEN seq <= n // 2 THEN 'old' ELSE 'new' END AS journal, seq, key FROM entries")
def replication_quiesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the entries go to a primary that is then quiesced: the rest is refused there, and goes to the promoted follower."""
    root, journal, low, n = event_journal(spark, sf_dir, 2, 0.5)
    rest = entries_of(event_log(spark, sf_dir), low).filter(F.col("seq") > n)
    handover = Handover(spark, f"{root}/handover")
    record = handover.quiesce(journal, "node-1")
    try:
        Journal(spark, journal.path).append(rest)
    except NodeQuiesced:
        follower = Follower(spark, f"{root}/f", "node-2", journal)
        follower.sync(0)
        promoted = handover.promote(follower, record, f"{root}/new", True)
        promoted.append(rest)
        both = [(journal, "old"), (promoted, "new")]
    else:
        both = [(journal, "unfenced"), (journal, "unfenced")]
    (a, x), (b, y) = both
    return a.entries().select(F.lit(x).alias("journal"), "seq", "key").unionByName(b.entries().select(F.lit(y).alias("journal"), "seq", "key"))


@_query("SELECT * FROM (VALUES ('node-1', 'primary', 'quiesced'), ('node-2', 'follower', 'primary'), ('node-3', 'follower', 'follower')) AS t(node, configured, role)")
def replication_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nodes are when they start after a handover."""
    root, journal, _, _ = event_journal(spark, sf_dir, 1, 0.1)
    handover, follower = Handover(spark, f"{root}/handover"), Follower(spark, f"{root}/f", "node-2", journal)
    record = handover.quiesce(journal, "node-1")
    follower.sync(0)
    handover.promote(follower, record, f"{root}/new", True)
    again = Handover(spark, f"{root}/handover")
    return spark.createDataFrame([(n, c, again.role(n, c)) for n, c in (("node-1", "primary"), ("node-2", "follower"), ("node-3", "follower"))], "node string, configured string, role string")


@_query(f"WITH {_ENTRIES}, t AS (SELECT max(n) AS n FROM entries) SELECT i::INTEGER AS step, 'healthy' AS state, least(1000 * (i + 1), n) AS last_applied FROM t, range(0, 2) r(i)")
def replication_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of the background worker, a pull of a thousand entries each."""
    root, journal, _, _ = event_journal(spark, sf_dir, 1)
    worker, out = Worker(Follower(spark, f"{root}/f", "f", journal)), []
    for i in range(2):
        worker.step()
        out.append((i, worker.state, worker.last.last_applied))
    return spark.createDataFrame(out, "step int, state string, last_applied bigint")


@_query(f"WITH {DENSE} SELECT key, value, seq FROM newest WHERE kind = 1")
def node_follower_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary node takes the events; a follower node that syncs shows the same."""
    root = files.scratch(spark, "nodes")
    primary = Node(spark, f"{root}/p", "p", "primary")
    primary.write(_operations(spark, sf_dir))
    follower = Node(spark, f"{root}/f", "f", "follower", primary.journal)
    follower.sync(0)
    return follower.scan()


@_query("""SELECT * FROM (VALUES ('PUT', 0, 'ENGINE', 'KEY_VALIDATED', 'ok'), ('PUT', 1, 'WAL', 'WAL_APPEND', 'ok'), ('PUT', 2, 'delta', 'MEMTABLE_PUT', 'ok'),
  ('DELETE', 0, 'ENGINE', 'KEY_VALIDATED', 'ok'), ('DELETE', 1, 'WAL', 'WAL_APPEND', 'ok'), ('DELETE', 2, 'delta', 'MEMTABLE_PUT', 'ok'),
  ('VECTOR_INSERT', 0, 'VECTOR', 'VECTOR_VALIDATE', 'ok'), ('VECTOR_INSERT', 1, 'VECTOR', 'VECTOR_ENCODE', 'ok'), ('VECTOR_INSERT', 2, 'VECTOR', 'VECTOR_ENGINE_WRITE', 'ok'), ('VECTOR_INSERT', 3, 'VECTOR', 'VECTOR_INDEX_UPDATE', 'ok'),
  ('VECTOR_SEARCH', 0, 'VECTOR', 'VECTOR_LOAD', 'ok'), ('VECTOR_SEARCH', 1, 'VECTOR', 'VECTOR_TOPK', 'ok'),
  ('VECTOR_DELETE', 0, 'VECTOR', 'VECTOR_VALIDATE', 'ok'), ('VECTOR_DELETE', 1, 'VECTOR', 'VECTOR_ENGINE_WRITE', 'ok'), ('VECTOR_DELETE', 2, 'VECTOR', 'VECTOR_INDEX_DELETE', 'ok')) AS t(operation, place, component, step, status)""")
def explain_write_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of writes and of a vector's life."""
    store, vectors = Store(spark, files.scratch(spark, "trace")), vector.VectorStore(spark, 64)
    v = _table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]
    traces = [explain.explain_put(store, b"k", b"v"), explain.explain_delete(store, b"k"), explain.explain_upsert(vectors, "a", v), explain.explain_search(vectors, v, 1), explain.explain_vector_delete(vectors, "a")]
    return spark.createDataFrame([(t.operation, i, s.component, s.step_type, s.status) for t in traces for i, s in enumerate(t.steps)], "operation string, place int, component string, step string, status string")


@_query(f"""WITH {DENSE}, h AS (SELECT * FROM dense WHERE seq <= n // 2), k AS (SELECT max(key) || 'z' AS above, min(key) AS first FROM h)
  SELECT place, step, status FROM (VALUES (0, 'KEY_VALIDATED', 'ok'), (1, 'MEMTABLE_MISS', 'miss'), (2, 'BOUNDS_SKIP', 'skipped'), (3, 'NOT_FOUND', 'miss')) AS t(place, step, status)""")
def explain_get_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key beyond the last one of a store's only segment."""
    store = Store(spark, files.scratch(spark, "trace"))
    store.write(_halves(spark, sf_dir)[0])
    store.flush()
    top = bytes(store.bounds().first()["max_key"])
    return spark.createDataFrame([(i, s.step_type, s.status) for i, s in enumerate(explain.explain_get(store, top + b"z").steps)], "place int, step string, status string")


@_query("SELECT * FROM (VALUES ('follower_pause', true), ('follower_lag', true), ('follower_catchup', true)) AS t(scenario, passed)")
def dashboard_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = [s(spark) for s in (dashboard.pause_scenario, dashboard.lag_scenario, dashboard.catchup_scenario)]
    return spark.createDataFrame([(r["scenario"], r["passed"]) for r in results], "scenario string, passed boolean")


@_query(f"""WITH {DENSE} SELECT 'engine' AS kind, 'ok' AS status, (count(*) + 1)::VARCHAR AS figure FROM dense UNION ALL SELECT 'replica', 'degraded', count(*)::VARCHAR FROM dense""")
def dashboard_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store, and replicas of which one is behind."""
    parts = dashboard.collect({"store": _store(spark, sf_dir, (True, False))}, replicas={"set": _replicas(spark, sf_dir)})
    figure = F.when(F.col("kind") == "engine", F.col("stats")["next_seq"]).otherwise(F.col("stats")["commit_index"])
    return dashboard.snapshot(spark, parts).select("kind", "status", figure.alias("figure"))


@_query("""SELECT * FROM (VALUES ('write-heavy', 1000, 1000), ('read-heavy', 1000, 950), ('mixed', 1000, 850), ('scan', 100, 4900), ('compaction', 240, 2200), ('restart', 1, 2)) AS t(workload, operations, answered)""")
def bench_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six workloads in their small scale: operations, and the rows that answered them."""
    results = [workload.run(spark, files.scratch(spark, "workload"), name) for name in workload.WORKLOADS]
    return spark.createDataFrame([(r["workload"], r["operations"], r["answered"]) for r in results], "workload string, operations int, answered int")


