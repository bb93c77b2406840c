"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import bloom, ring
from marlstone.functions.hashing import fnv1a64_column
from marlstone.operators import dashboard, explain, kv, ops, replica, shard, vector, workload
from marlstone.sources import files, oplog
from marlstone.sources.store import Store
from marlstone.streaming.replication import Follower, Journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NODES = [("node-1", 1), ("node-2", 1), ("node-3", 1)]
SHARDS = 4


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an operation log: a key for each user, ``error`` events as deletes, a thousand to a segment."""
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.concat_ws("@", "event_type", F.col("event_id").cast("string")).alias("value"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 2).otherwise(1).cast("tinyint").alias("kind"), F.concat(F.lit("segment-"), F.floor(F.col("event_id") / 1000).cast("string")).alias("source"))


LOG = "log AS (SELECT 'user:' || user_id AS key, event_type || '@' || event_id AS value, event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, 'segment-' || (event_id // 1000) AS source FROM events)"
LATEST = f"{LOG}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir))


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1 AND key >= 'user:2' AND key < 'user:5'")
def kv_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir), "user:2", "user:5")


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1 AND key = 'user:7'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(event_log(spark, sf_dir), "user:7")


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1 AND key IN (SELECT 'user:' || c_custkey FROM customer)")
def kv_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get_many(event_log(spark, sf_dir), _table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key")))


@_query(f"WITH {LATEST} SELECT key, value, seq, kind FROM latest")
def kv_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.merge_latest(event_log(spark, sf_dir)).withColumn("kind", F.col("kind").cast("int"))


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1")
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.compacted(event_log(spark, sf_dir)).select("key", "value", "seq")


#: FNV-1a in DuckDB: a fold over the bytes in HUGEINT. Keys here are ASCII.
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({key}, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor((a % 18446744073709551616)::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)"
#: The same from the state that the Bloom filters' salt leads to.
_SALTED = _FNV.replace("14695981039346656037", str(bloom.SALTED))
def _ring_sql(name: str, r: ring.Ring) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {','.join(f'({h}::UBIGINT, {o!r})' for h, o in r.points)}) AS t(p, o))"


def _routed_sql(name: str, table: str) -> str:
    return f"{name} AS (SELECT key, coalesce(o, (SELECT arg_min(o, p) FROM {table})) AS owner FROM hashed ASOF LEFT JOIN {table} ON h <= p)"


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as operations on their orders: as many keys as there are orders, returned items as deletes."""
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("key"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).cast("bigint").alias("seq"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("tinyint").alias("kind"))


_LINES = "lines AS (SELECT 'order:' || lpad(l_orderkey::VARCHAR, 12, '0') AS key, l_partkey || '/' || l_suppkey AS value, ((l_orderkey::BIGINT * 8 + l_linenumber) * 10000000 + l_partkey) * 10000 + l_suppkey AS seq, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS kind FROM lineitem), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM lines) WHERE r = 1)"


@_query(f"WITH {_LINES} SELECT key, value, seq FROM newest WHERE kind = 1")
def kv_scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan over a log with very many keys."""
    return kv.scan(line_log(spark, sf_dir))


@_query(f"WITH {_LINES}, hashed AS (SELECT key, " + _FNV.format(key="key") + f"::UBIGINT AS h FROM newest), {_ring_sql('ring', ring.node_ring(NODES))}, {_routed_sql('r', 'ring')} SELECT owner AS node, count(*) AS keys, sum((kind = 1)::INTEGER)::BIGINT AS live_keys FROM newest JOIN r USING (key) GROUP BY 1")
def ring_route_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of very many keys, and of those that live, each node has."""
    routed = ring.route(kv.merge_latest(line_log(spark, sf_dir)), F.col("key"), FULL, "node")
    return routed.groupBy("node").agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("kind") == 1).cast("long")).alias("live_keys"))


@_query(f"WITH {LATEST} SELECT count(*) AS entries, sum(strlen(key) + strlen(value) + 64)::BIGINT AS approx_bytes FROM latest")
def kv_memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.approximate_bytes(event_log(spark, sf_dir))


@_query(f"WITH {LOG} SELECT source, count(*) AS entries, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq FROM log GROUP BY source")
def kv_segment_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"))


@_query(f"WITH {LATEST} SELECT key, value FROM latest WHERE kind = 1")
def kv_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into a durable store, flushed, then compacted: reads are what they were on the log."""
    store = Store(spark, files.scratch(spark, "store"))
    log = event_log(spark, sf_dir).withColumn("order", F.col("seq"))
    middle = log.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    for part in (log.filter(F.col("seq") <= middle), log.filter(F.col("seq") > middle)):
        store.write(part)
        store.flush()
    store.compact()
    return store.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@_query(f"WITH {LOG} SELECT key, value, seq FROM log WHERE seq > 500 ORDER BY seq LIMIT 1000")
def log_entries_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.entries_after(event_log(spark, sf_dir), 500).select("key", "value", "seq")


@_query("SELECT min(event_id) AS first_available_seq, max(event_id) AS latest_seq, count(*) AS entries FROM events")
def log_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.bounds(event_log(spark, sf_dir))


@_query("SELECT seq, previous FROM (SELECT event_id AS seq, lag(event_id) OVER (ORDER BY event_id) AS previous, min(event_id) OVER () AS first FROM events WHERE event_type <> 'error') WHERE previous IS NOT NULL AND seq <> previous + 1")
def log_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).filter("kind = 1")
    return oplog.holes(log, baseline=log.agg(F.min("seq")).first()[0] - 1)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")


def _nearest(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = vector.search(v, v.filter("id = '0'").first()["vector"], 10, metric)
    return found.select("id", "label", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


_PAIR = "FROM embeddings e, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_TOP = "SELECT id, label, round(score, 6) AS score, round({distance}, 6) AS distance FROM (SELECT vec_id::VARCHAR AS id, label, {score} AS score " + _PAIR + " ORDER BY score DESC, id LIMIT 10)"


@_query(_TOP.format(score="greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], q)))", distance="1 - score"))
def vector_search_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine")


@_query(_TOP.format(score="-list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", distance="-score"))
def vector_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "l2")


@_query(_TOP.format(score="list_inner_product(embedding::DOUBLE[], q)", distance="-score"))
def vector_search_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "dot")


@_query("""SELECT query_id, id, rank, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
    (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id::VARCHAR))::INTEGER AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def vector_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 100, against all rows."""
    queries = _table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.search_many(_vectors(spark, sf_dir), queries, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, of which five in fifty have something wrong with them."""
    case = F.col("vec_id") % 50
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(case == 0, "").when(case == 1, "a/b").otherwise(F.col("vec_id").cast("string")).alias("id"),
        F.when(case == 2, F.slice("embedding", 1, 8)).when(case == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).when(case == 4, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")).alias("vector"))


@_query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 4 THEN -1.0 ELSE greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], q))) END AS score
    FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) WHERE vec_id % 50 NOT IN (2, 3))
  SELECT vec_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM v""")
def vector_search_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another size and such that aren't finite take no part; the zero vector scores -1. All others are asked for."""
    rows = _spoilt(spark, sf_dir).drop("id")
    found = vector.search(rows, rows.filter("vec_id = 7").first()["vector"], 1 << 30, "cosine", "vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@_query("""SELECT CASE WHEN vec_id % 50 = 0 THEN 'id is empty' WHEN vec_id % 50 = 1 THEN 'id holds / or a control character' WHEN vec_id % 50 = 2 THEN 'wrong dimension'
  WHEN vec_id % 50 = 3 THEN 'a component is not finite' WHEN vec_id % 50 = 4 THEN 'the zero vector has no direction' END AS why, count(*) AS rows FROM embeddings GROUP BY 1""")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _spoilt(spark, sf_dir)
    return bad.groupBy(vector.invalid_reason("id", "vector", 64, "cosine").alias("why")).agg(F.count(F.lit(1)).alias("rows"))


_KEYS = "keys AS (SELECT DISTINCT 'user:' || user_id AS key FROM events), hashed AS (SELECT key, " + _FNV.format(key="key") + "::UBIGINT AS h FROM keys)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("key").distinct()


@_query(f"WITH {_KEYS} SELECT key, lower(lpad(to_hex(h), 16, '0')) AS fnv FROM hashed")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("key", F.lower(F.lpad(F.hex(fnv1a64_column(F.col("key"))), 16, "0")).alias("fnv"))


FULL, REST = ring.node_ring(NODES), ring.node_ring(NODES).without("node-2")
GROWN = ring.node_ring([*NODES, ("node-4", 2)])
SHARD_RING = ring.shard_ring(SHARDS)


@_query(f"WITH {_KEYS}, {_ring_sql('ring', FULL)}, {_routed_sql('r', 'ring')} SELECT key, owner AS node FROM r")
def ring_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route_keys(_keys(spark, sf_dir), FULL)


@_query(f"WITH {_KEYS}, {_ring_sql('ring', SHARD_RING)}, {_routed_sql('r', 'ring')} SELECT key, owner::INTEGER AS shard FROM r")
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.with_shard(_keys(spark, sf_dir), SHARDS)


@_query(f"""WITH {LOG}, {_KEYS}, {_ring_sql('ring', SHARD_RING)}, {_routed_sql('r', 'ring')},
  n AS (SELECT key, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value, count(*) AS n FROM log GROUP BY key)
  SELECT owner::INTEGER AS shard, sum(n)::BIGINT AS operations, sum((kind = 1)::INTEGER)::BIGINT AS live_keys, sum(CASE WHEN kind = 1 THEN strlen(key) + strlen(value) ELSE 0 END)::BIGINT AS bytes FROM n JOIN r USING (key) GROUP BY ROLLUP (owner::INTEGER)""")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.stats(shard.with_shard(event_log(spark, sf_dir), SHARDS))


@_query(f"""WITH {LATEST}, {_KEYS}, {_ring_sql('ring', SHARD_RING)}, {_routed_sql('r', 'ring')} SELECT key, value, seq FROM latest JOIN r USING (key) WHERE kind = 1 AND owner = '1'""")
def shard_scan_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(shard.with_shard(event_log(spark, sf_dir), SHARDS).filter("shard = 1"))


_BOTH = f"WITH {_KEYS}, {_ring_sql('a', FULL)}, {{second}}, {_routed_sql('x', 'a')}, {_routed_sql('y', 'b')}, z AS (SELECT x.key, x.owner AS was, y.owner AS now FROM x JOIN y USING (key))"


@_query(_BOTH.format(second=_ring_sql("b", REST)) + " SELECT key, was AS origin, now AS node, was = 'node-2' AS origin_down, was <> 'node-2' AND was <> now AS moved, was = 'node-2' OR was <> now AS affected FROM z")
def ops_simulate_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.simulate_failure(_keys(spark, sf_dir), FULL, ["node-2"])


@_query(_BOTH.format(second=_ring_sql("b", REST)) + " SELECT count(*) AS keys, sum((was = 'node-2' OR was <> now)::INTEGER)::BIGINT AS affected_keys, sum((was <> 'node-2' AND was <> now)::INTEGER)::BIGINT AS moved_keys, 0::BIGINT AS unavailable_keys FROM z")
def ops_failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.failure_summary(ops.simulate_failure(_keys(spark, sf_dir), FULL, ["node-2"]))


@_query(_BOTH.format(second=_ring_sql("b", GROWN)) + " SELECT was AS from_node, now AS to_node, count(*) AS keys, sum((was <> now)::INTEGER)::BIGINT AS moved_keys FROM z GROUP BY 1, 2")
def ops_plan_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rebalance_summary(ops.plan_rebalance(_keys(spark, sf_dir), FULL, GROWN))


@_query(f"WITH {LOG}, cut AS (SELECT max(seq) // 2 AS c FROM log) SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log, cut WHERE seq <= c) WHERE r = 1 AND kind = 1")
def replica_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a follower shows that has applied half of the log."""
    log = event_log(spark, sf_dir).withColumnRenamed("seq", "log_index")
    return kv.scan(replica.visible(log, log.agg(F.max("log_index")).first()[0] // 2))


_REPLICAS = "(VALUES (0, true, false, 0, 100), (1, false, false, 0, 40), (2, false, true, 0, 7), (3, false, false, 25, 90)) AS t(replica, leader, paused, batch, applied)"


@_query(f"SELECT replica, CASE WHEN leader THEN c WHEN paused THEN applied ELSE greatest(applied, least(c, applied + CASE WHEN batch > 0 THEN batch ELSE 1 END)) END AS applied FROM {_REPLICAS}, (SELECT max(event_id) AS c FROM events)")
def replica_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return replica.advance(spark.sql(f"SELECT * FROM {_REPLICAS.replace('AS t', 't')}"), commit).select("replica", "applied")


@_query(f"SELECT replica, CASE WHEN paused THEN applied ELSE c END AS applied FROM {_REPLICAS}, (SELECT max(event_id) AS c FROM events)")
def replica_advance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return replica.advance(spark.sql(f"SELECT * FROM {_REPLICAS.replace('AS t', 't')}"), commit, everything=True).select("replica", "applied")


@_query("""WITH f AS (SELECT event_type AS name, user_id % 3 AS replica, max(event_id) AS applied FROM events WHERE event_type <> 'view' OR event_id < 100 GROUP BY 1, 2),
  l AS (SELECT event_type AS name, max(event_id) AS commit FROM events GROUP BY 1)
  SELECT name, CASE WHEN min(applied) < commit THEN 'degraded' ELSE 'ok' END AS status, count(*) + 1 AS replicas, least(min(applied), commit) AS least_applied, commit FROM f JOIN l USING (name) GROUP BY name, commit""")
def dashboard_replica_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of replicas for each event type: the leader has all of its events, three followers those of some users."""
    events = _table(spark, sf_dir, "events")
    leaders = events.groupBy(F.col("event_type").alias("name")).agg(F.max("event_id").alias("applied")).withColumn("leader", F.lit(True))
    followers = events.filter("event_type <> 'view' or event_id < 100").groupBy(F.col("event_type").alias("name"), F.col("user_id") % 3).agg(F.max("event_id").alias("applied")).withColumn("leader", F.lit(False))
    return dashboard.replica_set_health(leaders.unionByName(followers.select("name", "applied", "leader")))


def entries_of(log: DataFrame, low: int) -> DataFrame:
    """A log's rows as a journal's entries from seq 1 on."""
    return log.select((F.col("seq") - low + 1).alias("seq"), F.when(F.col("kind") == 2, "delete").otherwise("put").alias("op"), "key", "value", F.lit(0).cast("timestamp").alias("timestamp"))


def event_journal(spark: SparkSession, sf_dir: str, appends: int = 4, part: float = 1.0) -> tuple[str, Journal, int, int]:
    """A scratch folder, a primary's journal of the events (or the first ``part`` of them) in it, their first id and their number."""
    root = files.scratch(spark, "replication")
    journal, log = Journal(spark, f"{root}/primary"), event_log(spark, sf_dir)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    entries, n = entries_of(log, low), int((high - low + 1) * part)
    for i in range(appends):
        journal.append(entries.filter((F.col("seq") > n * i // appends) & (F.col("seq") <= n * (i + 1) // appends)))
    return root, journal, low, n


@_query(f"WITH {LATEST} SELECT key, value, seq FROM latest WHERE kind = 1")
def replication_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a primary's journal in four files, applied by a follower's stream."""
    root, journal, low, _ = event_journal(spark, sf_dir)
    follower = Follower(spark, f"{root}/follower", "node-2", journal)
    follower.stream()
    return follower.scan().withColumn("seq", F.col("seq") + low - 1)


@_query(f"WITH {LOG} SELECT source, seq, kind, CASE WHEN seq < max(seq) OVER () THEN 'SUPERSEDED' WHEN kind = 1 THEN 'HIT' ELSE 'TOMBSTONE' END AS status FROM log WHERE key = 'user:7'")
def explain_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.get_versions(event_log(spark, sf_dir), "user:7").withColumn("kind", F.col("kind").cast("int"))


_ASKED = ("user:7", "user:70x", "a", "zebra", "user:5")


@_query(f"""WITH {LOG}, k AS (SELECT DISTINCT source, key FROM log), asked AS (SELECT unnest([{', '.join(f"'{k}'" for k in _ASKED)}]) AS asked),
  seg AS (SELECT source, min(key) AS low, max(key) AS high, max(seq) AS newest, count(DISTINCT key) AS n FROM log GROUP BY source),
  sized AS (SELECT *, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::HUGEINT AS m, least(64, greatest(1, floor(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2) + 0.5)))::INTEGER AS c FROM seg),
  names AS (SELECT DISTINCT key FROM k UNION SELECT asked FROM asked), hashed AS (SELECT key, {_FNV.format(key="key")} AS h, {_SALTED.format(key="key")} AS g FROM names),
  held AS (SELECT DISTINCT source, ((h + i * g) % 18446744073709551616::HUGEINT) % m AS place FROM k JOIN hashed USING (key) JOIN sized USING (source), range(0, 64) r(i) WHERE i < c),
  wanted AS (SELECT asked, source, ((h + i * g) % 18446744073709551616::HUGEINT) % m AS place FROM asked JOIN hashed ON asked = key, sized, range(0, 64) r(i) WHERE i < c),
  maybe AS (SELECT w.asked, w.source, bool_and(h.place IS NOT NULL) AS maybe FROM wanted w LEFT JOIN held h ON w.source = h.source AND w.place = h.place GROUP BY 1, 2),
  seen AS (SELECT a.asked, s.source, newest, CASE WHEN asked < low OR asked > high THEN ['BOUNDS_SKIP'] WHEN NOT maybe THEN ['BLOOM_SKIP'] WHEN k.key IS NOT NULL THEN ['BLOOM_CHECK', 'SSTABLE_HIT'] ELSE ['BLOOM_CHECK', 'SSTABLE_MISS'] END AS steps
    FROM sized s JOIN maybe m USING (source) JOIN asked a USING (asked) LEFT JOIN k ON k.source = s.source AND k.key = a.asked),
  hits AS (SELECT asked, max(newest) FILTER (steps[-1] = 'SSTABLE_HIT') AS hit FROM seen GROUP BY asked),
  met AS (SELECT asked, source, newest, unnest(steps) AS step, unnest(range(0, len(steps))) AS i FROM seen JOIN hits USING (asked) WHERE hit IS NULL OR newest >= hit UNION ALL SELECT asked, NULL, -1, 'NOT_FOUND', 0 FROM hits WHERE hit IS NULL)
  SELECT asked AS key, (row_number() OVER (PARTITION BY asked ORDER BY newest DESC, source, i) - 1)::INTEGER AS place, source, step FROM met""")
def explain_get_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads of a few keys meet in the log's segments, those of keys that aren't there included."""
    return explain.get_steps(event_log(spark, sf_dir), list(_ASKED))


@_query(f"WITH {LOG} SELECT source, count(*) AS entries FROM log WHERE key >= 'user:2' AND key < 'user:5' GROUP BY source")
def explain_scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.scan_sources(event_log(spark, sf_dir), "user:2", "user:5")


@_query(f"WITH {LOG}, n AS (SELECT key, arg_max(kind, seq) AS kind, count(*) AS n FROM log WHERE key >= 'user:2' AND key < 'user:5' GROUP BY key) SELECT sum(n)::BIGINT AS entries, count(*) AS keys, sum((kind = 1)::INTEGER)::BIGINT AS live, (sum(n) - sum((kind = 1)::INTEGER))::BIGINT AS suppressed FROM n")
def explain_scan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.scan_merge(event_log(spark, sf_dir), "user:2", "user:5")


@_query("SELECT event_type, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits, least(64, greatest(1, floor(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2) + 0.5)))::BIGINT AS hashes FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, hashes = bloom.size_columns(F.col("n"), F.lit(0.01))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", bits.alias("bits"), hashes.cast("long").alias("hashes"))


@_query(f"""WITH k AS (SELECT DISTINCT 'user:' || user_id AS key FROM events), a AS (SELECT key, true AS there FROM k UNION ALL SELECT 'nobody:' || substr(key, 6), false FROM k UNION ALL SELECT key || 'x', false FROM k),
  b AS (SELECT key, there, {_FNV.format(key="key")} AS h, {_SALTED.format(key="key")} AS g FROM a), n AS (SELECT count(*) AS n, ceil(-count(*) * ln(0.05) / (ln(2) * ln(2)))::HUGEINT AS m FROM k), s AS (SELECT m, floor(m / n * ln(2) + 0.5) AS c FROM n),
  p AS (SELECT key, there, ((h + i * g) % 18446744073709551616::HUGEINT) % m AS place FROM b, s, range(0, 64) r(i) WHERE i < c)
  SELECT key, bool_and(place IN (SELECT place FROM p WHERE there)) AS might_contain FROM p GROUP BY key""")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filter over all users says about them and about keys that aren't there, after it was written and read again."""
    keys = _keys(spark, sf_dir)
    made = bloom.Bloom.from_bytes(bloom.build(keys, "key", max(1, keys.count()), 0.05).to_bytes())
    asked = keys.union(keys.select(F.concat(F.lit("nobody:"), F.substring("key", 6, 99)))).union(keys.select(F.concat("key", F.lit("x"))))
    return asked.select("key", bloom.might_contain(made)("key").alias("might_contain"))


@_query("SELECT event_id, 'key-' || lpad(event_id::VARCHAR, 10, '0') AS key FROM events")
def bench_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", workload.key_column(F.col("event_id")).alias("key"))


@_query("""WITH s AS (SELECT event_id, (xor(42::UBIGINT, ((event_id::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT))::UHUGEINT AS h0 FROM events),
  a AS (SELECT event_id, (h0 * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT AS h1 FROM s),
  b AS (SELECT *, (h1 * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT AS h2 FROM a),
  c AS (SELECT *, (h2 * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616::UHUGEINT AS h3 FROM b)
  SELECT event_id, lower(lpad(to_hex((h1 // 72057594037927936::UHUGEINT)::UBIGINT), 2, '0') || lpad(to_hex((h2 // 72057594037927936::UHUGEINT)::UBIGINT), 2, '0') || lpad(to_hex((h3 // 72057594037927936::UHUGEINT)::UBIGINT), 2, '0')) AS value FROM c""")
def bench_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three bytes of each event's generated value."""
    return _table(spark, sf_dir, "events").select("event_id", F.lower(F.hex(workload.value_column(3)(F.col("event_id")))).alias("value"))


@_query("SELECT " + ", ".join(f"list_sort(list(value))[((count(*) - 1) * {p} // 100) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM events WHERE value IS NOT NULL")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.percentiles(_table(spark, sf_dir, "events"), "value", [50, 95, 99])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_scan(spark, sf_dir)
