"""Queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chat, dedup, licenses, mixing, packing, secrets, sharding, simhash, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.place <> c.place AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""

def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)


def op3_sql() -> str:
    """Phrases as slices of the list of words; templates by counting their distinct words in every window that begins with one."""
    phrases = [(p, len(p.split()), label) for p, label in licenses.PHRASES.items()]
    templates = [(k, [w.decode() for w in licenses.words(text)], label) for k, (label, text) in enumerate(licenses.TEMPLATES)]
    sizes = _values([(k, label, len(set(ws)), math.ceil(licenses.THRESHOLD * len(set(ws)) - 1e-9), max(len(ws), math.ceil(licenses.SLACK * len(ws)))) for k, ws, label in templates])
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT * FROM (VALUES {_values(phrases)}) AS t(phrase, n, label)),
found AS (SELECT place, label, unnest(list_filter(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1:i + n], ' ') = phrase)) AS start FROM d, p WHERE len(ws) >= n),
base AS (SELECT place, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY place),
t AS (SELECT * FROM (VALUES {sizes}) AS t(k, label, size, need, width)),
tw AS (SELECT * FROM (VALUES {_values(sorted({(k, w) for k, ws, _ in templates for w in ws}))}) AS t(k, word)),
hit AS MATERIALIZED (SELECT place, k, pos, word FROM (SELECT place, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d) JOIN tw USING (word)),
window_ AS (SELECT a.place, a.k, a.pos, count(DISTINCT b.word) AS held FROM hit a JOIN t USING (k) JOIN hit b ON b.place = a.place AND b.k = a.k AND b.pos >= a.pos AND b.pos < a.pos + width GROUP BY 1, 2, 3),
best AS (SELECT place, label, max(held / size) AS contained FROM window_ JOIN t USING (k) WHERE held >= need GROUP BY place, label),
every AS (SELECT place, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(contained) AS contained FROM (SELECT place, label, contained FROM best UNION ALL SELECT DISTINCT place, label, 0.0 FROM found) GROUP BY place)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(contained, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (place) LEFT JOIN every USING (place)
"""


def op4_sql(shards: int = 8) -> str:
    """The CRC and the greedy walk as folds over lists; the capacity by halving between bounds.

    Where a group is over an even share, the operator goes on where this walk ends; the tables have no such group.
    """
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    walk = f"list_reduce(list_prepend({{'used': 1::BIGINT, 'load': 0::BIGINT}}, list_transform(sizes, lambda s: {{'used': 0::BIGINT, 'load': s}})), lambda a, b: CASE WHEN a.load + b.load > ({{c}}) THEN {{'used': a.used + 1, 'load': b.load}} ELSE {{'used': a.used, 'load': a.load + b.load}} END)"
    walk = walk.replace("{{", "{").replace("}}", "}")
    fits = walk.replace("({c})", "((low + high) // 2)") + f".used <= {shards}"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS digest FROM documents),
r AS MATERIALIZED (SELECT doc_id, digest, strlen(t) + 1 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1]))) AS text_crc32 FROM d),
g AS MATERIALIZED (SELECT digest, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY digest) AS n FROM r GROUP BY digest),
l AS MATERIALIZED (SELECT list(size ORDER BY n) AS sizes, max(size) AS largest, sum(size)::BIGINT AS total FROM g),
b AS (
  SELECT greatest(largest, (total + {shards - 1}) // {shards})::BIGINT AS low, (total // {shards} + largest + 1)::BIGINT AS high FROM l
  UNION ALL SELECT CASE WHEN {fits} THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN {fits} THEN (low + high) // 2 ELSE high END FROM b, l WHERE low < high),
c AS MATERIALIZED (SELECT low AS capacity FROM b WHERE low >= high LIMIT 1),
w AS (SELECT n, 0 AS shard, size AS load, digest FROM g WHERE n = 1
  UNION ALL SELECT g.n, CASE WHEN load + g.size > capacity THEN shard + 1 ELSE shard END, CASE WHEN load + g.size > capacity THEN g.size ELSE load + g.size END, g.digest FROM w JOIN g ON g.n = w.n + 1, c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r.digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard, capacity
FROM r JOIN w USING (digest), c
"""


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'anonymous' ELSE role END AS speaker, coalesce(text, '') AS raw FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.*, perspective, replace(raw, '<|', '<\|') AS text, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role, regexp_replace(speaker, '[\x00-\x1F\x7F<|>]', '_', 'g') AS shown
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || shown ELSE '' END || chr(10) AS head, md5(speaker || chr(10) || raw) AS place FROM r),
e AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM h)
SELECT conv_id, perspective, turn, place, speaker, role, CASE WHEN role = 'user' THEN shown END AS name, piece,
  coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at,
  (role = 'assistant')::INTEGER AS loss, CASE WHEN role = 'assistant' THEN length(head) END AS loss_from, CASE WHEN role = 'assistant' THEN length(piece) END AS loss_to
FROM e
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n),
m AS (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 AS mid FROM t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256, g.keep_id <= m.mid AS known
FROM t JOIN g USING (n), m
"""

QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_pivot_topk, op2_secret_scan, op3_license_scan, op4_sharding, op5_chat_rotation, op6_mixing, op7_packing, op8_toxicity, op9_simhash, op10_exact_dedup)}
ORACLES: dict[str, str] = {"op1_pivot_topk": OP1_SQL, "op3_license_scan": op3_sql(), "op4_sharding": op4_sql(), "op5_chat_rotation": OP5_SQL, "op10_exact_dedup": OP10_SQL}
