"""Exact nearest neighbours: cosine, squared L2 and dot product over ARRAY<FLOAT> columns, in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.model import DELETE, PUT, InvalidOptions, InvalidVector, require_id, require_vector
from marlstone.operators import kv
from marlstone.sources import files
from marlstone.sources.codecs import decode_column, decode_vector, encode_column, encode_vector
from marlstone.sources.store import Store

METRICS = ("cosine", "l2", "dot")


def _sum(a: Column, b: Column, f) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def score(a: Column, b: Column, metric: str) -> Column:
    """Higher is nearer: clamped cosine (-1 for a zero vector), minus the squared distance, or the dot product."""
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return -_sum(a, b, lambda x, y: (x - y) * (x - y))
    if metric == "cosine":
        na, nb = dot(a, a), dot(b, b)
        # CASE keeps the division from zero norms, which ANSI mode would reject.
        return F.when((na > 0) & (nb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))))).otherwise(F.lit(-1.0))
    raise InvalidOptions(f"no such metric: {metric}")


def distance(s: Column, metric: str) -> Column:
    return 1 - s if metric == "cosine" else -s


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def has_non_finite(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def invalid_reason(id_col: str, vector_col: str, dimension: int, metric: str) -> Column:
    """Why a row can't be stored, or null."""
    i, v = F.col(id_col), F.col(vector_col)
    checks = [
        (i.isNull() | (i == ""), "id is empty"), (i.rlike("[/\\x00-\\x1F]"), "id holds / or a control character"), (v.isNull() | (F.size(v) != dimension), "wrong dimension"),
        (F.exists(v, lambda x: x.isNull()) | has_non_finite(v), "a component is not finite"),
    ]
    if metric == "cosine":
        checks.append((is_zero(v), "the zero vector has no direction"))
    out = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        out = F.when(bad, F.lit(why)).otherwise(out)
    return out


def usable(v: Column, dimension: int) -> Column:
    """Vectors of this size whose components are all there and finite; others can't be scored."""
    return F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", dimension: int | None = None) -> DataFrame:
    """The k nearest (id, score, distance, and other columns): by score, then id. k beyond the table gives all.

    The query's size is the dimension unless one is given. Rows with a null vector, another size, or a component that
    is null or not finite take no part.
    """
    if k <= 0:
        raise InvalidOptions("k must be positive")
    require_vector(list(query), dimension or len(query), metric)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(usable(F.col(vector_col), len(query))).withColumn("score", score(F.col(vector_col), q, metric)).withColumn("distance", distance(F.col("score"), metric))
    return scored.orderBy(F.desc("score"), id_col).limit(k).drop(vector_col)


#: Queries of a block and bytes of it, at most: they are held by every task. Rows that are scored at once.
BLOCK_QUERIES, BLOCK_BYTES, ROWS = 2048, 32 << 20, 4096
#: Scores this close to the k-th best, relative to their size, are made again in one fixed order before they are ranked.
CLOSE = 1e-9


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows against one query, each row for itself, so that equal rows have equal scores."""
    if metric == "l2":
        return -((x - q) ** 2).sum(axis=1)
    out = (x * q).sum(axis=1)
    if metric == "cosine":
        norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
        out = np.where(norms > 0, np.clip(out / np.where(norms > 0, norms, 1), -1, 1), -1.0)
    return out


def _rough(x: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all rows against all queries by one product, and how far each query's may be off."""
    dots, xx, qq = x @ q.T, (x * x).sum(axis=1), (q * q).sum(axis=1)
    if metric == "l2":
        return 2 * dots - xx[:, None] - qq[None, :], CLOSE * (qq + xx.max(initial=0))
    if metric == "dot":
        return dots, CLOSE * np.sqrt(qq * xx.max(initial=0))
    norms = np.sqrt(xx)[:, None] * np.sqrt(qq)[None, :]
    return np.where(norms > 0, dots / np.where(norms > 0, norms, 1), -1.0), np.full(len(q), CLOSE)


def search_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest for each row (query_id, query) of ``queries``, by any number of queries: query_id, id, score, rank, distance.

    Queries go in blocks, dealt by a hash of the id, whose number of rows and bytes is bounded; a block is held by every
    task. A task scores its rows against the whole block by matrix products and hands on k rows a query at most. What
    ``search`` leaves out takes no part, and a query that can't be scored is an error.
    """
    if k <= 0:
        raise InvalidOptions("k must be positive")
    if metric not in METRICS:
        raise InvalidOptions(f"no such metric: {metric}")
    n, low, high = queries.agg(F.count(F.lit(1)), F.min(F.size("query")), F.max(F.size("query"))).first()
    id_type = vectors.select(id_col).schema[0].dataType.simpleString()
    query_type = queries.select("query_id").schema[0].dataType.simpleString()
    schema = f"query_id {query_type}, {id_col} {id_type}, score double"
    if n and low != high:
        raise InvalidVector("the queries differ in size")
    if n and queries.filter(~usable(F.col("query"), high) | (is_zero(F.col("query")) if metric == "cosine" else F.lit(False))).first():
        raise InvalidVector("a query has no direction, or components that aren't finite")
    rows = vectors.filter(usable(F.col(vector_col), high or 0)).select(F.col(id_col), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    out = None
    blocks = max(1, -(-n // BLOCK_QUERIES), -(-n * 8 * (high or 0) // BLOCK_BYTES))
    for b in range(blocks):
        some = queries.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("q"))
        some = (some.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else some).toPandas()
        if not len(some):
            continue
        nearest = rows.mapInPandas(_block_search(some["query_id"].tolist(), np.stack(some["q"].to_list()), k, metric, id_col), schema)
        out = nearest if out is None else out.unionByName(nearest)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("distance", distance(F.col("score"), metric))


def _block_search(names: list, q: np.ndarray, k: int, metric: str, id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, ids = [np.zeros(0)] * len(q), [np.zeros(0, object)] * len(q)
        for rows in batches:
            for at in range(0, len(rows), ROWS):
                part = rows.iloc[at : at + ROWS]
                x, own = np.stack(part["v"].to_list()), part[id_col].to_numpy(object)
                rough, off = _rough(x, q, metric)
                for j in range(len(q)):
                    floor = scores[j][-1] if len(scores[j]) == k else -np.inf
                    if len(x) > k:
                        floor = max(floor, np.partition(rough[:, j], -k)[-k] - off[j])
                    may = np.flatnonzero(rough[:, j] >= floor - off[j])
                    if not len(may):
                        continue
                    s, i = np.concatenate([scores[j], _scores(x[may], q[j], metric)]), np.concatenate([ids[j], own[may]])
                    best = sorted(range(len(s)), key=lambda r: (-s[r], i[r]))[:k]
                    scores[j], ids[j] = s[best], i[best]
        n = [len(s) for s in scores]
        if sum(n):
            yield pd.DataFrame({"query_id": [name for name, c in zip(names, n, strict=True) for _ in range(c)], id_col: np.concatenate(ids), "score": np.concatenate(scores)})

    return run


class VectorStore:
    """Vectors of a namespace in a durable store: keys are ``__vector__/<namespace>/<id>``, values are encoded records.

    Without a path the store lies in a scratch folder and goes with the driver.
    """

    def __init__(self, spark: SparkSession, dimension: int, metric: str = "cosine", namespace: str = "vector", path: str | None = None) -> None:
        if dimension <= 0 or metric not in METRICS:
            raise InvalidOptions("a store needs a positive dimension and a known metric")
        if not namespace or any(c in namespace for c in "/_\x00"):
            raise InvalidOptions(f"not a namespace: {namespace!r}")
        self.spark, self.dimension, self.metric, self.namespace = spark, dimension, metric, namespace
        self.store = Store(spark, path or files.scratch(spark, "vectors"))
        self.prefix = f"__vector__/{namespace}/".encode()

    def key(self, name: str) -> bytes:
        return self.prefix + require_id(name).encode()

    def record(self, vector: list[float], metadata: bytes | None = None) -> bytes:
        return encode_vector(require_vector([float(x) for x in vector], self.dimension, self.metric), metadata or b"")

    def upsert(self, name: str, vector: list[float], metadata: bytes | None = None) -> None:
        self.store.put(self.key(name), self.record(vector, metadata))

    def upsert_all(self, rows: DataFrame) -> int:
        """Rows (id, vector, metadata) at once; an invalid one rejects them all. Rows that repeat an id: the last by ``vector`` wins."""
        bad = rows.withColumn("why", invalid_reason("id", "vector", self.dimension, self.metric)).filter("why is not null").select("id", "why").first()
        if bad:
            raise InvalidVector(f"{bad['id']!r}: {bad['why']}")
        record = encode_column(self.dimension)(F.col("vector").cast("array<float>"), F.col("metadata").cast("binary"))
        key = F.concat(F.lit(self.prefix), F.col("id").cast("binary"))
        return self.store.write(rows.select(key.alias("key"), record.alias("value"), F.lit(PUT).alias("kind"), F.struct("id", "vector").alias("order")))

    def delete(self, name: str) -> None:
        """Nothing happens for an id that isn't there."""
        if self.store.get(self.key(name)) is not None:
            self.store.delete(self.key(name))

    def delete_all(self, ids: DataFrame) -> int:
        """The ids of column ``id`` at once; a tombstone for each."""
        key = F.concat(F.lit(self.prefix), F.col("id").cast("binary"))
        return self.store.write(ids.select(key.alias("key"), F.lit(None).cast("binary").alias("value"), F.lit(DELETE).alias("kind"), F.col("id").alias("order")))

    def live(self) -> DataFrame:
        """(id, vector, metadata)"""
        rows = kv.live(self.store.log().filter(kv.in_range(self.prefix, self.prefix + b"\xff")))
        made = rows.select(F.col("key").cast("string").substr(len(self.prefix) + 1, 1 << 30).alias("id"), decode_column(self.dimension)("value").alias("r"))
        return made.select("id", "r.vector", "r.metadata")

    def get(self, name: str) -> dict | None:
        raw = self.store.get(self.key(name))
        if raw is None:
            return None
        vector, metadata = decode_vector(raw, self.dimension)
        return {"id": name, "vector": vector.tolist(), "metadata": metadata}

    def search(self, query: list[float], k: int) -> DataFrame:
        return search(self.live(), [float(x) for x in query], k, self.metric, dimension=self.dimension)

    def count(self) -> int:
        return kv.live(self.store.log().filter(kv.in_range(self.prefix, self.prefix + b"\xff"))).count()

    def stats(self) -> dict:
        return self.store.stats() | {"vectors": self.count(), "dimension": self.dimension, "metric": self.metric, "namespace": self.namespace}

    def flush(self) -> None:
        self.store.flush()

    def compact(self) -> None:
        self.store.compact()

    def close(self) -> None:
        self.store.close()
