"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(64 x). With one more coordinate, sqrt(M^2 - |v|^2) for the longest length M, all of them
lie on a sphere around the queries' end of that axis, and |q - v|^2 = |q|^2 + M^2 - 2 q.v: the largest inner products
are the nearest vectors. Each vector is keyed by its nearest pivot and its distance to it; around a pivot the vectors of
a cell stand in the order of that distance. A block of queries first searches the cells its own queries fall in, which
bounds each query's k-th distance, then visits the cells whose annulus can hold something nearer: by the triangle
inequality |d(q, pivot) - d(v, pivot)| bounds d(q, v) from below. Inside a cell annuli are expanded from the query's own
distance outwards until that bound exceeds the k-th distance. Distances only prune, with a margin for rounding. Scores
are whole numbers: below 2^53 doubles hold them exactly, beyond that they are made in 64-bit integers.

Queries are a stated share of all rows, so they are no broadcast: blocks of them are sent to the cells that they need,
and a cell that very many need is there in several copies.

Defined results: vectors that are null, empty, or that hold null or non-finite components take no part. Vectors of
different widths have no inner product; each width is searched for itself. Every row is a row of its own, also where ids
repeat: a query's candidates are all rows but its own row, and rows that repeat a query's id each have an answer. Ties go
to smaller ids. A score that leaves 64 bits is an error where the search meets it, and vectors with M^2 of 2^100 or more
are refused. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import common

#: Pivots; vectors that they are chosen from, at most.
PIVOTS, SAMPLE = 32, 4096
#: Vectors of a cell: a 64th of all, within these bounds. Queries of a block, about.
LEAST_CELL, CELL, BLOCK = 256, 16384, 512
#: Rows of an annulus that are scored at once.
ANNULUS = 512
#: Queries that one copy of a cell answers, about.
CELL_QUERIES = 8192
#: Margin of the bounds for the rounding of distances, as a part of the lengths.
MARGIN = 1e-7
#: Sums up to this are exact in doubles; scores must stay below the second (up to rounding), squared lengths below the third.
EXACT, MOST_SCORE, MOST = 2**53, 2**63 * (1 - 1e-6), 2**100
#: No score yet, and no id.
NONE, NO_ID = -(2**63) + 1, 2**63 - 1

RESULT = "query_id long, rank int, vec_id long, score long"


def integers(column: str, factor: int = 64) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def usable(column: str) -> Column:
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & ~bad, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.zeros((0, 1), np.int64)


def _lift(x: np.ndarray, squared: float) -> np.ndarray:
    """The coordinate that puts candidates at one distance from the origin."""
    return np.sqrt(np.maximum(squared - (x * x).sum(axis=1), 0))


def farthest_points(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots from a sample: each the point farthest from those before."""
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, lift: np.ndarray | float, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    own = (x * x).sum(axis=1)[:, None] + (np.asarray(lift) ** 2 * np.ones(len(x)))[:, None]
    sq = own + ((pivots * pivots).sum(axis=1) + pivot_lift**2)[None, :] - 2 * (x @ pivots.T + (np.asarray(lift) * np.ones(len(x)))[:, None] * pivot_lift[None, :])
    return np.sqrt(np.maximum(sq, 0))


class Best:
    """The k best (score, id) of each query, all queries at once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.s, self.i = np.full((queries, k), NONE, np.int64), np.full((queries, k), NO_ID, np.int64)

    def add(self, owner: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """(owner, score, id) in any order."""
        mine = np.unique(owner)
        if not len(mine):
            return
        o, s, i = np.concatenate([owner, np.repeat(mine, self.k)]), np.concatenate([scores, self.s[mine].ravel()]), np.concatenate([ids, self.i[mine].ravel()])
        order = np.lexsort((i, -s, o))
        first = np.searchsorted(o[order], mine)
        best = order[first[:, None] + np.arange(self.k)]
        self.s[mine], self.i[mine] = s[best], i[best]

    @property
    def kth(self) -> np.ndarray:
        return self.s[:, -1]

    @property
    def scores(self) -> list[np.ndarray]:
        return [s[s != NONE] for s in self.s]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, score and id of all that was found."""
        owner, at = np.nonzero(self.s != NONE)
        return owner, self.s[owner, at], self.i[owner, at]


def search_cell(ids: np.ndarray, x: np.ndarray, to_pivot: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_pivot: np.ndarray, floor: np.ndarray, squared: float, k: int, rows: np.ndarray | None = None, q_rows: np.ndarray | None = None) -> Best:
    """The k best of a cell for each query that can reach its floor (a score), by expanding annuli.

    Rows stand by distance to the pivot. For a query at distance a from it and k-th best score s, only rows within
    sqrt(|q|^2 + M^2 - 2 s) of a can score s or more. ``rows`` and ``q_rows`` tell a query's own row (else the ids do).
    """
    rows, q_rows = (ids, q_ids) if rows is None else (rows, q_rows)
    best, qf = Best(len(q_ids), k), q.astype(np.float64)
    norms = (qf * qf).sum(axis=1) + squared
    starts = np.arange(0, len(ids), ANNULUS)
    low, high = to_pivot[starts], to_pivot[np.minimum(starts + ANNULUS, len(ids)) - 1]
    gap = np.maximum(np.maximum(low[None, :] - q_pivot[:, None], q_pivot[:, None] - high[None, :]), 0)
    floor = np.asarray(floor)
    bound = np.where(np.isfinite(floor), floor, NONE).astype(np.int64) if floor.dtype.kind == "f" else floor.copy()
    for a in np.argsort(gap.min(axis=0), kind="stable"):
        reach = np.sqrt(np.maximum(norms - 2 * np.maximum(bound.astype(np.float64), -norms), 0)) * (1 + MARGIN) + MARGIN * np.sqrt(norms) + 1e-6
        active = np.flatnonzero((gap[:, a] <= reach) | (bound == NONE))
        if not len(active):
            continue
        part = slice(starts[a], min(starts[a] + ANNULUS, len(ids)))
        others = rows[part][None, :] != q_rows[active][:, None]
        if squared < EXACT:
            scores = (qf[active] @ x[part].astype(np.float64).T).astype(np.int64)
        else:
            if np.abs(np.where(others, qf[active] @ x[part].astype(np.float64).T, 0)).max() >= MOST_SCORE:
                raise ValueError("a score leaves 64 bits")
            scores = q[active].astype(np.int64) @ x[part].astype(np.int64).T  # sums may wrap on their way
        may = (scores >= bound[active][:, None]) & others
        if k < part.stop - part.start:  # of many, the k best scores and their ties are enough
            masked = np.where(may, scores, NONE)
            may &= masked >= np.partition(masked, -k, axis=1)[:, -k][:, None]
        at, col = np.nonzero(may)
        best.add(active[at], scores[at, col], ids[part][col])
        bound = np.maximum(bound, best.kth)
    return best


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row that ``is_query`` names, against all rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable("raw") & F.col("id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "id", integers("raw").alias("v"), "asks")
    whole = common.settle(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "vectors")
    widths = whole.groupBy(F.size("v").alias("w")).agg(F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    if any(r["m"] >= MOST for r in widths):
        raise ValueError("vectors are too long for whole scores")
    out = common.empty(vectors.sparkSession, RESULT)
    for r in sorted(widths):
        found = _search_width(whole if len(widths) == 1 else whole.filter(F.size("v") == r["w"]), r["n"], float(r["m"]), k, pivots)
        out = found if len(widths) == 1 else out.unionByName(found)
    return out


def _search_width(whole: DataFrame, count: int, squared: float, k: int, pivots: int) -> DataFrame:
    spark = whole.sparkSession
    # Pivots from a sample of SAMPLE vectors at most.
    sample = _matrix(common.sample_by_hash(whole.select("v", "id", "row"), SAMPLE, [F.col("v"), F.col("id"), F.col("row")], count).toPandas()["v"]).astype(np.float64)
    lifted = np.hstack([sample, _lift(sample, squared)[:, None]])
    chosen = farthest_points(lifted, pivots)
    points, point_lift = chosen[:, :-1], chosen[:, -1]
    width = points.shape[1]

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            f = x.astype(np.float64)
            d = distances(f, _lift(f, squared), points, point_lift)
            near = d.argmin(axis=1)
            yield pd.DataFrame({"row": b["row"], "id": b["id"], "v": [r.astype("<i8").tobytes() for r in x], "pivot": near, "r": d[np.arange(len(x)), near]})

    keyed = common.settle(whole.select("row", "id", "v").mapInPandas(key, "row long, id long, v binary, pivot int, r double"), "keyed")
    # Annuli of a pivot by quantiles of the distance, then parts of an annulus where it holds too many: every cell's
    # size is bounded even if a third of the vectors are equal. There are pivots x 16 annuli at most to be counted here.
    edges = common.settle(keyed.groupBy(F.col("pivot").alias("e")).agg(F.percentile_approx("r", [i / 16 for i in range(1, 16)], 10000).alias("edges")), "annuli")
    ringed = keyed.join(F.broadcast(edges), F.col("pivot") == F.col("e")).withColumn("annulus", F.size(F.filter(F.array_distinct("edges"), lambda x: x < F.col("r")))).drop("e", "edges")
    most = min(CELL, max(LEAST_CELL, count // 64))
    counted = ringed.groupBy("pivot", "annulus").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    cells, part_of = [], []
    for r in sorted(counted, key=lambda r: (r["pivot"], r["annulus"])):
        # neighbouring small annuli of a pivot share a cell
        if cells and cells[-1][1] == r["pivot"] and cells[-1][4] + r["n"] <= most and part_of[-1][3] == 1:
            c = cells[-1]
            cells[-1] = (c[0], c[1], c[2], r["high"], c[4] + r["n"])
            part_of.append((r["pivot"], r["annulus"], c[0], 1))
            continue
        parts = max(1, round(r["n"] / most))
        part_of.append((r["pivot"], r["annulus"], len(cells), parts))
        cells += [(len(cells) + i, r["pivot"], r["low"], r["high"], -(-r["n"] // parts)) for i in range(parts)]
    where = spark.createDataFrame([tuple(map(int, x)) for x in part_of], "p int, a int, first int, parts int")
    placed = ringed.join(F.broadcast(where), (F.col("pivot") == F.col("p")) & (F.col("annulus") == F.col("a")))
    indexed = common.settle(placed.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int").alias("cell"), "row", "id", "v", "pivot", "r"), "pivot-index")

    cell_no = np.array([c[0] for c in cells])
    cell_pivot = np.array([c[1] for c in cells])
    cell_low, cell_high = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            d = distances(x.astype(np.float64), 0.0, points, point_lift)
            yield pd.DataFrame({"row": b["row"], "id": b["id"], "v": [r.astype("<i8").tobytes() for r in x], "to_pivots": [r.astype("<f8").tobytes() for r in d], "near": d.argmin(axis=1)})

    asking = common.settle(whole.filter("asks").select("row", "id", "v").mapInPandas(ask, "row long, id long, v binary, to_pivots binary, near int"), "queries")
    # Queries near the same pivot stand together, so that a block needs few cells.
    near_pivot = {r["near"]: r["count"] for r in asking.groupBy("near").count().collect()}  # a row a pivot
    asked, part = sum(near_pivot.values()), F.lit(1)
    for p, n in near_pivot.items():
        part = F.when(F.col("near") == p, F.lit(-(-n // BLOCK))).otherwise(part)
    asking = asking.withColumn("block", (F.col("near") * (1 << 32) + F.pmod(F.xxhash64("row"), part)).cast("long")).withColumn("floor", F.lit(NONE).cast("long"))

    def needed(g: pd.DataFrame, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The queries, their distances to pivots, their floors, and which cells may hold something as good as that."""
        q = np.frombuffer(b"".join(g["v"]), "<i8").reshape(len(g), width)
        to_pivots = np.frombuffer(b"".join(g["to_pivots"]), "<f8").reshape(len(g), -1)
        floor, d = g["floor"].to_numpy(np.int64), to_pivots[:, cell_pivot]
        gap = np.maximum(np.maximum(cell_low[None, :] - d, d - cell_high[None, :]), 0)
        if first:  # the cell with the nearest annulus is enough for a floor
            need = np.zeros(gap.shape, bool)
            need[np.arange(len(g)), gap.argmin(axis=1)] = True
            return q, to_pivots, floor, need
        norms = (q.astype(np.float64) ** 2).sum(axis=1) + squared
        reach = np.sqrt(np.maximum(norms - 2 * np.maximum(floor.astype(np.float64), -norms), 0)) * (1 + MARGIN) + MARGIN * np.sqrt(norms) + 1e-6
        return q, to_pivots, floor, (gap <= reach[:, None]) | (floor == NONE)[:, None]

    def loads(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(cell_no), np.int64)
            for b in batches:
                if len(b):
                    n += needed(b, first)[3].sum(axis=0)
            yield pd.DataFrame({"cell": cell_no[n > 0], "n": n[n > 0]})

        return run

    def send(first: bool, copies: dict[int, int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, g in b.groupby("block"):
                    q, d, floor, need = needed(g, first)
                    row, ident, out = g["row"].to_numpy(np.int64), g["id"].to_numpy(np.int64), []
                    for c in np.flatnonzero(need.any(axis=0)):
                        w, cell = need[:, c], int(cell_no[c])
                        copy = hash(int(block)) % copies.get(cell, 1)
                        out.append((cell, copy, row[w].tobytes(), ident[w].tobytes(), q[w].tobytes(), np.ascontiguousarray(d[w, cell_pivot[c]]).tobytes(), floor[w].tobytes()))
                    yield pd.DataFrame(out, columns=["cell", "copy", "rows", "ids", "q", "d", "floor"])

        return run

    def meet(_: tuple, cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cell) and len(queries):
            cell = cell.sort_values(["r", "id"])
            ids, own, r = cell["id"].to_numpy(np.int64), cell["row"].to_numpy(np.int64), cell["r"].to_numpy(float)
            x = np.frombuffer(b"".join(cell["v"]), "<i8").reshape(len(cell), width)
            weight = np.cumsum([len(i) // 8 for i in queries["ids"]]) // CELL_QUERIES
            for _, some in queries.groupby(weight):  # so many queries at once
                take = lambda c, kind, some=some: np.frombuffer(b"".join(some[c]), kind)
                q_rows, q_ids, d, floor = take("rows", "<i8"), take("ids", "<i8"), take("d", "<f8"), take("floor", "<i8")
                best = search_cell(ids, x, r, q_ids, take("q", "<i8").reshape(len(q_ids), width), d, floor, squared, k, own, q_rows)
                owner, score, found = best.found()
                out.append(pd.DataFrame({"query": q_rows[owner], "query_id": q_ids[owner], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    def visit(first: bool, queries: DataFrame) -> DataFrame:
        # A cell can only be too sought after if there are so many queries at all.
        copies: dict[int, int] = {}
        if asked > CELL_QUERIES:
            n = queries.mapInPandas(loads(first), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > CELL_QUERIES)
            copies = {r["cell"]: -(-r["n"] // CELL_QUERIES) for r in n.collect()}  # some of the cells, whose numbers are here already
        table = indexed.withColumn("copy", F.lit(0))
        if copies:
            many = spark.createDataFrame(list(copies.items()), "c int, copies int")
            table = indexed.join(F.broadcast(many), F.col("cell") == F.col("c"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("c", "copies")
        sent = queries.mapInPandas(send(first, copies), "cell int, copy int, rows binary, ids binary, q binary, d binary, floor binary")
        return table.groupBy("cell", "copy").cogroup(sent.groupBy("cell", "copy")).applyInPandas(meet, "query long, query_id long, vec_id long, score long")

    # The first visit: a floor for each query that found k candidates in its nearest cell.
    near = visit(True, asking).groupBy("query").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    floors = near.select(F.col("query").alias("f"), "s")
    known = common.settle(asking.drop("floor").join(floors, F.col("row") == F.col("f"), "left").withColumn("floor", F.coalesce("s", F.lit(NONE).cast("long"))).drop("f", "s"), "query-floors")
    found = visit(False, known)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
