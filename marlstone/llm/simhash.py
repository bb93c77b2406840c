"""SimHash near-dedup with vantage-point trees over Hamming distance.

Fingerprints are made where the texts lie; equal ones become one row. A tree of vantage points, fitted on a bounded
sample, divides the fingerprints into shards: below each vantage point the near half and the far half. A fingerprint
is a member of one shard and, by the triangle inequality, has to be looked for in every other shard whose border is
within the radius of it; it visits those of a higher number, so that each pair meets once. Inside a shard a further
tree, in memory, does the same down to small leaves that are compared whole. Only a spanning forest of a shard's links
leaves it, so a group of thousands of near copies costs a row each, and loses no link between its members' components.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like any other. Null ids
never name a component, unless all ids in it are null. Repeated rows stay rows, and rows that share an id but not a
text link each by its own text. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Words of a shingle; bits in which linked fingerprints may differ at most; seed of the shingles' XXH64.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints that the tree of shards is fitted on, at most; members that a shard
#: should have; shards at least (a small input is still spread).
SAMPLE, SHARD_ROWS, LEAST_SHARDS = 65536, 65536, 64
#: Members of a leaf that are compared whole; fingerprints of a shard that a tree of its own is fitted on, for each leaf.
LEAF, LEAF_SAMPLE = 96, 64
#: Bits of a position beside a distance, and what stands for no partner.
PLACES, ALONE = 40, np.iinfo(np.int64).max
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: The general rule for near copies, apart from the contract of ``near_dedup``: words of a shingle, the least similarity, and the
#: bits within which the tree looks for them.
RULE_SHINGLE, SIMILAR, WIDE = 5, 0.8, 12
#: Bands of minima, and minima of a band: a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
#: Bits by which pairs that can't be similar are told before their sets are read.
CELLS = 2048


def fingerprint(text: str) -> int:
    """Words are cut at [\\x20\\x09-\\x0D], which is what bytes.split() does; bytes.lower() lowers A-Z alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, mark): the fingerprint's 64 bits as a long, and a hash of the raw text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen: dict[str, int] = {}
            out = np.empty(len(rows), "<u8")
            for i, text in enumerate(rows["text"]):
                text = text or ""
                if text not in seen:
                    seen[text] = fingerprint(text)
                out[i] = seen[text]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "fp": out.view(np.int64), "mark": rows["mark"]})

    docs = common.require(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(common.text_or_empty()).alias("mark"))
    return docs.mapInPandas(run, "doc_id long, fp long, mark long")


class Tree:
    """Vantage points in heap order (children of i: 2i + 1, 2i + 2). Those within ``radii[i]`` go to the first child.

    A leaf may have grown a tree of its own (``grown``); shards are then numbered by its leaves, after those before.
    """

    def __init__(self, points: np.ndarray, radii: np.ndarray, depth: int) -> None:
        self.points, self.radii, self.depth = points, radii, depth
        self.grown: dict[int, Tree] = {}
        self._number()

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, radius: int = RADIUS) -> Tree:
        """Of a few candidates, the vantage point and radius that divide best and have the fewest at the border."""
        points, radii = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 32, np.int64)
        parts = [sample]
        for level in range(depth):
            halves = []
            for k, part in enumerate(parts):
                i = (1 << level) - 1 + k
                points[i], radii[i] = choose(part, radius) if len(part) else (np.uint64(0), 32)
                near = np.bitwise_count(part ^ points[i]) <= radii[i]
                halves += [part[near], part[~near]]
            parts = halves
        return cls(points, radii, depth)

    def _number(self) -> None:
        sizes = np.ones(1 << self.depth, np.int64)
        for leaf, tree in self.grown.items():
            sizes[leaf] = tree.shards
        self.first, self.shards = np.cumsum(sizes) - sizes, int(sizes.sum())

    def grow(self, trees: dict[int, Tree]) -> None:
        """Trees for shards, by their present numbers; all numbers change."""
        for leaf in np.unique(np.searchsorted(self.first, sorted(trees), side="right") - 1).tolist():
            inside = {s - int(self.first[leaf]): t for s, t in trees.items() if self.first[leaf] <= s < self.first[leaf] + (self.grown[leaf].shards if leaf in self.grown else 1)}
            if leaf in self.grown:
                self.grown[leaf].grow(inside)
            else:
                self.grown[leaf] = inside[0]
        self._number()

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, shard and whether it is the home shard, for each shard that a ball around a fingerprint reaches."""
        at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int64)
            r = self.radii[node]
            near, far = d - radius <= r, d + radius > r
            at, node, home = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]), np.concatenate([home[near] & (d <= r)[near], home[far] & (d > r)[far]])
        leaf = node - ((1 << self.depth) - 1)
        if not self.grown:
            return at, leaf, home
        whole = ~np.isin(leaf, list(self.grown))
        parts = [(at[whole], self.first[leaf[whole]], home[whole])]
        for one, tree in self.grown.items():
            mine = np.flatnonzero(leaf == one)
            if len(mine):
                inner, shard, inside = tree.visits(fps[at[mine]], radius)
                parts.append((at[mine][inner], self.first[one] + shard, home[mine][inner] & inside))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def choose(part: np.ndarray, radius: int = RADIUS, candidates: int = 8) -> tuple[np.uint64, int]:
    """The vantage point and radius with the fewest at the border and the evenest halves."""
    best = (-1.0, part[0], 0)
    radii = np.arange(64)
    low, high = np.maximum(radii - radius, -1) + 1, np.minimum(radii + radius, 64) + 1
    for v in part[np.linspace(0, len(part) - 1, min(candidates, len(part))).astype(int)]:
        near = np.cumsum(np.bincount(np.bitwise_count(part ^ v), minlength=65))
        small = np.minimum(near[:64], len(part) - near[:64]) / len(part)
        border = np.diff(np.concatenate([[0], near]).take(np.stack([low, high])), axis=0)[0] / len(part)
        value = np.where(small >= 0.25, 1 - border + small, small)  # a quarter on the smaller side, if there is such a radius
        r = int(np.argmax(value))
        best = max(best, (float(value[r]), v, r), key=lambda x: x[0])
    return best[1], best[2]


def _roots(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = up[x]
    while not np.array_equal(up[r], r):
        r = up[r]
    up[x] = r
    return r


def join_pairs(up: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
    """Union of many pairs at once: larger roots are hooked below smaller ones until every pair shares its root."""
    while len(u):
        u, w = _roots(up, u), _roots(up, w)
        apart = u != w
        u, w = u[apart], w[apart]
        np.minimum.at(up, np.maximum(u, w), np.minimum(u, w))


def close_pairs(fps: np.ndarray, member: np.ndarray, radius: int, nearest: np.ndarray | None = None) -> np.ndarray:
    """The smallest position in each position's component, over all pairs within the radius of which one is a member.

    ``nearest`` (all ALONE before) takes the distance and position of each position's nearest partner in these pairs, as one number.
    """
    up = np.arange(len(fps))
    work = [(np.flatnonzero(member), np.arange(len(fps)), 0)]
    while work:
        mine, asking, depth = work.pop()
        if not len(mine) or not len(asking):
            continue
        if len(mine) > LEAF and depth < 60:
            v, r = choose(fps[mine][:: max(1, len(mine) // 1024)], radius)
            near = np.bitwise_count(fps[mine] ^ v) <= r
            if near.any() and not near.all():
                d = np.bitwise_count(fps[asking] ^ v).astype(np.int64)
                work.append((mine[near], asking[d - radius <= r], depth + 1))
                work.append((mine[~near], asking[d + radius > r], depth + 1))
                continue
        step = max(1, 2_000_000 // len(mine))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            bits = np.bitwise_count(fps[some][:, None] ^ fps[mine][None, :])
            a, b = np.nonzero(bits <= radius)
            if nearest is not None:
                far, u, w = bits[a, b].astype(np.int64) << PLACES, some[a], mine[b]
                other = u != w
                np.minimum.at(nearest, u[other], (far | w)[other])
                np.minimum.at(nearest, w[other], (far | u)[other])
            join_pairs(up, some[a], mine[b])
    return _roots(up, np.arange(len(fps)))


def _shard_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Members and visitors of one shard: each fingerprint that has a partner, with the first one of its tree."""
    fps = rows["fp"].to_numpy(np.int64)
    root = close_pairs(fps.view(np.uint64), rows["home"].to_numpy(bool), RADIUS)
    linked = root != np.arange(len(fps))
    return pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]})


def fit_tree(distinct: DataFrame, rows: int, shard_rows: int = SHARD_ROWS, radius: int = RADIUS, least: int | None = None) -> Tree:
    """A tree over a sample of SAMPLE fingerprints at most, taken by the hash of the fingerprint: reruns agree.

    Shards that hold more than twice what they should grow trees of their own, from samples of their own members that are
    fitted where these lie, until none does or can be divided; the driver has the vantage points alone, two for each
    ``shard_rows`` fingerprints or so.
    """
    sample = common.sample_by_hash(distinct.select("fp"), SAMPLE, [F.col("fp")], rows).collect()
    fps = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    depth, wanted = 0, max(LEAST_SHARDS if least is None else least, rows // shard_rows)
    while (1 << depth) < wanted and (len(fps) >> (depth + 1)) >= 16:
        depth += 1
    tree, stuck = Tree.fit(fps, depth, radius), set()
    while True:
        sizes = {r["shard"]: r["n"] for r in _homes(distinct, tree).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * shard_rows).collect()}
        wide = {s: n for s, n in sizes.items() if n not in stuck}
        if not wide:
            return tree
        depths = {s: min(10, max(1, int(np.ceil(np.log2(n / shard_rows))))) for s, n in wide.items()}

        some = _homes(distinct, tree, {s: min(1.0, LEAF_SAMPLE * (1 << depths[s]) / n) for s, n in wide.items()})
        made = some.groupBy("shard").applyInPandas(_fitted(depths, radius), "shard long, points binary, radii binary").collect()
        tree.grow({r["shard"]: Tree(np.frombuffer(r["points"], np.uint64), np.frombuffer(r["radii"], np.int64), depths[r["shard"]]) for r in made})
        stuck |= set(wide.values())  # a shard that comes out as large as it went in can't be divided


def _fitted(depths: dict[int, int], radius: int):
    def run(shard: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t = Tree.fit(np.sort(part["fp"].to_numpy(np.int64)).view(np.uint64), depths[shard[0]], radius)
        return pd.DataFrame({"shard": [shard[0]], "points": [t.points.tobytes()], "radii": [t.radii.tobytes()]})

    return run


def _homes(distinct: DataFrame, tree: Tree, share: dict[int, float] | None = None) -> DataFrame:
    """(shard, fp): each fingerprint with its home shard; with ``share`` so large a part of the shards that it names alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = rows["fp"].to_numpy(np.int64)
            at, shard, home = tree.visits(fps.view(np.uint64), 0)
            shard, own = shard[home], fps[at[home]]
            if share is not None:
                with np.errstate(over="ignore"):
                    mixed = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                kept = mixed < np.array([share.get(x, 0.0) for x in shard.tolist()]) * 2.0**32
                shard, own = shard[kept], own[kept]
            yield pd.DataFrame({"shard": shard, "fp": own})

    return distinct.select("fp").mapInPandas(run, "shard long, fp long")


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between fingerprints that join the same ones as all pairs within the radius do."""
    tree = fit_tree(distinct, distinct.count(), shard_rows)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = rows["fp"].to_numpy(np.int64)
            at, shard, home = tree.visits(fps.view(np.uint64), RADIUS)
            own = np.zeros(len(rows), np.int64)
            own[at[home]] = shard[home]
            keep = shard >= own[at]
            yield pd.DataFrame({"shard": shard[keep], "fp": fps[at[keep]], "home": home[keep]})

    routed = distinct.select("fp").mapInPandas(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(_shard_links, "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, least): the smallest node that each linked node reaches, by alternating stars.

    Large star: a node's larger neighbours go to its smallest one. Small star: a node and its smaller neighbours do.
    Both hold components together; they end as stars around the smallest nodes. Each round is settled as a table, so
    the lineage stays short, and minima are taken before the shuffle, so a hub costs no task more than others.
    """
    now = common.settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
        large = common.settle(both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k"))
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = common.settle(small, "small-star")
        same = now.count() == after.count() and now.exceptAll(after).isEmpty()
        common.drop(now)
        common.drop(large)
        now = after
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least"))
    raise RuntimeError("the components didn't settle")


def _components_of(documents: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, mark) for each row, and (f, root, component_id) for each fingerprint."""
    made = common.settle(fingerprints(documents), "fingerprints")
    distinct = common.settle(made.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    joined = components(links(distinct, shard_rows))
    placed = common.settle(distinct.join(joined, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), "id", F.coalesce("least", "fp").alias("root")), "placed")
    smallest = placed.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "r")
    return made, common.settle(placed.join(smallest, F.col("root") == F.col("r")).select("f", "root", "component_id"), "named")


def near_dedup(documents: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links."""
    made, named = _components_of(documents, shard_rows)
    # Both sides are tables: a fingerprint that a third of the rows share is split by the adaptive skew join.
    return made.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _name(i: Column, m: Column) -> Column:
    return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), m.cast("string"))


def keep_one(documents: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each group of near copies, with all columns: that with the smallest id (null ids last)."""
    made, named = _components_of(documents, shard_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    stays = made.groupBy("fp").agg(first.alias("w")).join(named, F.col("fp") == F.col("f")).groupBy("root").agg(F.min("w").alias("w"))
    kept = stays.select(_name(F.col("w.id"), F.col("w.mark")).alias("k"))
    return common.keep_keyed(documents, _name(F.col("doc_id").cast("long"), F.xxhash64(common.text_or_empty())), kept)


def shingle_set(text: str) -> np.ndarray:
    """The hashes of a text's distinct RULE_SHINGLE-word shingles, ascending; words are cut and lowered as in ``fingerprint``.

    A shorter text is one shingle, a text without words the shingle of no words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - RULE_SHINGLE + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + RULE_SHINGLE]), SEED) for i in range(n)], "<u8"))


def cells(shingles: np.ndarray) -> np.ndarray:
    """CELLS bits, those set that a shingle falls on: a bit that another set lacks stands for a shingle at least that it lacks."""
    bits = np.zeros(CELLS, np.uint8)
    bits[shingles % np.uint64(CELLS)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64), rng.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band of BAND_ROWS minima; sets of similarity j share a given one with probability j ** BAND_ROWS."""
    least = np.full(len(xors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        h = (shingles[at : at + 4096, None] ^ xors) * factors
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))], "<u8")


def sketches(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, n, s, bands): a hash of the raw text, its fingerprint, and of its set of shingles size, hash and band keys."""
    xors, factors = _permutations()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            s, fp, n, bands = np.empty(len(rows), "<u8"), np.empty(len(rows), "<u8"), np.empty(len(rows), np.int64), []
            for i, text in enumerate(rows["text"]):
                shingles = shingle_set(text or "")
                fp[i], n[i] = fingerprint(text or ""), len(shingles)
                s[i] = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
                bands.append(band_keys(shingles, xors, factors).view(np.int64))
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "mark": rows["mark"], "fp": fp.view(np.int64), "n": n, "s": s.view(np.int64), "bands": bands})

    docs = common.require(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(common.text_or_empty()).alias("mark"))
    return docs.mapInPandas(run, "doc_id long, mark long, fp long, n long, s long, bands array<long>")


def near_pairs(nodes: DataFrame, least: float, radius: int = WIDE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs (a, b) of the sets in ``nodes`` (s, fp, n): each with its nearest by fingerprint, within the radius, and with the first of its tree.

    Shards, visits and trees in memory are those of ``links``. As sets of similarity ``least`` differ in size by that factor at
    most, a shard is divided by size into grades, and a fingerprint visits its own grade and the two beside it. Sets with one
    fingerprint and grade are one point, each paired with the first of them.
    """
    width = max(-np.log(least), 0.01) * (1 + 1e-9)
    graded = nodes.select("s", "fp", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(width))).alias("grade"))
    points = common.settle(graded.groupBy("fp", "grade").agg(F.min("s").alias("s")), "points")
    total = points.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    rows, most = total["all"] or 0, total["most"] or 1
    tree = fit_tree(points, rows, max(shard_rows, shard_rows * rows // most), radius, 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            fps, grade, s = (part[c].to_numpy(np.int64) for c in ("fp", "grade", "s"))
            at, shard, home = tree.visits(fps.view(np.uint64), radius)
            own = np.zeros(len(part), np.int64)
            own[at[home]] = shard[home]
            for step in (-1, 0, 1):  # a pair meets once: in the higher shard, or in the higher grade of one
                keep = (shard > own[at]) | ((shard == own[at]) & (step >= 0))
                i = at[keep]
                yield pd.DataFrame({"shard": shard[keep], "grade": grade[i] + step, "fp": fps[i], "s": s[i], "home": home[keep] & (step == 0)})

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        fps, s = part["fp"].to_numpy(np.int64), part["s"].to_numpy(np.int64)
        nearest = np.full(len(s), ALONE)
        root = close_pairs(fps.view(np.uint64), part["home"].to_numpy(bool), radius, nearest)
        at = np.flatnonzero(nearest != ALONE)
        return pd.DataFrame({"s": s[at], "bits": nearest[at] >> PLACES, "near": s[nearest[at] & ((1 << PLACES) - 1)], "first": s[root[at]]})

    met = points.select("fp", "grade", "s").mapInPandas(route, "shard long, grade long, fp long, s long, home boolean").groupBy("shard", "grade").applyInPandas(meet, "s long, bits long, near long, first long")
    best = met.groupBy("s").agg(F.min(F.struct("bits", "near"))["near"].alias("near"), F.min("first").alias("first"))
    one = points.select(F.col("fp").alias("f"), F.col("grade").alias("g"), F.col("s").alias("o"))
    twins = graded.join(one, (F.col("fp") == F.col("f")) & (F.col("grade") == F.col("g"))).select("s", "o")
    both = best.select("s", F.explode(F.array("near", "first")).alias("o")).union(twins)
    return common.settle(both.filter("s <> o").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct(), "near-pairs")


def _sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, shingles, cells) for the texts whose (id, mark, s) are in ``wanted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingle_set(text) for text in rows["text"]]
            yield pd.DataFrame({"s": rows["s"], "shingles": [x.view(np.int64) for x in sets], "cells": [cells(x) for x in sets]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"), F.xxhash64(common.text_or_empty()).alias("m"))
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark"))).select("s", "text")
    return found.mapInPandas(run, "s long, shingles array<long>, cells array<long>").dropDuplicates(["s"])


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets' exact Jaccard similarity is ``least`` or more."""
    of = lambda x: sets.select(F.col("s").alias(f"_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared >= F.lit(least) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _apart(open_: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a bucket in different components that the bound by CELLS bits lets through, each pair once.

    Most members of a large bucket are in one component by now; those aren't held against one another, only the others
    against them and among themselves. A pair that shares several buckets belongs to the first of them.
    """
    sized = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sized.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main")).withColumnRenamed("key", "k")
    marked = common.settle(open_.join(main, F.col("key") == F.col("k")).drop("k"), "open")
    x, y = marked.filter("root <> main").alias("x"), marked.alias("y")
    words = range(CELLS // 64)
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}.cells")[i].bitwiseAND(F.bitwise_not(F.col(f"{q}.cells")[i]))) for i in words), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    fits = lambda most: most * (1 + least) + 1e-6 >= F.lit(least) * total
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.s") < F.col("y.s"))
    # Both sizes, then the shingles that one side has alone at least, bound what the two can share.
    near = fits(F.least("x.n", "y.n")) & fits(F.col("x.n") - only("x", "y")) & fits(F.col("y.n") - only("y", "x"))
    first = ~F.arrays_overlap("x.before", "y.before")
    tried = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & near & first)
    return tried.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"))


def similar_components(documents: DataFrame, made: DataFrame, least: float, radius: int = WIDE) -> DataFrame:
    """(node, least) over the sets of shingles that have a partner of similarity ``least`` or more.

    The tree of fingerprints names candidates (``near_pairs``), and the exact similarity decides. What it leaves apart, as
    some similar sets lie beyond any radius that tells texts from one another, is sought by band keys: members of a bucket
    in different components are held against two of them, twice, so a large group of near copies costs a few pairs a member.
    Last, all pairs of a bucket that are still in different components are held against one another (``_apart``): a pair
    that never is compared is joined already, so the components are those of all that share a band or that the tree names.
    """
    distinct = common.settle(made.groupBy("s").agg(F.min(F.struct(F.col("doc_id").alias("id"), "mark", "fp", "n")).alias("w"), F.first("bands").alias("bands")), "sets")
    near = near_pairs(distinct.select("s", "w.fp", "w.n"), least, radius)
    keyed = distinct.select("s", F.posexplode("bands").alias("band", "key"))
    buckets = common.settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k")), "buckets")
    shared = common.settle(keyed.join(buckets, F.col("key") == F.col("k")).select("key", "band", "s"), "shared")
    named = common.settle(shared.select(F.col("s").alias("x")).union(near.select("a")).union(near.select("b")).distinct(), "candidates")
    wanted = common.settle(distinct.join(named, F.col("s") == F.col("x")).select("s", "w.id", "w.mark"), "wanted")
    sets = common.settle(_sets_of(documents, wanted), "shingles")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = components(_similar(near, sets, least))
    for last in (False, False, True):
        members = common.settle(shared.join(now, F.col("s") == F.col("node"), "left").select("key", "band", "s", F.coalesce("least", "s").alias("root")), "members")
        apart = members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("s", "root").alias("s0"), F.max_by("s", "root").alias("s1")).filter("r0 <> r1").withColumnRenamed("key", "k")
        open_ = members.join(common.settle(apart, "apart"), F.col("key") == F.col("k"))
        if last:
            about = sets.select(F.col("s").alias("_s"), F.size("shingles").alias("n"), "cells").join(distinct.select(F.col("s").alias("_t"), "bands"), F.col("_s") == F.col("_t"))
            # The keys of the bands before this one tell whether a pair has met before.
            before = F.when(F.col("band") > 0, F.slice("bands", 1, F.greatest(F.col("band"), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
            tried = _apart(open_.join(about, F.col("s") == F.col("_s")).select("key", "s", "root", "n", "cells", before.alias("before")), least)
        else:
            tried = open_.filter("root <> r0").select(*pair("s", "s0")).union(open_.filter("root <> r1").select(*pair("s", "s1")))
        found = common.settle(_similar(common.settle(tried.distinct(), "tried"), sets, least), "similar")
        if not found.isEmpty():
            now = components(now.select(F.col("node").alias("a"), F.col("least").alias("b")).union(found))
    return now


def keep_dissimilar(documents: DataFrame, least: float = SIMILAR, radius: int = WIDE) -> DataFrame:
    """One document of each group of near copies by the general rule, with all columns: that with the smallest id (null ids last).

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of ``least`` or more, and what they join.
    """
    made = common.settle(sketches(documents), "sketches")
    joined = similar_components(documents, made, least, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    firsts = made.groupBy("s").agg(first.alias("w"))
    stays = firsts.join(joined, F.col("s") == F.col("node"), "left").groupBy(F.coalesce("least", "s").alias("root")).agg(F.min("w").alias("w"))
    return common.keep_keyed(documents, _name(F.col("doc_id").cast("long"), F.xxhash64(common.text_or_empty())), stays.select(_name(F.col("w.id"), F.col("w.mark")).alias("k")))
