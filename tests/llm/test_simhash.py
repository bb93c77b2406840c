import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import simhash

from .conftest import frame, prose


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), seed=42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(rows):
    """{position: smallest id} by union over all pairs."""
    fps, up = [f for _, f in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            out[root(i)] = min(out.get(root(i), d), d)
    return [out.get(root(i)) for i in range(len(rows))]


def expected(df):
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    return Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, slow_components(rows), strict=True))


def test_odd_rows(odd, nothing):
    got = simhash.near_dedup(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == expected(odd)
    assert simhash.near_dedup(nothing).count() == 0


def test_near_copies(spark):
    r = random.Random(4)
    base = [prose(r.choice([3, 4, 30, 300]), i) for i in range(60)]
    texts = []
    for t in base:
        for _ in range(6):
            words = t.split()
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = r.choice(["cat", "dog", "mat"])
            texts.append(" ".join(words))
    df = frame(spark, texts)
    got = simhash.near_dedup(df, shard_rows=16).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == expected(df)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted({x["component_id"] for x in got})


@pytest.mark.parametrize("seed", range(4))
def test_tree_and_shards_find_every_link(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)], rng.integers(0, 2**64, 500, dtype=np.uint64)]))
    tree = simhash.Tree.fit(fps[::2], 4)
    at, shard, home = tree.visits(fps, 2)
    own = np.full(len(fps), -1)
    own[at[home]] = shard[home]
    assert (own >= 0).all() and home.sum() == len(fps)
    visits = set(zip(at.tolist(), shard.tolist(), strict=True))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert all((i, own[j]) in visits for i, j in zip(a.tolist(), b.tolist(), strict=True))
    root = simhash.close_pairs(fps, np.ones(len(fps), bool), 2)
    want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
    assert root.tolist() == want


def test_components_over_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 200), (300, 300)]
    got = {r["node"]: r["least"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 0, **{100 + i: 100 for i in range(1, 60)}}


def test_empty_texts_link(spark):
    rows = simhash.near_dedup(frame(spark, ["", None, "  ", "word"])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["fingerprint"] == "0" * 16} == {(0, 0), (1, 0), (2, 0)}


def slow_kept(rows, least=0.8):
    """Ids that stay when texts of five-word Jaccard similarity ``least`` or more, over all pairs, are one."""
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                up[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), d), d)
    return sorted(first.values())


def test_similar_texts_go_beyond_the_radius(spark):
    r = random.Random(6)
    texts = []
    for i in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400]))]
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randrange(1 + len(words) // 50)):
                copy[r.randrange(len(copy))] = "Other"
            texts.append(" ".join(copy))
    df = frame(spark, [*texts, "", "one two", "One  TWO", "one two three"])
    rows = [(x["doc_id"], x["text"]) for x in df.collect()]
    got = sorted(x["doc_id"] for x in simhash.keep_dissimilar(df).collect())
    assert got == slow_kept(rows)
    assert len(got) < simhash.keep_one(df).count()  # what two bits of the fingerprint leave in


def test_cross_pairs_of_a_bucket_are_compared(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, 100, 10)]  # neighbours are similar, the ends are not
    df = frame(spark, texts)
    assert [x["doc_id"] for x in simhash.keep_dissimilar(df).collect()] == slow_kept([(i, t) for i, t in enumerate(texts)]) == [0]


def test_similar_odd_rows(odd, nothing):
    kept = simhash.keep_dissimilar(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 0
    assert simhash.keep_dissimilar(nothing).count() == 0


def test_the_stage_keeps_to_the_general_rule(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(x["doc_id"] for x in kept.collect()) == slow_kept([(x["doc_id"], x["text"]) for x in docs.collect()])


def test_trees_grow_on_large_shards(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3), dtype=np.uint64), axis=1) ^ c for c in centres]))
    tree = simhash.Tree.fit(fps[:40], 1)
    for _ in range(3):
        at, shard, home = tree.visits(fps, 2)
        sizes = np.bincount(shard[home], minlength=tree.shards)
        tree.grow({int(s): simhash.Tree.fit(fps[at[home]][shard[home] == s], 2) for s in np.flatnonzero(sizes > 120)})
    at, shard, home = tree.visits(fps, 2)
    assert home.sum() == len(fps) and sorted(at[home]) == list(range(len(fps))) and shard.max() < tree.shards
    assert np.bincount(shard[home]).max() < np.bincount(simhash.Tree.fit(fps[:40], 1).visits(fps, 0)[1]).max()
    own = np.zeros(len(fps), int)
    own[at[home]] = shard[home]
    visits = set(zip(at.tolist(), shard.tolist(), strict=True))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert all((i, own[j]) in visits for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_links_of_grown_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 64)
    monkeypatch.setattr(simhash, "LEAST_SHARDS", 2)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4)]]))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    tree = simhash.fit_tree(table, len(fps), 60)
    assert tree.grown and tree.shards > 8
    got = simhash.components(simhash.links(table, 60)).collect()
    where = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
    root = list(range(len(fps)))
    for r in got:
        root[where[r["node"]]] = where[r["least"]]
    groups = lambda x: {frozenset(i for i, v in enumerate(x) if v == k) for k in set(x)}
    assert groups(root) == groups(want)


def near_copies():
    r, texts = random.Random(11), []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([80, 150, 400]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(r.randrange(1 + len(words) // 100)):
                copy[r.randrange(len(copy))] = "Other"
            texts.append(" ".join(copy))
    return texts


def test_the_stage_links_through_the_tree(spark, monkeypatch):
    real = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda docs: real(docs).withColumn("bands", F.array("s")))  # no two sets share a band
    df = frame(spark, near_copies())
    assert sorted(x["doc_id"] for x in simhash.keep_dissimilar(df).collect()) == slow_kept([(x["doc_id"], x["text"]) for x in df.collect()])


@pytest.mark.parametrize("shard_rows", [simhash.SHARD_ROWS, 2])
def test_near_pairs_hold_the_nearest(spark, shard_rows):
    texts = [*dict.fromkeys(near_copies()), "one two", "one two three"]
    sets = [simhash.shingle_set(t) for t in texts]
    nodes = [(i, simhash.fingerprint(t), len(x)) for i, (t, x) in enumerate(zip(texts, sets, strict=True))]
    table = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64)), n) for i, f, n in nodes], "s bigint, fp bigint, n bigint")
    got = {frozenset(map(int, p)) for p in simhash.near_pairs(table, 0.8, shard_rows=shard_rows).collect()}
    bits = lambda i, j: (nodes[i][1] ^ nodes[j][1]).bit_count()
    for i, _, n in nodes:
        near = [bits(i, j) for j, _, m in nodes if j != i and 0.8 * max(n, m) <= min(n, m) and bits(i, j) <= simhash.WIDE]
        mine = [bits(*p) for p in got if i in p]
        assert not near or min(mine) <= min(near)
