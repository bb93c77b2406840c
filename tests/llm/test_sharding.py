import random
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import sharding

from .conftest import frame


def feasible(sizes, capacity, shards):
    used, load = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        if load + s > capacity:
            used, load = used + 1, 0
        load += s
    return used <= shards


@pytest.mark.parametrize(("n", "shards", "seed"), [(1, 8, 0), (7, 8, 1), (300, 8, 2), (300, 3, 3), (50, 1, 4)])
def test_capacity_is_the_smallest(spark, n, shards, seed):
    r = random.Random(seed)
    groups = {"%064x" % r.getrandbits(256): r.choice([1, 5, 50, 5000]) + r.randrange(9) for _ in range(n)}
    df = spark.createDataFrame(list(groups.items()), "digest string, size bigint")
    capacity, cuts = sharding.cut_digests(df, shards)
    sizes = [groups[d] for d in sorted(groups)]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if feasible(sizes, c, shards))
    assert capacity == best
    loads = [0] * shards
    for d, s in groups.items():
        loads[sum(d > c for c in cuts)] += s
    assert max(loads) <= capacity


def test_contract(odd):
    rows = sharding.shard_documents(odd).collect()
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    assert len(rows) == odd.count()
    where = {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert where.setdefault(t, r["shard"]) == r["shard"]
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert 0 <= shard < 8 and slots == list(range(len(slots)))


def test_sizes_are_near_equal_and_reruns_agree(spark):
    r = random.Random(5)
    df = frame(spark, ["w" * r.randrange(1, 400) + str(i // 2) for i in range(2000)])
    a, b = (sorted(map(tuple, sharding.shard_documents(x).collect())) for x in (df, df.repartition(7)))
    assert a == b
    loads = [x[0] for x in sharding.shard_documents(df).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 8


def test_one_text_for_all_and_none(spark, nothing):
    rows = sharding.shard_documents(frame(spark, ["same"] * 30)).collect()
    assert {r["shard"] for r in rows} == {0} and sorted(r["slot"] for r in rows) == list(range(30))
    assert sharding.shard_documents(nothing).count() == 0


def test_write(spark, tmp_path, odd):
    sharding.write_shards(odd.drop("shard"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == odd.count()


def test_a_large_group_leaves_no_shard_empty(spark):
    for where in (0, 150, 299):
        groups = [("%064x" % ((i << 240) + 1), 3000 if i == where else 20) for i in range(300)]
        capacity, cuts = sharding.cut_digests(spark.createDataFrame(groups, "digest string, size bigint"), 8)
        loads = [0] * 8
        for d, n in groups:
            loads[sum(d > c for c in cuts)] += n
        assert capacity == max(loads) == 3000 and min(loads) >= 500


def loads_of(groups, cuts, shards):
    loads = [0] * shards
    for d, n in groups:
        loads[sum(d > c for c in cuts)] += n
    return loads


def test_cuts_are_the_greedy_walk(spark):
    r = random.Random(12)
    groups = [("%064x" % ((i << 240) + 1), r.randrange(1, 60)) for i in range(400)]
    capacity, cuts = sharding.cut_digests(spark.createDataFrame(groups, "digest string, size bigint"), 8)
    want, load = [0], 0
    for _, n in groups:
        if want[-1] + n > capacity:
            want.append(0)
        want[-1] += n
    assert loads_of(groups, cuts, 8) == want


def test_two_large_groups(spark):
    groups = [("%064x" % ((i << 240) + 1), {40: 9000, 41: 5000}.get(i, 20)) for i in range(300)]
    capacity, cuts = sharding.cut_digests(spark.createDataFrame(groups, "digest string, size bigint"), 8)
    loads = loads_of(groups, cuts, 8)
    assert capacity == max(loads) == 9000 and sorted(loads)[-2] == 5000 and min(loads) >= 700 and sorted(loads)[-3] <= 1060


def test_large_groups_at_the_ends(spark):
    groups = [("%064x" % ((i << 240) + 1), 8000 if i in (0, 299) else 20) for i in range(300)]
    capacity, cuts = sharding.cut_digests(spark.createDataFrame(groups, "digest string, size bigint"), 8)
    loads = loads_of(groups, cuts, 8)
    assert capacity == 8000 and loads[0] == loads[7] == 8000 and max(loads[1:7]) - min(loads[1:7]) <= 120
    one = [("%064x" % 1, 50)]
    assert sharding.cut_digests(spark.createDataFrame(one, "digest string, size bigint"), 8) == (50, [])
