import math
import random

from pyspark.sql import functions as F

from marlstone.llm import mixing

from .conftest import frame, prose


def water(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += part[s]
        for s in [s for s in open_ if target[s] > 2 * sizes[s]]:
            left += target[s] - 2 * sizes[s]
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    return target


def test_targets_and_taken(spark):
    r = random.Random(3)
    texts = [prose(r.choice([0, 1, 5, 40, 200]), i) for i in range(600)]
    df = frame(spark, texts, ["src2", "src10", "Z", "é", None, "src1", "src2", "src2"])
    rows = mixing.mix(df).collect()
    sizes = {}
    for x in df.collect():
        sizes[x["source"]] = sizes.get(x["source"], 0) + len(x["text"].split())
    want = water(sizes)
    for s in sizes:
        mine = [x for x in rows if x["source"] == s]
        assert {x["source_size"] for x in mine} == {sizes[s]} and math.isclose(mine[0]["target"], want[s], rel_tol=1e-9)
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= max(3, 0.002 * want[s])
    assert all(0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"] for x in rows)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in rows) == sorted((x["doc_id"], x["taken"]) for x in again)


def test_rates_are_tilted_and_meet_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 50), ("a", 100, 30), ("b", 10, 50), ("b", 100, 30)], "source string, size bigint, n bigint")
    wanted = spark.createDataFrame([("a", 3500, 1000.0), ("b", 3500, 6900.0)], "source string, source_size bigint, target double")
    for r in mixing.solve(cells, wanted).collect():
        rate = lambda size: min(2, math.exp(r["lam"] * size / r["scale"]))  # noqa: E731, B023
        assert math.isclose(50 * 10 * rate(10) + 30 * 100 * rate(100), r["target"], rel_tol=1e-6)
        assert (r["lam"] < 0) == (r["target"] < 3500)


def test_odd_rows_and_none(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= x["taken"] <= 2 * x["size"] for x in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_documents_come_as_often_as_planned(odd):
    planned = {(x["doc_id"], x["source"]): x["n"] for x in mixing.mix(odd).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if x["n"]}
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert {(x["doc_id"], x["source"]): x["count"] for x in mixed.groupBy("doc_id", "source").count().collect()} == planned


def test_targets_of_many_sources(spark):
    r = random.Random(4)
    sizes = {f"https://host{i}.example/{r.random()}": r.choice([0, 1, 3, 50, 2000, 90_000]) for i in range(300)} | {None: 40, "": 7}
    got = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), (3, 1, 2), 1.5).collect()}
    want = water(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    df = spark.createDataFrame([(1, "one two three", "a", n, {"k": n}) for n in (1, 2, 2, None)], "doc_id bigint, text string, source string, extra int, more map<string,int>")
    mixed = sorted((x["extra"] is None, x["extra"], x["more"]["k"]) for x in mixing.mixed_documents(df, (1,), 2.0).collect())
    assert mixed == [(False, 1, 1)] * 2 + [(False, 2, 2)] * 4 + [(True, None, None)] * 2
