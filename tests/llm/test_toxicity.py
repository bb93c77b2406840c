import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import toxicity

from .conftest import frame, prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, n=900, seed=1):
    r = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        bad = r.random() < 0.15
        words = prose(r.choice([8, 40, 400]), i).split()
        for _ in range(r.randrange(1, 4) * bad):
            words.insert(r.randrange(len(words)), r.choice(["snarfel", "snarfling", "blorg", "vexnoid"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = [(i, 1, t) for i, t in enumerate(toxic) if i % 5 < 3]
    return frame(spark, texts), spark.createDataFrame(labels, LABELS), toxic


def test_held_out_accuracy(spark):
    docs, labels, toxic = corpus(spark)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(toxic) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    right = np.mean([r["predicted"] == toxic[r["doc_id"]] for r in out])
    assert right > 0.97 and sum(r["predicted"] for r in out) > 10
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([(r["doc_id"], r["score"]) for r in toxicity.score_documents(docs, x).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


def test_negative_part_of_the_risk_stays_bounded():
    rng = np.random.default_rng(0)
    x_pos, x_unl = np.eye(8, dtype=np.float32)[rng.integers(0, 2, 50)], np.eye(8, dtype=np.float32)[rng.integers(0, 8, 200)]
    w, b = toxicity.fit(x_pos, x_unl, 0.25)
    assert np.isfinite(w).all() and w[:2].min() > w[2:].max() and b < 0


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] < 0.01 for r in toxicity.score_documents(odd, none).collect()} == {True}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(18)] + [(None, 1, 1), (3, 1, None), (4, 1, 1), (4, 1, 0)], LABELS)
    assert toxicity.score_documents(odd, labels).count() == odd.count()
    assert toxicity.score_documents(nothing, labels).count() == 0


def test_words_that_toxic_copies_share_are_no_evidence(spark):
    docs, labels, toxic = corpus(spark)
    passage = prose(600, 77)
    copies = frame(spark, [f"{passage} snarfel {'x' * (i % 5 + 1)}" for i in range(120)]).withColumn("doc_id", F.col("doc_id") + 10_000)
    clean = frame(spark, [prose(600, 77).replace(" ", "  ")] + [" ".join(passage.split()[i:]) for i in (50, 100, 200)]).withColumn("doc_id", F.col("doc_id") + 20_000)
    more = labels.union(copies.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic")))
    rows = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs.unionByName(copies).unionByName(clean), more).collect()}
    assert not any(v for k, v in rows.items() if k >= 20_000)
    assert sum(rows[k] for k in range(10_000, 10_120)) == 120


def test_near_key():
    assert toxicity.near_key("") == toxicity.near_key("12 !")
    assert toxicity.near_key("one two") == toxicity.near_key("One, two") != toxicity.near_key("two one")
    long = prose(400, 3)
    assert toxicity.near_key(long) == toxicity.near_key(long.replace(" ", " - ")) != toxicity.near_key(prose(400, 4))


def test_risk_and_gradient_as_plain_numbers():
    rng = np.random.default_rng(3)
    x_pos, x_unl = (rng.random((7, 3)) < 0.5).astype(np.float32), (rng.random((11, 3)) < 0.5).astype(np.float32)
    a_pos, a_unl = (w / w.sum() for w in (rng.random(7), rng.random(11)))

    def slow(w, prior, x_unl):
        loss = lambda z: np.log(1 + np.exp(-z))
        z = lambda row: sum(float(v) * c for v, c in zip(row, w[:3], strict=True)) + w[3]
        positive = prior * sum(a * loss(z(r)) for a, r in zip(a_pos, x_pos, strict=True))
        negative = sum(a * loss(-z(r)) for a, r in zip(a_unl, x_unl, strict=True)) - prior * sum(a * loss(-z(r)) for a, r in zip(a_pos, x_pos, strict=True))
        return positive, negative

    for w, prior, unl, sign in [(np.array([0.3, -0.2, 0.5, -1.0]), 0.2, x_unl, 1), (np.array([3.0, 2.0, 4.0, -1.0]), 0.9, np.zeros_like(x_unl), -1)]:
        positive, negative, gradient = toxicity.risk(w, x_pos, unl, prior, a_pos, a_unl)
        assert np.allclose((positive, negative), slow(w, prior, unl), atol=1e-6) and np.sign(negative) == sign
        whole = (lambda v: sum(slow(v, prior, unl))) if negative >= 0 else (lambda v: -slow(v, prior, unl)[1])  # noqa: B023
        steps = np.eye(4) * 1e-5
        assert np.allclose(gradient, [(whole(w + s) - whole(w - s)) / 2e-5 for s in steps], atol=1e-4)


def test_feature_choice_as_plain_numbers(spark):
    import math

    r = random.Random(5)
    rows = [(f"f{i}", float(r.randrange(0, 40)), float(r.randrange(0, 60))) for i in range(200)]
    pos, unl, prior = 40.0, 100.0, 0.2
    kept = []
    for f, n, m in rows:
        a, u, both = n / pos, m / unl, (n + m) / (pos + unl)
        g = 2 * sum(x * math.log(x / (of * q)) for x, of, q in ((n, pos, both), (pos - n, pos, 1 - both), (m, unl, both), (unl - m, unl, 1 - both)) if x > 0)
        if a > u and n >= 2 and g >= toxicity.EVIDENCE:
            kept.append((-a * math.log((a + 1 / pos) / (max(0.0, (u - prior * a) / (1 - prior)) + 1 / unl)), f))
    got = toxicity.choose_features(spark.createDataFrame(rows, "feature string, n_pos double, n_unl double"), pos, unl, prior, 12)
    assert got == sorted(f for _, f in sorted(kept)[:12]) and len(got) == 12


def test_reruns_agree(spark):
    docs, labels, _ = corpus(spark, 300)
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(d, labels).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_scoring_sees_the_features_of_training():
    texts = [prose(n, n) + extra for n in (0, 1, 5, 60) for extra in ("", " winterly winters wintering", " Birds birding a1b2 é")]
    names = sorted({f for t in texts for f in toxicity.text_features(toxicity.words(t))})
    model = toxicity.Model(names, np.zeros(len(names)), 0.0)
    for t in [*texts, *texts]:
        assert [names[i] for i in model.present(t)] == sorted(toxicity.text_features(toxicity.words(t)))
    assert "3^wint" in names and "2^bird" in names
