import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from marlstone.llm import toxicity  # noqa: E402

from .test_simhash import slow_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append(name)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_documents(before, labels).filter("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "exact dedup":
            clean = lambda df: [" ".join((r["text"] or "").split()) for r in df.collect()]
            assert len(set(clean(docs))) == docs.count() and set(clean(docs)) == set(clean(before))
        if name == "simhash near-dedup":
            # The stage goes by the general rule; op9's two bits are that query's contract.
            assert sorted(r["doc_id"] for r in docs.collect()) == slow_kept([(r["doc_id"], r["text"]) for r in before.collect()])
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 2
            assert sum(len(r["text"].split()) for r in docs.collect()) == pytest.approx(1.5 * sum(len(r["text"].split()) for r in before.collect()), rel=0.02)
        if k < 4:
            assert docs.columns == columns
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def stages(spark, docs, folder, sf):
    """The stages over a small table, each written and read again."""
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        yield docs


def labels_at(spark, tmp_path, rows):
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages_take_odd_rows(spark, odd, tmp_path):
    sf = labels_at(spark, tmp_path, [(i, 1, i % 2) for i in range(18)] + [(None, 1, 1), (3, None, None)])
    out = list(stages(spark, odd, tmp_path, sf))
    assert all(d.columns == odd.columns for d in out[:4])
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out[1].collect()]
    assert len(texts) == len(set(texts)) and out[0].count() >= 18 and out[4].count() > 0
    assert out[4].filter("length > 1024 or offset + length > 1024").isEmpty()


def test_stages_take_empty_tables(spark, nothing, tmp_path):
    sf = labels_at(spark, tmp_path, [])
    assert [d.count() for d in stages(spark, nothing, tmp_path, sf)] == [0] * 5
