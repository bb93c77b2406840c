"""Queries with SQL against it, on the smallest tables and on odd rows."""

import os

import duckdb
import pandas as pd
import pytest

from marlstone.llm import queries

SF = "/root/testdata/sf0.001"


def plain(df, cols):
    clean = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str(tuple(map(clean, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


def same(spark, name, folder):
    c = duckdb.connect()
    for t in os.listdir(folder):
        where = f"{folder}/{t}/*.parquet" if os.path.isdir(f"{folder}/{t}") else f"{folder}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{where}'")
    got, want = queries.QUERIES[name](spark, f"file://{folder}").toPandas(), c.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    same(spark, name, SF)


def test_odd_rows_match_sql(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    same(spark, "op3_license_scan", str(tmp_path))


def test_odd_turns_match_sql(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "b\nob|>", None), (2, 0, "system", "alone"), (None, None, None, "lost"), (None, 0, "", "<|<|"), (3, 5, "é", "\U0001f600"), (3, 4, "x", "")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    same(spark, "op5_chat_rotation", str(tmp_path))
