import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in usable if i % 20 == 0}:
        mine = min(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in usable if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("n", "seed", "kind"), [(700, 0, "normal"), (700, 1, "clustered"), (300, 2, "equal"), (9, 3, "normal")])
def test_as_brute_force(spark, n, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)).astype(np.float32)
    if kind == "clustered":
        x = (x[rng.integers(0, 5, n)] * 3 + x * 0.2).astype(np.float32)
    if kind == "equal":
        x[: n // 2] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, pivots=6).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (1, [0.3, 0.4]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []), (20, [-1.0, 2.0]), (7, [0.3, 0.4]), (None, [1.0, 1.0]), (40, [nan, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit("x")).withColumn("cell", F.lit(1))
    got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)
    assert topk.search(df.filter("vec_id = 2"), F.lit(True)).count() == 0 and topk.search(df.filter("false"), F.lit(True)).count() == 0


def test_annuli_stop_early():
    """Far rows of a cell are never scored: their scores would be the best here, and must not be seen."""
    x = np.zeros((2 * topk.ANNULUS, 2))
    r = np.concatenate([np.zeros(topk.ANNULUS), np.full(topk.ANNULUS, 1e9)])
    x[topk.ANNULUS :] = 1e6
    best = topk.search_cell(np.arange(len(x)), x, r, np.array([-1]), np.array([[1.0, 0.0]]), np.array([0.0]), np.array([-np.inf]), 100.0, 20)
    assert best.scores[0].max() == 0


def run(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}")
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, pivots=4).select("query_id", "rank", "vec_id", "score").collect())


def whole_brute(rows, k=20):
    """Rows are rows, also where ids repeat; widths meet their own alone; Python's whole numbers."""
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for a, (q, e) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(e, v, strict=True)), i) for b, (i, v) in enumerate(ints) if b != a and len(v) == len(e))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_twins_are_candidates(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (20, [2.0, 1.0])]
    got = run(spark, rows)
    assert got == whole_brute(rows) and (0, 1, 0, 64 * 64 * 5) in got


def test_widths_meet_their_own(spark):
    rows = [(20, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0]), (40, [3.0]), (60, [1.0, 1.0, 1.0])]
    assert run(spark, rows) == whole_brute(rows)


@pytest.mark.parametrize("scale", [1e5, 1e6, 3e6 / 7])
def test_scores_are_exact_beyond_doubles(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-9, 9, 4) * scale + rng.integers(0, 3, 4) / 64).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1][:3] + [rows[i][1][3] + 1 / 64]) for i in range(20)]  # scores that differ in the last bits
    assert run(spark, rows) == whole_brute(rows)


def test_long_vectors_whose_scores_fit(spark):
    rows = [(20 * i, [float(i), 1.0, -2.0]) for i in range(12)] + [(240, [5e7, 3.0, 1 / 64]), (7, [0.0, 1e12, 1.0])]
    assert run(spark, rows) == whole_brute(rows)


def test_scores_that_leave_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="leaves 64 bits"):
        run(spark, [(0, [5e9, 0.0]), (1, [5e9, 1.0])])
    with pytest.raises(ValueError, match="too long"):
        run(spark, [(0, [1e30, 0.0]), (1, [1.0, 1.0])])


def test_cells_in_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_QUERIES", 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(0, 800, 2)]
    assert run(spark, rows) == whole_brute(rows)
