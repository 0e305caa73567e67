import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import whitening

KIND = "vec_id long, embedding array<float>"


def brute(rows, components=16):
    """Each (vec_id, x) with its deviation and coordinates by plain linear algebra, for vectors of one length."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - fit.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ v[:, :components], e


def test_whitening_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 4, 20) + 3).astype("f4").tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 700)] + [(7, rows[9][1]), (None, rows[3][1])]
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "PIECE", 30)
    df = spark.createDataFrame(rows, KIND).repartition(7).withColumn("n", F.lit("other")).withColumn("component", F.lit(1))
    got = whitening.whiten(df).toPandas()
    n, deviation, w, e = brute(rows)
    assert (got.n == n).all() and n == 400 and len(got) == 16 * len(rows) and got.identity_error.max() < 1e-9
    assert sorted(got.deviation) == sorted(np.repeat(deviation, 16))
    assert np.allclose(got.groupby("component").explained.first(), (e / e.sum())[:16], rtol=1e-9)
    for k in range(16):
        a = got[got.component == k + 1].sort_values(["deviation", "whitened"])
        want = w[:, k] / math.sqrt(e[k])
        assert any(np.allclose(np.sort(a.whitened), np.sort(z * want), atol=1e-8) for z in (1, -1))


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1e30, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 2.0]), (9, [4.0, 2.0]), (10, [1.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    assert sorted(got) == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1), (9, 2), (10, 1)]
    assert got[7, 2].whitened is None and got[7, 2].explained == 0 and got[7, 1].explained == 1 and got[7, 1].identity_error < 1e-9
    x = [64, 128, 256]
    assert [got[i, 1].deviation for i in (7, 8, 9)] == [(3 * v - sum(x)) ** 2 for v in x]
    assert (got[10, 1].n, got[10, 1].deviation, got[10, 1].whitened, got[10, 1].explained, got[10, 1].identity_error) == (1, 0, None, None, None)
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0


def test_whitening_of_immense_entries(spark):
    rows = [(i, [float(i) * 1e15, 1.0]) for i in range(5)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, KIND)).where("component = 1").collect()}
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((5 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert all(got[i].deviation == (want[i] if want[i] < 1 << 63 else None) for i in range(5)) and got[0].identity_error < 1e-6


def test_merges_are_lossless():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (300, 12)) + 1_000_000
    parts = [x[:10], x[10:150], x[150:]]
    state = None
    for p in parts:
        sums = whitening.whole_sums(p)
        part = (len(p), sums, whitening.factor(whitening.centred(p, len(p), sums)))
        state = whitening.merged(state, part) if state else part
    n, sums, f = state
    c = x - x.mean(0)
    assert n == 300 and list(sums) == x.sum(0).tolist() and np.allclose(f.T @ f, c.T @ c, rtol=1e-12, atol=1e-6)


@pytest.mark.parametrize("n", [1, 5])
def test_sums_stay_exact(n):
    x = np.full((n, 2), (1 << 61) - 3)
    assert whitening.whole_sums(x).tolist() == [n * ((1 << 61) - 3)] * 2
