import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.operators import postings, retrieval


def corpus(seed, n):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(6)], [f"r{i}" for i in range(200)]
    one = lambda: rng.choices(common, k=rng.randint(0, 9)) + rng.choices(rare, k=rng.randint(0, 4))
    return [(d, u, one(), rng.choices(common + rare, k=rng.randint(0, 2)), rng.choices(rare, k=rng.randint(0, 1))) for d in range(n) for u in range(rng.randint(1, 3))]


def plain(units, terms, k, digits=None):
    total = len(units)
    df = {t: sum(t in tokens or t in section for _, _, tokens, section, _ in units) for t in terms}
    scores = Counter()
    for doc, _, tokens, section, stem in units:
        for t in terms:
            f, w = tokens.count(t), math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5))
            if f:
                part = w * f * 2.2 / (f + 1.2) + w * (0.75 * (t in section) + 0.5 * (t in stem))
                scores[doc] += part if digits is None else round(part, digits)
    ranked = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))
    return [(d, s) for s, d in ranked if s > 0][:k]


@pytest.mark.parametrize(("part", "block", "queries"), [(2_048, 128, 100), (40, 4, 3)])
def test_top_matches_a_plain_ranking(spark, tmp_path, monkeypatch, part, block, queries):
    for name, value in (("PART", part), ("BLOCK", block), ("QUERIES", queries)):
        monkeypatch.setattr(postings, name, value)
    units = corpus(1, 300)
    df = spark.createDataFrame(units, "doc long, unit int, tokens array<string>, section array<string>, stem array<string>")
    postings.build(df, str(tmp_path / "i"))
    index = postings.Index(spark, str(tmp_path / "i"))
    rng = random.Random(2)
    asked = {q: sorted(set(rng.choices([f"w{i}" for i in range(6)] + [f"r{i}" for i in range(220)], k=rng.randint(1, 8)))) for q in range(25)} | {99: ["none"]}
    found = index.top(spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id int, term string"), 4).collect()
    for q, terms in asked.items():
        got = sorted((r.rank, r.doc, r.score) for r in found if r.query_id == q)
        assert [(d, pytest.approx(s, abs=2e-6)) for _, d, s in got] == plain(units, terms, 4)


def test_best_looks_at_few_documents():
    """With a rare and a common term, documents that hold only the common one are never scored."""
    seen = []

    class Watched(postings.Term):
        def parts(self, where, weight, digits):
            seen.append(len(where))
            return super().parts(where, weight, digits)

    n = 5_000
    gains = lambda f: [x * 2.2 / (x + 1.2) for x in f]
    blocks = lambda g: [max(g[i : i + postings.BLOCK]) for i in range(0, len(g), postings.BLOCK)]
    term = lambda at, f: Watched(np.array(at), gains(f), [[x * 4] for x in f], blocks(gains(f)), max(gains(f)))
    rare, common = term(list(range(0, n, 100)), [1 + i % 3 for i in range(50)]), term(list(range(n)), [1 + i % 5 for i in range(n)])
    at, score = postings.best([(5.0, rare), (0.01, common)], n, 3)
    want = sorted(((5.0 * gains([1 + (d // 100) % 3])[0] * (d % 100 == 0) + 0.01 * gains([1 + d % 5])[0], -d) for d in range(n)), reverse=True)[:3]
    assert at.tolist() == [-d for _, d in want] and np.allclose(score, [s for s, _ in want], atol=1e-6) and max(seen) <= 50


def test_equal_scores_keep_the_order_of_ids(spark, tmp_path):
    df = spark.createDataFrame([(d, 0, ["a"]) for d in range(500, 0, -1)], "doc long, unit int, tokens array<string>")
    postings.build(df, str(tmp_path / "i"))
    got = postings.Index(spark, str(tmp_path / "i")).top(spark.createDataFrame([("q", "a")], "query_id string, term string"), 3).collect()
    assert sorted((r.rank, r.doc) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_empty(spark, tmp_path):
    postings.build(spark.createDataFrame([], "doc long, unit int, tokens array<string>"), str(tmp_path / "i"))
    assert postings.Index(spark, str(tmp_path / "i")).top(spark.createDataFrame([(1, "a")], "query_id int, term string")).count() == 0


def test_best_of_equals_single_searches(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["funding", "deadline", "water", "sme", "research", "x"], k=8))) for i in range(60)], "doc_id long, text string")
    queries = ["funding of research", "prazo and water", "zzz"]
    got = {(r.query_id, r.rank): (r.doc_id, r.score, r.coverage) for r in retrieval.best_of(docs, queries, "doc_id", 3).collect()}
    from pyspark.sql import functions as F

    for n, q in enumerate(queries):
        rows = retrieval.scored(docs, q).select("doc_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage")).orderBy(F.desc("score"), "doc_id").limit(3).collect()
        assert [got[n, i] for i in range(1, len(rows) + 1)] == [tuple(r) for r in rows] and (n, len(rows) + 1) not in got


def test_units_are_read_of_the_documents_that_may_win_only():
    class Counted(list):
        read = 0

        def __getitem__(self, i):
            Counted.read += 1
            return super().__getitem__(i)

        def __iter__(self):
            Counted.read += len(self)
            return super().__iter__()

    n = 5_000
    f = np.arange(n) % 40 + 1
    g = f * 2.2 / (f + 1.2) + np.arange(n) * 1e-4
    term = postings.Term(np.arange(n), g, Counted([[int(x) * 4] for x in f]), [float(g[i : i + postings.BLOCK].max()) for i in range(0, n, postings.BLOCK)], float(g.max()))
    at, _ = postings.best([(1.0, term)], n, 5)
    assert len(at) == 5 and Counted.read <= 20
    assert len(term.parts(np.zeros(0, int), 1.0, None)) == 0
