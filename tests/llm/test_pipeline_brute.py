"""The pipeline's stages against plain loops over a small table."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from lodestar.llm import neardup, quality, toxicity
from lodestar.llm.common import words
from lodestar.llm.queries import PIECES

DATA = "/root/testdata/sf0.001"


def without_toxic(rows, labels):
    known = {r.doc_id: r.toxic for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = sorted((r.doc_id, r.text) for r in rows if r.doc_id in known)
    share = sum(known.values()) / len(known)
    y = [known[i] for i, _ in texts]
    counts = {}
    for (_, t), label in zip(texts, y):
        for i in toxicity.items_of(t):
            counts[i] = (counts.get(i, (0, 0))[0] + label, counts.get(i, (0, 0))[1] + 1 - label)
    lexicon = toxicity.Lexicon(counts, (sum(y), len(y) - sum(y)), share)
    model = toxicity.Model(share, lexicon, np.array([lexicon.without(t, label) for (_, t), label in zip(texts, y)]), y, np.array([toxicity.fold(t) for _, t in texts]))
    return [r for r in rows if model.scores([r.text])[0] < 0.7]


def without_junk(rows):
    patterns = ["".join(map(str, quality.votes(r.text))) for r in rows]
    counts = Counter(patterns)
    model = quality.LabelModel([[int(c) for c in p] for p in sorted(counts)], [counts[p] for p in sorted(counts)])
    q = model.posterior(np.array([[int(c) for c in p] for p in patterns]))
    x = np.array([quality.hashed(r.text).astype(np.float16) for r in rows], np.float32)
    order = sorted(range(len(rows)), key=lambda i: rows[i].doc_id)
    scorer = quality.Scorer(x[order], q[order], np.ones(len(rows)))
    return [r for r, t in zip(rows, scorer(np.stack([quality.hashed(r.text) for r in rows]))) if t >= 0.5]


def one_of_each(rows):
    shingler, rows, heads = neardup.Shingler(), sorted(rows, key=lambda r: r.doc_id), {}
    bags = [neardup.multiset(shingler.hashes(words(r.text))) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i].text == rows[j].text or (len(bags[i][0]) and neardup.similarity(bags[i], bags[j]) >= 0.8):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    for i, r in enumerate(rows):
        heads.setdefault(top(i), r)
    return list(heads.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, labels = docs.collect(), spark.read.parquet(f"{DATA}/labels.parquet").collect()
    ids = lambda x: sorted(r.doc_id for r in x)
    steps = dict(corpus_pipeline.STAGES)
    expected = without_toxic(rows, labels)
    out = steps["toxicity"](spark, docs, DATA)
    assert ids(out.collect()) == ids(expected)
    expected = without_junk(expected)
    out = steps["quality"](spark, spark.createDataFrame(out.collect(), docs.schema), DATA)
    assert ids(out.collect()) == ids(expected)
    expected = one_of_each(expected)
    out = steps["neardup"](spark, spark.createDataFrame(out.collect(), docs.schema), DATA)
    kept = out.collect()
    assert ids(kept) == ids(expected)
    out = steps["mixing"](spark, spark.createDataFrame(kept, docs.schema), DATA).collect()
    taken = Counter(r.doc_id for r in out)
    assert max(taken.values()) <= 2 and set(taken) <= set(ids(kept)) and all(r in kept for r in out)
    words_of, share, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept:
        words_of[r.source] += len(words(r.text))
        share[r.source] += taken[r.doc_id] * len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
    # targets: words dealt by weight, filled up to twice a source's own
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(words_of))}
    left, free, goal = 1.5 * sum(words_of.values()), set(words_of), {}
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if per * weight[s] > 2 * words_of[s]}
        goal |= {s: 2.0 * words_of[s] if full else per * weight[s] for s in full or free}
        left, free = left - sum(goal[s] for s in full), free - full if full else set()
    assert all(abs(share[s] - goal[s]) <= longest[s] / 2 + 1e-6 for s in goal)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    last = steps["sentencepiece"](spark, spark.createDataFrame(out, docs.schema), DATA).collect()
    text = {r.doc_id: r.text for r in kept}
    assert Counter(r.doc_id for r in last) == taken and all(r.ids == sp.encode(text[r.doc_id]) for r in last)
