"""Quality classifier from weak labels.

Heuristic labellers read a text and vote good, bad or not at all. Their votes over all documents are counted
by pattern; expectation-maximisation over the counts estimates each labeller's accuracy on either class and
how common the classes are, without any true label; for the labellers in ``SHARP`` a fixed ratio bounds what it
finds. The posterior of a pattern is the weak label of its
documents, and these train a linear scorer on hashed features (three-byte runs, and outlines of words), which
decides.

Patterns are at most 3 ** labellers rows, whatever the input's size; every document is in the counts. The
scorer is fitted on the driver on at most ``SAMPLE`` ids of each half of the posterior, the first by a hash of
the id, each with one text whatever its number of rows; that is its only bound. Scoring reads every text once, without a shuffle.

Defined results: a null text counts as empty; texts without words get no vote, so the posterior is the
prior's, and their score is that of empty features; repeated rows give equal rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import one_text, pieces, saved, set_aside

SAMPLE, DIMENSIONS = 3_000, 1 << 11
#: Documents with such a score or more are kept.
LIMIT = 0.5
LABELLERS = ("marks", "shouting", "tables", "stutter", "repeats", "sentences", "word_length", "variety", "letters", "ends")
#: Labellers that look for one kind of junk: a bad vote is at least so many times likelier for bad texts, which
#: departs from EM (README has the figures without). They don't vote on texts of fewer words.
SHARP, RATIO, LEAST_WORDS = ("marks", "shouting", "tables", "stutter"), 300.0, 5
_CLASS = np.zeros(256, np.intp)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 stop, 6 !?, 7 other mark, 8 non-ASCII
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 8 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:'\"-()" else 6 if _c in "!?" else 7 if _i > 32 else 0
_STOPS = re.compile(r"[.!?](?:\s|$)")


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """2 within good, 1 within bad, else 0: no vote."""
    return 2 if good[0] <= value <= good[1] else 1 if bad[0] <= value <= bad[1] else 0


def stutter(found: list[str]) -> float:
    """Share of words that repeat the word before them."""
    return sum(map(str.__eq__, found[1:], found)) / max(1, len(found) - 1)


def votes(text: str) -> list[int]:
    """A vote of each labeller: 0 none, 1 bad, 2 good. The bounds are rules of thumb for prose of any language."""
    found = text.split()
    n = len(found)
    if not n:
        return [0] * len(LABELLERS)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=9).astype(float)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[8])
    lines = [x for x in text.split("\n") if x.strip()]
    none = float("inf")
    long_lines = [x for x in lines if len(x) > 20]
    again = 1 - len(set(long_lines)) / len(long_lines) if len(long_lines) > 2 else None
    sentences = len(_STOPS.findall(text))
    out = [
        _vote(kinds[7] / n, (0, 0.05), (0.3, none)),
        _vote(max(kinds[2] / letters / 0.5, kinds[6] / n / 0.5), (0, 0.3), (1, none)),
        _vote((text.count("|") + text.count("\t")) / n, (0, 0.01), (0.15, none)),
        _vote(stutter(found), (0, 0.1), (0.4, 1)),
        0 if again is None else _vote(again, (0, 0.1), (0.4, 1)),
        0 if n < 30 else _vote(n / max(0.5, sentences), (3, 45), (80, none)),
        _vote(letters / n, (2.5, 12), (18, none)),
        0 if n < 50 else _vote(len(set(found)) / n, (0.2, 1), (0, 0.03)),
        _vote(letters / max(1.0, kinds.sum() - kinds[4]), (0.8, 1), (0, 0.4)),
        0 if len(lines) < 2 else _vote(sum(x.rstrip()[-1] in ".!?\"'…:;)" for x in lines) / len(lines), (0.7, 1), (0, 0.2)),
    ]
    return [0 if n < LEAST_WORDS and name in SHARP else v for name, v in zip(LABELLERS, out)]


class LabelModel:
    """Accuracies of the labellers and the class prior, by EM over counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        patterns, counts = np.asarray(patterns, int).reshape(-1, len(LABELLERS)), np.asarray(counts, float)
        k = patterns.shape[1]
        self.prior, self.rate = 0.9, np.tile(np.array([0.3, 0.02]), (k, 1))  # of bad votes, for bad and good texts
        sharp = np.array([x in SHARP for x in LABELLERS])
        for _ in range(rounds if len(counts) else 0):
            self.rate[sharp, 1] = np.minimum(self.rate[sharp, 1], self.rate[sharp, 0] / RATIO)
            q = self.posterior(patterns)
            w = np.stack([counts * (1 - q), counts * q], 1)
            self.prior = float(np.clip(w[:, 1].sum() / w.sum(), 0.02, 0.98))
            for j in range(k):
                voted, bad = w[patterns[:, j] > 0].sum(0), w[patterns[:, j] == 1].sum(0)
                self.rate[j] = (bad + np.array([0.3, 0.02])) / (voted + 1)
                self.rate[j, 0] = max(self.rate[j])  # a labeller is never read the wrong way round
        self.rate[sharp, 1] = np.minimum(self.rate[sharp, 1], self.rate[sharp, 0] / RATIO)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that texts with such votes are good."""
        patterns = np.asarray(patterns, int).reshape(-1, len(LABELLERS))
        rate = np.clip(self.rate, 1e-6, 1 - 1e-6)
        s = np.tile([np.log(1 - self.prior), np.log(self.prior)], (len(patterns), 1))
        for j in range(patterns.shape[1]):  # no vote says nothing
            s += np.stack([np.zeros(2), np.log(rate[j]), np.log(1 - rate[j])])[patterns[:, j]]
        return 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -500, 500)))


def hashed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed three-byte runs and runs of byte classes, each scaled to length 1 (less for short texts, which
    tell less), the share of words that repeat the one before, and a constant."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    half = dimensions // 2
    out = np.zeros(dimensions + 2, np.float32)
    if len(b) > 2:
        x = b.astype(np.uint32)
        for at, v in ((0, (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]), (half, None)):
            if v is None:
                c = _CLASS[b].astype(np.uint32)
                v = (c[:-2] * 81 + c[1:-1] * 9 + c[2:]) + 7_000_003
            h = (v * np.uint32(2654435761)) >> np.uint32(22)
            part = np.sqrt(np.bincount(h % half, minlength=half))
            out[at : at + half] = part / np.linalg.norm(part) * min(1.0, (len(b) / 256) ** 0.5)
    out[-2] = stutter(text.split())
    out[-1] = 1
    return out


class Scorer:
    """Logistic regression on hashed features with soft labels."""

    def __init__(self, x: np.ndarray, q: np.ndarray, weights: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5):
        w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
        for t in range(1, rounds + 1 if len(x) else 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weights * (p - q)).astype(np.float32) / weights.sum() + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - (rate * 0.3 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.w).astype(float), -30, 30)))


def _voted(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), pattern (a digit for each labeller) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(["".join(map(str, votes(x))) for x in batch.column(1).to_pylist()])], names=["doc_id", "h", "pattern"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, pattern string")


def _digits(patterns: list[str]) -> np.ndarray:
    return np.array([[int(c) for c in p] for p in patterns], int).reshape(-1, len(LABELLERS))


class Model:
    def __init__(self, labels: LabelModel, scorer: Scorer):
        self.labels, self.scorer = labels, scorer

    def rows(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        patterns = ["".join(map(str, votes(x))) for x in texts]
        return patterns, self.labels.posterior(_digits(patterns)), self.scorer(np.stack([hashed(x) for x in texts]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Label model over the votes on all documents; scorer from at most sample ids of each half, a text of each."""
    voted = saved(_voted(docs), "votes")
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
    counts.sort()
    labels = LabelModel(_digits([r.pattern for r in counts]), np.array([r.n for r in counts], float))
    q = labels.posterior(_digits([r.pattern for r in counts])) if counts else np.array([])
    good = [r.pattern for r, x in zip(counts, q) if x >= 0.5]
    of = dict(zip((r.pattern for r in counts), q.tolist()))
    share = sum(r.n for r, x in zip(counts, q) if x >= 0.5) / max(1, sum(r.n for r in counts))
    patterns = docs.sparkSession.createDataFrame([(p,) for p in good] or [("",)], "pattern string")
    # of an id with many rows that text counts which one_text() takes
    marked = voted.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("h", "pattern")).alias("least")).select("doc_id", F.col("least.pattern").alias("pattern"))
    marked = marked.join(F.broadcast(patterns.withColumn("good", F.lit(1))), "pattern", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    ids = None
    for side in (0, 1):
        part = marked.where(F.col("good") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionAll(part)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [hashed(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "pattern", "x"])

    chosen = one_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids.drop("good")), "doc_id"), "pattern")
    rows = chosen.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern string, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.pattern, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(len(rows), DIMENSIONS + 2)
    y = np.array([of[r.pattern] for r in rows])
    half = (y >= 0.5).mean() if len(y) else 0.5
    weights = np.where(y >= 0.5, share / max(half, 1e-9), (1 - share) / max(1 - half, 1e-9))
    return Model(labels, Scorer(x, y, weights))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then votes, posterior and score for every row."""
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["votes string, posterior double, score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            patterns, q, s = model.rows(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(patterns), pa.array(q, pa.float64()), pa.array(s, pa.float64())], names=[*keep, "votes", "posterior", "score"])

    return source.mapInArrow(work, schema)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score, keep for every row."""
    return score(docs, fit(docs)).withColumn("keep", F.col("score") >= LIMIT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer accepts; same columns."""
    inner, restored = set_aside(docs, "doc_id", "text")
    return restored(score(inner, fit(inner), tuple(inner.columns)).where(F.col("score") >= LIMIT))
