"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labels too: a word's weight is the log-odds of toxic labels among training
documents that hold it or one of its beginnings of ``STEMS`` letters, drawn towards 0 where few hold it.
For the trees' training each document's own part in those counts is taken out, so a word that only one
document holds tells nothing. Features of a text: densities of lexicon words by weight, the strongest ones,
how many stand near second-person words, capitals, marks, digits, and words whose weight shows only after
letters are put back for look-alikes and separators.

The fit takes at most ``SAMPLE`` labelled ids of each class, the first by a hash of the id, each with one text
whatever its number of rows; rows of a class weigh so that the classes keep their shares. Their texts stay in
tasks: the driver gets the lexicon's counts and a row of features for each. Scoring reads every text once, without a
shuffle; the model (below 10 MB) goes with the tasks.

Defined results: a null text, an empty one and one without words score the share of toxic labels; with labels of one class only, or
none, every score is that share of toxic labels (0 without labels); repeated rows give equal rows; a null id
counts as the text "" for the remainder; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import one_text, pieces, saved, set_aside, task_shares

#: Most labelled ids of each class in the fit.
SAMPLE = 3_000
STEMS = (3, 4, 5, 6, 7)
#: How many documents the prior of a word's weight counts as; least weight that is kept.
PRIOR, LEAST = 3.0, 0.7
#: Most entries of a task's table of words: about 50 MB.
TABLE = 250_000
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti contigo tus usted ustedes vosotros vuestro".split())
#: Characters that stand in for letters.
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
#: Weights from which words count in a density. Below odds of 7 to 1 words that a few toxic texts share by chance
#: would count too, and be taken for a sign where labels are few.
LEVELS = (2.0, 2.5, 3.0, 4.0, 5.0)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_]")
_CLASS = np.zeros(256, np.intp)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 stop, 6 !, 7 ?, 8 other mark, 9 non-ASCII
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 9 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:'\"-()" else 6 if _c == "!" else 7 if _c == "?" else 8 if _i > 32 else 0


def plain(token: str) -> str:
    """The token in lower case without marks at its ends."""
    return _EDGE.sub("", token).lower()


def restored(token: str) -> str:
    """plain() of the token with letters for look-alikes and without what parts single letters."""
    x = unicodedata.normalize("NFKC", token).rstrip(".,;:!?\"')").translate(ALIKE)
    return "".join(_INNER.findall(x)).lower()


def items(word: str) -> list[str]:
    """What the lexicon may hold of a word: its beginnings, and all of it."""
    return [word[:n] + "*" for n in STEMS if len(word) >= n] + [word] if word else []


def weight(toxic: float, clean: float, share: float) -> float:
    """Log-odds of toxic among holders of an item against all, with the share as PRIOR holders."""
    p = (toxic + PRIOR * share) / (toxic + clean + PRIOR)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)) - np.log(share / (1 - share)))


class Reader:
    """Features of texts under a lexicon item -> weight."""

    def __init__(self, lexicon: dict[str, float], table: int = TABLE):
        self.lexicon, self.limit, self.table = lexicon, table, {}

    def look(self, token: str, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
        """Weight, weight that shows only when restored, whether second person, whether a capital word."""
        word = plain(token)
        w = max((lexicon.get(x, 0.0) for x in items(word)), default=0.0)
        hidden = 0.0
        if w < 2 and not (word.isalpha() or not _INNER.search(token)):
            other = restored(token)
            if other != word:
                hidden = max((lexicon.get(x, 0.0) for x in items(other)), default=0.0)
        return max(w, hidden), hidden, float(word in SECOND), float(len(word) > 1 and token.upper() == token and token.lower() != token)

    def features(self, text: str, changed: dict[str, float] | None = None) -> list[float]:
        """changed: other weights for items in this text only (for a training document without its own part)."""
        found = text.split()
        if changed is None:
            if new := set(found).difference(self.table):
                if len(self.table) + len(new) > self.limit:
                    self.table.clear()
                    new = set(found)
                for x in new:
                    self.table[x] = self.look(x, self.lexicon)
            rows = [self.table[x] for x in found]
        else:
            own = self.lexicon | changed
            seen = {x: self.look(x, own) for x in set(found)}
            rows = [seen[x] for x in found]
        n = len(rows)
        a = np.array(rows, np.float64).reshape(-1, 4)
        w = a[:, 0]
        counts = [float((w >= x).sum()) for x in LEVELS]
        strong = np.sort(np.unique(w[w > 0]))[::-1][:3]
        top = np.zeros(3)
        top[: len(strong)] = strong
        near = 0.0
        hits = np.flatnonzero(w >= 3.0)
        you = np.flatnonzero(a[:, 2])
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= 5).sum())
        kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=10).astype(float)
        size, letters = max(1.0, kinds.sum()), max(1.0, kinds[1] + kinds[2] + kinds[9])
        per = max(1, n)
        # of features that part the classes alike the first is taken: the strongest word before counts of them
        return [np.log1p(n), *top, *reversed(counts), *(x / per for x in counts), near, near / per, len(you) / per, float((a[:, 1] >= 2).sum()), float((a[:, 1] >= 2).sum()) / per, kinds[2] / letters, float(a[:, 3].sum()) / per, kinds[6] / size, kinds[7] / size, kinds[5] / size, kinds[8] / size, kinds[3] / size, letters / per]


class Trees:
    """Boosted trees of logistic loss on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 2, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 6.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # a feature that is nearly always 0 is still cut above 0
        self.cuts = [np.unique(np.append(c, [v[v > 0].min() / 2, *np.quantile(v[v > 0], [0, 0.25, 0.5, 0.75])])) - 1e-12 if (v > 0).any() else c for c, v in zip(self.cuts, x.T)]
        b, m = self._bins(x), max(len(c) for c in self.cuts) + 1
        p = np.clip(np.average(y, weights=weights), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f, features = np.full(len(y), self.base), x.shape[1]
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = weights * (y - q), weights * np.maximum(q * (1 - q), 1e-9)
            node, tree = np.zeros(len(y), np.intp), {}
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.zeros(width), np.full(width, -1), np.zeros(width, np.intp)
                for j in range(features):
                    key = local * m + b[:, j]
                    gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                    ns = np.bincount(key, minlength=width * m).reshape(width, m).cumsum(1)
                    G, H, N = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (G - gs) ** 2 / (H - hs + self.ridge) - G**2 / (H + self.ridge)
                    gain[(ns < self.least) | (N - ns < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best[0] + 1e-9
                    for a, v in zip(best, (top, np.full(width, j), at)):
                        a[better] = v[better]
                for k in range(width):
                    tree[first + k] = (int(best[1][k]), int(best[2][k]))
                right = np.zeros(len(y), bool)
                for k in range(width):
                    j, c = tree[first + k]
                    if j >= 0:
                        own = local == k
                        right[own] = b[own, j] > c
                node = 2 * node + 1 + right
            first = (1 << self.depth) - 1
            gs, hs = np.bincount(node - first, g, first + 1), np.bincount(node - first, h, first + 1)
            leaves = self.rate * gs / (hs + self.ridge)
            self.trees.append((tree, leaves))
            f += leaves[node - first]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1) if len(x) else np.zeros((0, x.shape[1]), np.intp)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._bins(x), np.full(len(x), self.base), np.arange(len(x))
        for tree, leaves in self.trees:
            splits = np.array([tree[i] for i in range(len(tree))])
            node = np.zeros(len(x), np.intp)
            for _ in range(self.depth):
                j, c = splits[node, 0], splits[node, 1]
                node = 2 * node + 1 + ((j >= 0) & (b[rows, j] > c))
            f += leaves[node - len(tree)]
        return f


class Isotonic:
    """Non-decreasing map from margins to shares of label 1, linear between the means of its blocks."""

    def __init__(self, margins: np.ndarray, y: np.ndarray, weights: np.ndarray):
        blocks: list[list[float]] = []
        for m, v, w in zip(*(a[np.argsort(margins, kind="stable")].tolist() for a in (margins, y, weights))):
            blocks.append([m * w, v * w, w])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[0] / b[2] for b in blocks])
        self.y = np.array([b[1] / b[2] for b in blocks])

    def __call__(self, margins: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margins, self.x, self.y), 0.0, 1.0)


def items_of(text: str) -> set[str]:
    return {i for t in set(text.split()) for i in items(plain(t))}


class Lexicon:
    """Weights of items from how many toxic and clean training documents hold each.

    counts: item -> (toxic, clean), of items that two or more toxic documents hold; n: training documents of
    either class; share: that of toxic labels before documents were chosen.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], n: tuple[int, int], share: float):
        # counts as if the classes had their true shares
        self.share, self.up = share, (share * sum(n) / n[0], (1 - share) * sum(n) / n[1])
        self.counts = {i: c for i, c in counts.items() if c[0] >= 2 and self._weight(*c) >= LEAST}
        self.weights = {i: self._weight(*c) for i, c in self.counts.items()}
        self.reader = Reader(self.weights)

    def _weight(self, toxic: float, clean: float) -> float:
        return weight(toxic * self.up[0], clean * self.up[1], self.share)

    def without(self, text: str, label: int) -> list[float]:
        """Features of a training document under weights that lack its own part."""
        own = {i: max(0.0, self._weight(c[0] - label, c[1] - (1 - label))) for i in items_of(text) if (c := self.counts.get(i))}
        return self.reader.features(text, own)


def fold(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % 5


class Model:
    """Trees and their calibration from the features of training documents; without a lexicon every score is the share."""

    def __init__(self, share: float, lexicon: Lexicon | None = None, x: np.ndarray | None = None, y: np.ndarray | None = None, folds: np.ndarray | None = None):
        self.share, self.trees = share, None
        if lexicon is None:
            return
        self.reader, y = lexicon.reader, np.asarray(y, float)
        weights = np.where(y == 1, *lexicon.up)
        margins = np.zeros(len(y))
        for k in range(5):
            train, test = folds != k, folds == k
            if test.any() and 0 < y[train].sum() < train.sum():
                margins[test] = Trees().fit(x[train], y[train], weights[train]).margin(x[test])
        self.trees, self.calibrate = Trees().fit(x, y, weights), Isotonic(margins, y, weights)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([self.reader.features(t) for t in texts])
        return np.where(x[:, 0] > 0, self.calibrate(self.trees.margin(x)), self.share)  # without words nothing is known


def remainder(doc_id: str, m: int) -> F.Column:
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Model from labelled rows whose remainder by 3 is not 1; at most sample ids of each class, a text of each."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionAll(part)
    # at most twice the sample's bound of ids: small enough to send to every task; their texts stay in tasks
    rows = one_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"), "y")
    rows = saved(rows.withColumn("y", F.col("y").cast("int")).repartition(task_shares(docs)), "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen = Counter(), Counter()
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[1 - y].update(items_of(text))
            found = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([seen[0][i] for i in found], pa.int64()), pa.array([seen[1][i] for i in found], pa.int64())], names=["item", "toxic", "clean"])

    rows = rows.select("doc_id", "text", "y")
    counts = rows.mapInArrow(counted, "item string, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t > 1")
    # only what can have a weight leaves the tasks: odds that with the prior's part are above all by e ** LEAST / 2
    up = share * sum(n.values()) / n[1], (1 - share) * sum(n.values()) / n[0]
    counts = counts.where((F.col("t") * up[0] + PRIOR * share) * (1 - share) >= (F.col("c") * up[1] + PRIOR * (1 - share)) * share * float(np.exp(LEAST)) * 0.99)
    lexicon = Lexicon({r.item: (r.t, r.c) for r in counts.collect()}, (n[1], n[0]), share)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, y = batch.column(1).to_pylist(), batch.column(2)
            x = [lexicon.without(t, label) for t, label in zip(texts, y.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), y, pa.array([fold(t) for t in texts], pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    found = rows.mapInArrow(described, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, fold int, x array<double>").collect()
    found.sort(key=lambda r: (r.doc_id, r.y, r.fold, r.x))
    return Model(share, lexicon, np.array([r.x for r in found]), np.array([r.y for r in found]), np.array([r.fold for r in found]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and score, for every row."""
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(model.scores(batch.column(len(keep)).to_pylist()), pa.float64())], names=[*keep, "score"])

    return source.mapInArrow(work, schema)


#: Score from which a text counts as toxic.
LIMIT = 0.7


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; same columns. Texts pass through the scoring task."""
    inner, restored_names = set_aside(docs, "doc_id", "text")
    return restored_names(score(inner, fit(inner, labels), tuple(inner.columns)).where(F.col("score") < LIMIT))
