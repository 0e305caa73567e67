"""Language-model scoring by a probabilistic suffix tree.

Text is a sequence of tokens: words, then one end. The tree predicts it byte by byte (words with a separator
after each, then the end): a context of up to ``DEPTH`` bytes, of any value and of words before too, is a state
if it occurs at least ``LEAST`` times and its next-byte distribution diverges from that of the longest shorter
context that is a state. Distributions are smoothed with that one's, down to all bytes alike. A byte is scored
in the state of the longest suffix before it.

Events are those of the base model: each known token, and one for all unknown words. Unknown words have the
share of training tokens that are the only one of their kind (what a next token is likely to be new by). The
rest goes to known tokens: a mix of the token's share of all training tokens and what the tree gives its
bytes, whose sum over known tokens is below 1.

What is gathered grows with the input, without a cap: counts of all distinct training words and of all runs of
``DEPTH + 1`` bytes, each run of any document with its probability in the tree. Runs and words that are
frequent, at most ``HOT_RUNS`` and ``HOT``, are scored where the text is read; tokens with any other meet
their counts and runs in joins, and only their sums return to the documents.

Defined results: a null or empty text is one end; a null id counts as the text "" for the split; repeated
rows each give a row and each count in training; with nothing to learn from, every token is unknown at odds of one half; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, saved, words
from lodestar.llm.toxicity import remainder

DEPTH, LEAST, DIVERGENCE = 5, 4, 0.01
#: Most frequent words at hand in each task: about 25 MB.
HOT = 150_000
#: Most frequent runs at hand in each task: about 40 MB.
HOT_RUNS = 1_000_000
#: What the tree's probability of a token weighs; the token's own share has the rest.
TREE = 0.5
SEPARATOR, END = b" ", b"\n"
#: Words counted in a task before they go on; bytes of text whose runs are counted at once.
FLUSH, RUNS = 400_000, 12_000_000
_PAD = END * DEPTH


def sequence(found: list[bytes]) -> bytes:
    """What the tree predicts of a text, after DEPTH ends as first context."""
    return _PAD + b"".join([w + SEPARATOR for w in found]) + END


def runs(data: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes up to each position from DEPTH on, as one number."""
    n = len(data) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(DEPTH + 1):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


class Tree:
    """States and smoothed distributions in memory, from few counts; grow() has the same for a table of any size.

    rows: for each length k of context, arrays (context, byte, count).
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        table, self.state = [], {}
        for k, (context, byte, n) in enumerate(rows):
            found = {}
            for c in np.unique(context).tolist() if k else [0]:
                own = context == c
                counts = np.bincount(byte[own], n[own].astype(float), 256)
                parent = table[self.at(k - 1, c)] if k else np.full(256, 1 / 256)
                some, total = counts > 0, counts.sum()
                if k and (total < LEAST or (counts[some] / total * np.log(counts[some] / total / parent[some])).sum() < DIVERGENCE):
                    continue
                distinct = max(1, some.sum())
                found[k, c] = len(table)
                table.append((counts + distinct * parent) / (total + distinct))
            self.state |= found
        self.log = np.log10(np.array(table)).astype(np.float32)

    def at(self, k: int, context: int) -> int:
        """Row of the longest state that the context's last k bytes end with."""
        return next(self.state[i, c] for i in range(k, -1, -1) if (i, c := context & ((1 << 8 * i) - 1)) in self.state)


class Lookup:
    """log10 probabilities of the runs at hand; keys ascend."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, counts: np.ndarray):
        self.keys, self.logs_of, self.bits = keys, logs, max(8, len(keys).bit_length() + 1)
        self.order, self.slots = np.argsort(counts, kind="stable").astype(np.int32), None

    def _slot(self, r: np.ndarray) -> np.ndarray:
        return ((r * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.intp)

    def __call__(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run its log (0 if it isn't at hand), and the places of those that aren't."""
        if not len(self.keys):
            return np.zeros(len(r), np.float32), np.arange(len(r))
        if self.slots is None:  # in each process once; of runs that share a slot the most frequent has it
            self.slots, self.values = np.full(1 << self.bits, self.keys[0]), np.full(1 << self.bits, self.logs_of[0])
            at = self._slot(self.keys[self.order])
            self.slots[at], self.values[at] = self.keys[self.order], self.logs_of[self.order]
        at = self._slot(r)
        out, rest = self.values[at], np.flatnonzero(self.slots[at] != r)
        found = np.minimum(np.searchsorted(self.keys, r[rest]), len(self.keys) - 1)
        same = self.keys[found] == r[rest]
        out[rest] = np.where(same, self.logs_of[found], np.float32(0))
        return out, rest[~same]


def _counted(train: DataFrame) -> DataFrame:
    """word, n over all training texts; the end is the word of one line feed, which no word is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                seen.update(words(text))
            seen[END] += batch.num_rows
            if len(seen) > FLUSH:
                yield rows()
        if seen:
            yield rows()

    return train.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _runs(rows: DataFrame) -> DataFrame:
    """run, n, c: how often each run of DEPTH + 1 bytes ends at a byte that the tree predicts, in training and in all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0

        def counted(texts: list[bytes], learn: bool) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(texts), np.uint8)
            inside = np.ones(len(data), bool)
            ends = np.cumsum([len(x) for x in texts]) - [len(x) for x in texts]
            for i in range(DEPTH):
                inside[ends + i] = False
            found, n = np.unique(runs(data)[inside[DEPTH:]], return_counts=True)
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n * int(learn), pa.int64()), pa.array(n, pa.int64())], names=["run", "n", "c"])

        for batch in pieces(batches):
            for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[out].append(sequence(words(text)))
                size += len(held[out][-1])
                if size >= RUNS:
                    yield from (counted(x, not i) for i, x in enumerate(held) if x)
                    size = 0
        yield from (counted(x, not i) for i, x in enumerate(held) if x)

    return rows.select("text", "held_out").mapInArrow(work, "run long, n long, c long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def grow(counts: DataFrame) -> DataFrame:
    """run, log, c: log10 of what the tree gives the last byte of each run after the bytes before it.

    Level by level: a context's rows meet those of the context that is shorter by its first byte. Neither a
    context nor a row of the level before has more than 256 of them, so no key is hot.
    """
    level = None
    for k in range(DEPTH + 1):
        low = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << 8 * n) - 1))
        row = counts.groupBy(low("run", k + 1).alias("r")).agg(F.sum("n").alias("n"), F.sum("c").alias("c")) if k < DEPTH else counts.withColumnRenamed("run", "r")
        row = row.withColumn("q", F.lit(1 / 256)) if level is None else row.withColumn("s", low("r", k)).join(level.select(F.col("r").alias("s"), F.col("p").alias("q")), "s").drop("s")
        row = row.withColumn("context", F.shiftrightunsigned("r", 8))
        of = Window.partitionBy("context").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        part = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("q"))).otherwise(0.0)
        row = row.withColumns({"all": F.sum("n").over(of), "kinds": F.greatest(F.lit(1), F.sum((F.col("n") > 0).cast("long")).over(of)), "far": F.sum(part).over(of)})
        state = (F.col("all") >= LEAST) & (F.col("far") / F.col("all") - F.log("all") >= DIVERGENCE) if k else F.lit(True)
        own = (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("all") + F.col("kinds"))
        level = row.select("r", "c", F.when(state, own).otherwise(F.col("q")).alias("p"))
    return level.select(F.col("r").alias("run"), F.log10("p").cast("float").alias("log"), "c")


def _cut(counts: DataFrame, most: int) -> int | None:
    """The least count c from which at most so many rows have it or more; None if there are none such."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    cut, kept = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.s):
        kept += r.n
        if kept > most:
            break
        cut = r.c
    return cut


def frequent(counts: DataFrame, most: int = HOT) -> dict[bytes, int]:
    """The most frequent words, at most so many: those above a count that the histogram of counts gives."""
    cut = _cut(counts, most)
    return {} if cut is None else {bytes(r.word): r.c for r in counts.where(F.col("c") >= cut).collect()}


def at_hand(grown: DataFrame, most: int) -> Lookup:
    """The most frequent runs of all texts, at most so many."""
    cut = _cut(grown, most)
    got = grown.where(F.lit(False) if cut is None else F.col("c") >= cut).orderBy("run").toArrow()
    return Lookup(got.column("run").to_numpy().astype(np.uint64), got.column("log").to_numpy(), got.column("c").to_numpy())


def score(docs: DataFrame, modulus: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learned from the rows whose crc32 of the id as text modulo modulus is not held.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (remainder(doc_id, modulus) == held).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    vocabulary = saved(_counted(train), "words")
    distinct, total, single = vocabulary.agg(F.count("*"), F.sum("c"), F.count_if(F.col("c") == 1)).first()
    total = total or 0
    new = (single + 1) / (total + 2)
    grown = saved(grow(saved(_runs(rows), "runs")), "grown")
    lookup = at_hand(grown, HOT_RUNS)
    whole = grown.count() == len(lookup.keys)
    hot = spark.sparkContext.broadcast((lookup, frequent(vocabulary)))
    low = np.log10(float(total + distinct + 1))
    share, spelt = (1 - new) * (1 - TREE) / max(1, total), (1 - new) * TREE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = hot.value
        key = TaskContext.get().partitionId() << 36
        get = counts.get
        for batch in pieces(batches):
            out: list[list] = [[] for _ in range(10)]
            for text in batch.column(1).to_pylist():
                found = words(text)
                met = runs(np.frombuffer(sequence(found), np.uint8))
                logs, missed = lookup(met)
                ends = np.fromiter(map(len, found), np.int64, len(found)) + 1
                starts = np.append(0, np.cumsum(ends))
                by_tree = np.add.reduceat(logs.astype(np.float64), starts)
                c = np.array([get(w, -1) for w in found] + [get(END, -1)], np.int64)
                lacks = np.searchsorted(starts, missed, "right") - 1
                here = c > 0
                here[lacks] = False
                mixed = np.log10(share * c[here] + spelt * 10.0 ** by_tree[here])
                rest = np.flatnonzero(~here)
                key += 1
                every = [*found, END]
                for column, x in zip(out, (key, len(every), int(here.sum()), float(np.log10(c[here] + 1.0).sum()) - low * len(every), float(mixed.sum()), [every[i] for i in rest.tolist()], by_tree[rest], c[rest], np.searchsorted(rest, lacks), met[missed].view(np.int64))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "held_out", "key", "n_tokens", "known", "base", "mixed", "words", "logs", "counts", "lacks", "runs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = saved(rows.select("doc_id", "text", "held_out").mapInArrow(work, f"doc_id {kind}, held_out boolean, key long, n_tokens long, known long, base double, mixed double, words array<binary>, logs array<double>, counts array<long>, lacks array<long>, runs array<long>"), "parts")
    rare = parts.select("key", F.posexplode(F.arrays_zip("words", "logs", "counts")).alias("i", "r")).select("key", "i", F.col("r.words").alias("word"), F.col("r.logs").alias("log"), F.col("r.counts").alias("c"))
    counted = rare.where(F.col("c") < 0).drop("c").join(vocabulary, "word", "left").select("key", "i", "log", F.coalesce("c", F.lit(0)).alias("c"))
    if not whole:
        # counts at hand don't go into the join, where common words would be hot keys
        counted = counted.unionByName(rare.where(F.col("c") > 0).select("key", "i", "log", "c"))
        more = parts.select("key", F.explode(F.arrays_zip("lacks", "runs")).alias("r")).select("key", F.col("r.lacks").alias("i"), F.col("r.runs").alias("run"))
        more = more.join(grown.select("run", F.col("log").cast("double").alias("more")), "run").select("key", "i", "more")
        # a sum for each token; tokens without such runs have their own part only
        counted = counted.unionByName(more, True).groupBy("key", "i").agg(F.coalesce(F.sum("log"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("more"), F.lit(0.0)).alias("b"), F.max("c").alias("c")).select("key", (F.col("a") + F.col("b")).alias("log"), "c")
    mix = F.log10(F.when(F.col("c") > 0, F.col("c") * share + F.lit(spelt) * F.pow(F.lit(10.0), "log")).otherwise(F.lit(new)))
    sums = counted.groupBy("key").agg(F.sum((F.col("c") > 0).cast("long")).alias("k2"), F.sum(F.log10(F.col("c") + 1.0)).alias("b2"), F.sum(mix).alias("m2"))
    zero = F.lit(0.0)
    return parts.drop("words", "logs", "counts", "lacks", "runs").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero)).alias("base_score"), (F.col("mixed") + F.coalesce("m2", zero)).alias("score"),
    )
