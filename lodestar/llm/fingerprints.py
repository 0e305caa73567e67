"""Document fingerprints: bottom-k sketches of hashes of five-word shingles.

A sketch is the ``K`` smallest distinct 64-bit shingle hashes of a text. Sketches of parts merge into that
of the whole (the smallest K of their union), and of two sketches one gets resemblance, containment and the
number of distinct shingles. A text of one to four words has one shingle of all its words; a text without
words has none, and two such sketches have likeness 1. Equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, task_shares, words
from lodestar.llm.ordered import order_key, shard_bounds, shards_of

K, SHINGLE = 128, 5
#: Most entries of a task's table of word hashes: about 40 MB.
TABLE = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of all shingles of a text, in order; each distinct word is hashed once."""

    def __init__(self, n: int = SHINGLE, table: int = TABLE):
        self.n, self.limit, self.table = n, table, {}

    def hashes(self, found: list[bytes]) -> np.ndarray:
        table = self.table
        if new := set(found).difference(table):
            if len(table) + len(new) > self.limit:
                table.clear()
                new = set(found)
            table.update((x, xxhash.xxh3_64_intdigest(x)) for x in new)
        h = np.array([table[x] for x in found], np.uint64)
        if not len(h):
            return h
        m = max(1, len(h) - self.n + 1)
        out = np.zeros(m, np.uint64)
        for i in range(min(self.n, len(h))):
            part = h[i : i + m] * _ODD[i % 5]
            out += mixed(part + _ODD[(i + 1) % 5])
        return mixed(out)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 4 * k:
        # the share that the smallest k of so many distinct hashes lie in, with room; else all
        low = hashes[hashes < np.uint64(min((1 << 64) - 1, int((1 << 64) * min(1.0, 2.5 * k / len(hashes)))))]
        found = np.unique(low)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / ((1 + j) * distinct(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(a: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(a), "<u8")


def edited(text: str, after: str) -> str:
    """text whose last quarter (rounded down) is replaced by as many first code points of after, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every whole text, of its edit with the next text, and their likeness.

    More columns: n_shingles, the estimated number of distinct shingles, and in_edited, the estimated share of
    them that the edited text has.

    Documents are cut into shards of ascending ids, each sorted by itself; a shard also gets the first
    document of the shard after it, so every neighbour is at hand after one shuffle of compressed texts.
    Rows that share an id follow one another by digest of their text, and an id with many rows has many
    shards; null ids come last; a null text counts as empty. A table of one row is its own next. Extra columns
    are ignored.
    """
    bounds = np.array(shard_bounds(df, doc_id), np.int64)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), order_key(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def placed(batch: pa.RecordBatch) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
        raw = [x.encode() for x in batch.column(2).to_pylist()]
        keys, digests = batch.column(1).to_numpy(zero_copy_only=False), [hashlib.sha256(x).digest()[:8] for x in raw]
        return raw, keys.tolist(), digests, shards_of(bounds, keys, np.array([int.from_bytes(x[:4]) for x in digests], np.int64))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in pieces(batches):
            _, keys, digests, shards = placed(batch)
            for s, k, d in zip(shards.tolist(), keys, digests):
                least[s] = min(least.get(s, (k, d)), (k, d))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([k for k, _ in least.values()], pa.int64()), pa.array([d for _, d in least.values()], pa.binary())], names=["shard", "k", "digest"])

    # whose text also goes to the shard before: of a shard that begins a key that key's first row; where keys
    # have several shards, some of them may be without rows, and the first rows are looked for
    if len(set(bounds.tolist())) == len(bounds):
        goes = {(k, None): (s - 1) % len(bounds) for s, k in enumerate(bounds.tolist())}
    else:
        first = source.mapInArrow(leading, "shard int, k long, digest binary").groupBy("shard").agg(F.min(F.struct("k", "digest")).alias("f"))
        first = sorted((r.shard, r.f.k, bytes(r.f.digest)) for r in first.collect())
        goes = {(k, d): first[i - 1][0] for i, (_, k, d) in enumerate(first)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in pieces(batches):
            raw, keys, digests, shards = placed(batch)
            guards: dict[int, int] = {}  # a batch's first row for each shard before
            for i, (k, d) in enumerate(zip(keys, digests)):
                if (to := goes.get((k, None), goes.get((k, d)))) is not None and (to not in guards or d < digests[guards[to]]):
                    guards[to] = i
            ids, order = batch.column(0).to_pylist(), [*range(len(raw)), *guards.values()]
            packed = [press.compress(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*shards.tolist(), *guards], pa.int32()), pa.array([0] * len(raw) + [1] * len(guards), pa.int32()), pa.array([keys[i] for i in order], pa.int64()), pa.array([ids[i] for i in order], pa.int64()), pa.array([digests[i] for i in order], pa.binary()), pa.array([packed[i] for i in order], pa.binary())],
                names=["shard", "guard", "k", "doc_id", "digest", "text"],
            )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, shingler = zstandard.ZstdDecompressor(), Shingler()
        held, at, closed, out = None, None, False, []

        def rows() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return done

        for batch in pieces(batches):
            for shard, guard, doc, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5))):
                if shard != at:
                    held, at, closed = None, shard, False
                if closed:
                    continue  # only the first of the next shard's rows counts
                text = expand.decompress(data).decode()
                mine = sketch(shingler.hashes(words(text)), k)
                if held is not None:
                    before, sk, old = held
                    new = edited(before, text)
                    changed = sketch(shingler.hashes(words(new)), k)
                    out.append((old, len(before), hashlib.sha256(new.encode()).hexdigest(), to_text(sk), to_text(changed), resemblance(sk, changed, k), resemblance(sk, mine, k), distinct(sk, k), containment(sk, changed, k)))
                held, closed = (text, mine, doc), bool(guard)
                if len(out) >= 500:
                    yield rows()
        if out:
            yield rows()

    moved = source.mapInArrow(dealt, "shard int, guard int, k long, doc_id long, digest binary, text binary")
    moved = moved.repartition(task_shares(df), "shard").sortWithinPartitions("shard", "guard", "k", "digest")
    return moved.mapInArrow(paired, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double")


def sketches(df: DataFrame, key: str, text: str = "text", k: int = K) -> DataFrame:
    """key, sketch (base64), n_shingles: one sketch of all texts of each key, from merged partial sketches.

    A task sends at most k hashes of a key for each batch of texts, and of those the least k remain before the
    shuffle, so a key with a third of all rows costs no task more than k rows of each other. A null key is a
    key like others; null texts have no shingles; a key without shingles has the empty sketch.
    """
    source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind, flip = source.schema["key"].dataType.simpleString(), np.uint64(1 << 63)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in pieces(batches):
            held: dict = {}
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = sketch(shingler.hashes(words(x)), k)
                held[name] = merge(held[name], part, k) if name in held else part
            names = [name for name, part in held.items() for _ in range(max(1, len(part)))]
            # signed numbers in the order of the hashes; null for a key without shingles
            parts = [pa.array((p ^ flip).view(np.int64)) if len(p) else pa.nulls(1, pa.int64()) for p in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.concat_arrays(parts) if parts else pa.array([], pa.int64())], names=["key", "h"])

    rows = source.mapInArrow(partial, f"key {kind}, h long").withColumn("n", F.dense_rank().over(Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last()))).where(F.col("n") <= k)
    held = rows.groupBy("key").agg(F.array_sort(F.collect_set("h")).alias("hs"))

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [np.array(x, np.int64).view(np.uint64) ^ flip for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())], names=["key", "sketch", "n_shingles"])

    return held.mapInArrow(text_of, f"key {kind}, sketch string, n_shingles double").withColumnRenamed("key", key)
