"""Token ids as files of Simple-8b words.

Simple-8b packs ids into 64-bit words: the four highest bits select how many values of which width follow
(``SELECTORS``). An id of 2**60 or more is packed as 0 and kept in its block's escape list. A block holds
whole documents, at least ``BLOCK_IDS`` ids but in a shard's last one, and says where each document
begins, so it decodes without any other block.

Layout of a block (little-endian): magic ``S8B1``; counts of ids, documents, words and escapes as uint32;
document ids int64; a byte for each document, 1 where its id is null; document lengths uint32; padding to
8 bytes; words uint64; escape positions uint32, padded; escape values uint64.

Blocks are rows of a Parquet table (shard, seq, before, n_ids, n_docs, block) in the folder that is named, because
Spark's writers reach every store that a cluster can use and commit whole files only. Shards follow one
another in ascending document id; before counts the shard's ids before a block, and the ids before a shard
are sums of index columns, so that reading is one scan.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, task_shares
from lodestar.llm.ordered import order_key, shard_bounds, shards_of

#: Fixed values of Simple-8b: values in a word, and bits of each.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC = b"S8B1"
BLOCK_IDS = 16_384
#: Most entries of a process's table of distinct words: about 150 MB. More only if texts looked up at once have more.
TABLE = 600_000
BLOCKS = "shard int, seq int, before long, n_ids long, n_docs long, block binary"


#: Bits of each number below 2**16.
_BITS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.uint8)


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS[ids]
    out = np.zeros(len(ids), np.uint8)
    for shift in (48, 32, 16, 0):
        part = _BITS[(ids >> np.uint64(shift)) & np.uint64(0xFFFF)]
        out = np.where((out == 0) & (part > 0), part + np.uint8(shift), out)
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the ids, and the positions and values of the escapes."""
    ids = np.ascontiguousarray(ids, np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    values = ids[at]
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), at.astype(np.uint32), values
    # the densest selector from each position on: the widest of so many ids fits. Each count is at most twice
    # the one before, so two windows of that one cover its window
    best = np.full(n, len(SELECTORS) - 1, np.int8)
    place, widest, size = np.arange(n), _width(ids), 1
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        if n < count:
            break
        widest, size = np.maximum(widest[: size - count], widest[count - size :]), count
        fits = widest <= bits
        if not fits.any():
            break  # nor do more ids fit in fewer bits
        np.putmask(best[: n - count + 1], fits, np.int8(s))
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    # where the words begin: each is left by its count; 16 at a time, and those between from the shorter leaps
    after = np.append(np.minimum(place + counts[best], n), n)
    leaps = [after]
    for _ in range(4):
        leaps.append(leaps[-1][leaps[-1]])
    far, starts, i = leaps.pop(), [], 0
    while i < n:
        starts.append(i)
        i = int(far[i])
    starts = np.array(starts, np.int64)
    for leap in reversed(leaps):
        starts = np.stack([starts, leap[starts]], 1).reshape(-1)
    starts = starts[starts < n]
    chosen = best[starts].astype(np.int64)
    out = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(chosen == s)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[rows] |= np.bitwise_or.reduce(ids[starts[rows] + np.arange(count)[:, None]] << shifts[:, None], axis=0)
    return out, at.astype(np.uint32), values


def unpack(words: np.ndarray, n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ids of pack(): for each selector, all its words at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(chosen == s)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[rows] + np.arange(count)[:, None]] = (words[rows] >> shifts[:, None]) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[at] = values
    return out


def _pad(x: bytes) -> bytes:
    return x + b"\0" * (-len(x) % 8)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids between the two stages: two bytes each if they fit, and a last byte that says so."""
    small = bool(not len(ids) or ids.max() < 1 << 16)
    return (ids.astype("<u2") if small else ids).tobytes() + bytes([small])


def to_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, at, values = pack(ids)
    head = MAGIC + np.array([len(ids), len(doc_ids), len(words), len(at)], np.uint32).tobytes()
    head += np.array([x or 0 for x in doc_ids], np.int64).tobytes() + bytes(x is None for x in doc_ids) + np.array(lengths, np.uint32).tobytes()
    return _pad(head) + words.tobytes() + _pad(at.tobytes()) + values.tobytes()


def from_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, docs, n_words, escapes = (int(x) for x in np.frombuffer(block, np.uint32, 4, 4))
    p = 20
    doc_ids = np.frombuffer(block, np.int64, docs, p).tolist()
    p += 8 * docs
    doc_ids = [None if null else x for x, null in zip(doc_ids, block[p : p + docs])]
    p += docs
    lengths = np.frombuffer(block, np.uint32, docs, p).astype(np.int64)
    p += 4 * docs
    p += -p % 8
    words = np.frombuffer(block, np.uint64, n_words, p)
    p += 8 * n_words
    at = np.frombuffer(block, np.uint32, escapes, p)
    p += 4 * escapes
    p += -p % 8
    return doc_ids, lengths, unpack(words, n, at, np.frombuffer(block, np.uint64, escapes, p))


#: Marks that after a letter or digit are a token sequence of their own at a word's end.
TAIL = ".,!?;:%&$*#|"
def _stable(kinds: str) -> str:
    """A character class of those whose category is one of kinds in an old version of Unicode, which later ones keep."""
    same = [c for c in map(chr, range(0x10000)) if unicodedata.ucd_3_2_0.category(c)[0] in kinds and unicodedata.category(c)[0] in kinds]
    cuts = [i for i, c in enumerate(same) if not i or ord(c) != ord(same[i - 1]) + 1] + [len(same)]
    return "[" + "".join(f"{same[i]}-{same[j - 1]}" for i, j in zip(cuts, cuts[1:])) + "]"


#: Letters, and letters or numbers, in every version of Unicode that a library may hold.
_LETTERS, _LETTER_OR_NUMBER = re.compile(_stable("L") + "+"), re.compile(_stable("LN"))


def parts_at_end(core: str) -> bool:
    """Whether a pattern of letters, numbers and marks parts core from marks after it.

    What the pattern sees is normal and in lower case; there a letter may end in a mark of its own, which
    would go with those that follow.
    """
    if core[-1:].isascii():
        return core[-1:].isalnum()
    return _LETTER_OR_NUMBER.fullmatch(unicodedata.normalize("NFC", core)[-1].lower()[-1]) is not None


def _bytes_in(some: bytes) -> bytes:
    """A table for bytes.translate() that gives 1 for those in some and 0 for others."""
    return bytes(x in some for x in range(256))


_SPACES = bytes.maketrans(b"\t\n\r", b"   ")
_IN_TAIL, _ALNUM = _bytes_in(TAIL.encode()), np.frombuffer(_bytes_in((string.ascii_letters + string.digits).encode()), bool)


def spaced_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words between white space, one after the other, and how many there are up to each text's end.

    Marks of ``TAIL`` that end a word are words of their own where parts_at_end() surely holds: after ASCII letters and
    digits and the letters from U+00C0 to U+00FF. So a word is the same with a comma and without.
    """
    rows = pa.array([x + " " for x in texts], pa.large_string())
    sizes = np.frombuffer(rows.buffers()[1], np.int64, len(texts) + 1)
    spaced = rows.buffers()[2].to_pybytes()[: sizes[-1]].translate(_SPACES)
    data, tail = np.frombuffer(spaced, np.uint8), np.frombuffer(spaced.translate(_IN_TAIL), bool)
    spaces = data == ord(" ")
    stop = np.flatnonzero(spaces)
    begin = np.flatnonzero(tail[1:] & ~tail[:-1]) + 1
    marked = np.flatnonzero(tail[stop - 1] & (stop > 0))
    cut = np.append(begin, 0)[np.searchsorted(begin, stop[marked]) - 1]  # without a begin of its own: the first byte
    before, lead = data[cut - 1], data[cut - 2]
    fits = (cut > 0) & (_ALNUM[before] | ((cut > 1) & (lead == 0xC3) & (before != 0x97) & (before != 0xB7)))
    marked, cut = marked[fits], cut[fits]
    # where words end and tails begin, less the spaces before, which are left out
    offsets = np.insert(stop - np.arange(len(stop)), np.append(0, marked), np.append(0, cut - marked))
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~spaces])])
    texts_end = np.searchsorted(stop, sizes[1:])  # spaces up to each text's end, its own included
    return words, texts_end + np.searchsorted(marked, texts_end)


#: Encoders of this process, by tokenizer: a worker that runs many tasks learns a word once.
_encoders: dict[int, WordEncoder] = {}


def word_encoder(tokenizer: str) -> WordEncoder:
    """This process's encoder of a tokenizer; reading one takes as long as encoding megabytes."""
    known = hash(tokenizer)
    if known not in _encoders:
        _encoders[known] = WordEncoder(tokenizer)
    return _encoders[known]


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct spaced word encoded once.

    Holds for tokenizers whose pre-tokenizer drops white space and splits letters from marks, so that no
    token crosses either. New words are encoded in one call, parted by a special token that stands for itself.
    """

    def __init__(self, tokenizer: str, table: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tok, self.limit, self.table = tokenizers.Tokenizer.from_str(tokenizer), table, {}
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        self.apart = ids("ab cd,%\nab\tcd,%") == 2 * (ids("ab") + ids("cd") + ids(",%"))
        self.lower = ids("AB É") == ids("ab é")
        self.quick, self.last = self._quick(tokenizers, tokenizer)
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.special = [x for _, x in special]
        self.sep_id, self.sep = special[0] if special else (None, "")

    def _quick(self, tokenizers, source: str):  # noqa: ANN001, ANN202
        """A tokenizer for words of letters that are normal already, and which ids end a word; none if it doesn't fit.

        Such words are single pre-tokens, so neither normalizer nor pattern has anything left to do for them.
        """
        j = json.loads(source)
        parts = (j.get("pre_tokenizer") or {}).get("pretokenizers") or []
        suffix = j["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (j.get("normalizer") or {}).get("normalizers") or []]
        if not suffix or [x["type"] for x in parts] != ["Split", "ByteLevel"] or kinds != ["NFC", "Replace", "Lowercase"] or r"[\p{L}]+" not in parts[0]["pattern"].get("Regex", ""):
            return None, None
        j |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, parts[1]]}}
        last = np.zeros(max(j["model"]["vocab"].values()) + 1, bool)
        last[[i for x, i in j["model"]["vocab"].items() if x.endswith(suffix)]] = True
        return tokenizers.Tokenizer.from_str(json.dumps(j)), last

    def _learn(self, new: list[str], normal: bool) -> None:
        """Adds words to the table: the library sees what stands before a word's last marks, once."""
        table, letters, others, parts, all_letters = self.table, set(), set(), [], _LETTERS.fullmatch
        for word in new:
            if all_letters(word):
                letters.add(word)
                continue
            core = word.rstrip(TAIL)
            if len(core) < len(word) and parts_at_end(core):
                tail = word[len(core) :]
                parts.append((word, core, tail))
                others.add(tail)
                (letters if all_letters(core) else others).add(core)
            else:
                others.add(word)
        if not normal or self.quick is None:
            others |= letters
        else:
            letters = [x for x in letters if x not in table]
            for i in range(0, len(letters), 1000):
                part = letters[i : i + 1000]
                ids = np.array(self.quick.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                self._put(part, ids, np.flatnonzero(self.last[ids]) + 1, 0)
        self._ask([x for x in others if x not in table])
        for word, core, tail in parts:
            table[word] = table[core] + table[tail]

    def _put(self, part: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        data, start = ids.tobytes(), 0
        for word, stop in zip(part, (4 * ends).tolist(), strict=True):
            self.table[word] = data[start:stop]
            start = stop + 4 * skip

    def _ask(self, new: list[str]) -> None:
        alone = [x for x in new if self.sep_id is None or any(y in x for y in self.special)]
        for word, x in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False)):
            self.table[word] = np.array(x.ids, "<u4").tobytes()
        joined = [x for x in new if x not in set(alone)] if alone else new
        for i in range(0, len(joined), 1000):
            part = joined[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([self.sep.join(part) + self.sep], add_special_tokens=False)[0].ids, "<u4")
            self._put(part, ids, np.flatnonzero(ids == self.sep_id), 1)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian uint32."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words are looked up once for all texts, so these should be some megabytes."""
        if not self.apart:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        rows, out = ([], []), [b""] * len(texts)
        for i, text in enumerate(texts):
            low = text.lower()
            # letters may compose with marks in lower case only; the library composes them before
            normal = self.lower and "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) and not any(x in text for x in self.special)
            rows[normal].append((i, low if normal else text))
        for normal, some in enumerate(rows):
            if some:
                for (i, _), x in zip(some, self._of_words([x for _, x in some], bool(normal)), strict=True):
                    out[i] = x
        return out

    def _of_words(self, texts: list[str], normal: bool) -> list[bytes]:
        words, ends = spaced_words(texts)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.table.get, names))
        if new := [i for i, x in enumerate(known) if x is None]:
            if len(self.table) + len(new) > self.limit:
                self.table = {x: y for x, y in zip(names, known) if y is not None}
            self._learn([names[i] for i in new], normal)
            for i in new:
                known[i] = self.table[names[i]]
        at = np.zeros(len(known) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, known), np.int64, len(known)), out=at[1:])
        found = pa.Array.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(at), pa.py_buffer(b"".join(known))]).take(coded.indices)
        cuts = np.frombuffer(found.buffers()[1], np.int64, len(words) + 1)[ends].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip([0, *cuts], cuts)]


def write(df: DataFrame, path: str, encode: Callable[[], Callable], end_id: int, text: str = "text", doc_id: str = "doc_id", many: bool = False) -> None:
    """Writes the ids of every whole text, end_id after each, as blocks in ascending document id.

    encode() is called in each task and gives a function from a text to its ids as little-endian uint32, or with many
    from a list of texts to a list of these.
    A null text counts as empty; null document ids come last; rows that share an id follow one another in
    the order of their ids' checksums, in shards of their own where they are many.
    """
    bounds = np.array(shard_bounds(df, doc_id), np.int64)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), order_key(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        for batch in pieces(batches):
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            rows = [x + end for x in (ids_of(texts) if many else map(ids_of, texts))]
            packed = [_narrow(np.frombuffer(x, "<u4")) for x in rows]
            crc = np.array([zlib.crc32(x) for x in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards_of(bounds, keys, crc), pa.int32()), batch.column(1), batch.column(0), pa.array(crc), pa.array(packed, pa.binary())],
                names=["shard", "k", "doc_id", "crc", "ids"],
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, before, docs, parts = None, 0, 0, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = to_block(docs, [len(x) for x in parts], ids)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([data], pa.binary())], names=["shard", "seq", "before", "n_ids", "n_docs", "block"])

        size = 0
        for batch in pieces(batches):
            for shard, doc, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if docs and (shard != at or size >= BLOCK_IDS):
                    yield block()
                    seq, before, size, docs, parts = seq + 1, before + size, 0, [], []
                if shard != at:
                    at, seq, before = shard, 0, 0
                docs.append(doc)
                parts.append(np.frombuffer(data, "<u2" if data[-1] else "<u4", (len(data) - 1) // (2 if data[-1] else 4)))
                size += len(parts[-1])
        if docs:
            yield block()

    rows = source.mapInArrow(encoded, "shard int, k long, doc_id long, crc long, ids binary")
    rows = rows.repartition(task_shares(df), "shard").sortWithinPartitions("shard", "k", "crc")
    rows.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(path)


def offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard. One row for each shard reaches the driver, at most ``MOST_SHARDS``."""
    totals = spark.read.schema(BLOCKS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    out, before = {}, 0
    for r in sorted(totals):
        out[r.shard] = before
        before += r.n
    return out


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at path: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    bases = offsets(spark, path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for shard, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                docs, lengths, ids = from_block(data)
                ends = np.cumsum(lengths)
                small, cuts = memoryview(ids.astype("<u4")).cast("B"), (4 * ends).tolist()
                columns = [pa.array(docs, pa.int64()), pa.array(bases[shard] + before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(small[i:j]) for i, j in zip([0, *cuts], cuts)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in np.split(ids, ends[:-1])], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.schema(BLOCKS).parquet(path).select("shard", "before", "block").mapInArrow(work, schema)
