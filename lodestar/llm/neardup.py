"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles (all its words, if fewer). A shingle that occurs c times
covers the weights (0, c], cut into (0,1], (1,2], (2,4], (4,8] ...: a Poisson process over each of these
intervals, seeded by shingle and interval, gives points in ascending order, each with a signature component
and a place in the interval; points beyond c are skipped, and the process stops once it is past the
signature's largest component. Components of two signatures are equal with the probability of the weighted
Jaccard similarity. ``BANDS`` bands of ``ROWS`` components make candidates; overlap of the multisets decides.

Links form classes. In a bucket, every member is compared with its smallest one, never all pairs. Where that
leaves a bucket with members of different classes, its members outside the leader's class meet all those of
other classes, in blocks bounded by members and by shingles, and a task passes on as many links as it takes to
join the classes; so members of a bucket that a link connects always share a class. Equal texts are one node throughout. A group with a third of all rows spreads: copies combine
before the shuffle, joins by bucket may be split, and a leader's members are compared in blocks.

Defined results: a null text counts as empty; texts without words are near copies only of equal texts; rows
that share id and text are one node; class_id is the smallest id of the class (null if all are null);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, saved, set_aside, task_shares, words
from lodestar.llm.fingerprints import Shingler, mixed
from lodestar.llm.ordered import order_key

BANDS, ROWS, SIMILAR = 26, 5, 0.8
#: Members that meet a leader in one task; members of either side of a bucket that meet in one task, and
#: their shingles; words whose signatures are made at once.
BLOCK, PART, PART_WORDS, WORDS_AT_ONCE = 2_000, 500, 2_000_000, 400_000


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """A row of m components for each multiset; infinite for an empty one."""
    sig = np.full((len(bags), m), np.inf)
    flat = sig.reshape(-1)
    seeds, docs, width, part = [], [], [], []
    for d, (h, c) in enumerate(bags):
        low, j = 0, 0
        while len(h):
            high = 1 if j == 0 else low * 2
            seeds.append(h + np.uint64((j * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            docs.append(np.full(len(h), d))
            width.append(np.full(len(h), float(high - low)))
            part.append(np.minimum(1.0, (c - low) / (high - low)))
            h, c = h[c > high], c[c > high]
            low, j = high, j + 1
    if not seeds:
        return sig
    seed, doc, rate, part = np.concatenate(seeds), np.concatenate(docs), m * np.concatenate(width), np.concatenate(part)
    x, most, turn = np.zeros(len(seed)), np.full(len(bags), np.inf), 0
    while len(seed):
        turn += 1
        with np.errstate(over="ignore"):
            r = mixed(seed + np.uint64((turn * 0xD1B54A32D192ED03) & ((1 << 64) - 1)))
            s = mixed(r + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log(((r >> np.uint64(11)) + np.uint64(1)).astype(float) / (1 << 53)) / rate
        on = x <= most[doc]
        seed, doc, rate, part, x, s = seed[on], doc[on], rate[on], part[on], x[on], s[on]
        place = (s & np.uint64(0xFFFFFFFF)).astype(float) / (1 << 32)
        hit = place < part
        np.minimum.at(flat, doc[hit] * m + ((s[hit] >> np.uint64(32)) % np.uint64(m)).astype(np.intp), x[hit])
        live = np.unique(doc)
        most[live] = sig[live].max(1)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A number for each band of each row."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.tile(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            out = mixed(out + mixed(bits[:, :, i]) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _node() -> Column:
    """16 bytes of the text's SHA-256: equal texts are one node."""
    return F.substring(F.unhex(F.sha2("text", 256)), 1, 16)


def _signed(rows: DataFrame) -> DataFrame:
    """node, k, doc_id, size (shingles, repeats counted), bands of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in pieces(batches):
            bands, sizes = [], []

            def sign(bags: list) -> None:
                sig = signatures(bags)
                bands.extend(keys if len(bag[0]) else [] for bag, keys in zip(bags, band_keys(sig)))

            bags, size = [], 0
            for text in batch.column(3).to_pylist():
                found = shingler.hashes(words(text))
                bags.append(multiset(found))
                sizes.append(len(found))
                size += len(bags[-1][0])
                if size >= WORDS_AT_ONCE:
                    sign(bags)
                    bags, size = [], 0
            sign(bags)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "k", "doc_id", "size", "bands"])

    return rows.mapInArrow(work, "node binary, k long, doc_id long, size long, bands array<long>")


def _texts(wanted: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text (compressed) of the wanted nodes, from the one document that stands for each."""
    found = rows.join(wanted.join(nodes.select("node", "k"), "node"), ["node", "k"]).select("node", "text")

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(x.encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "text"])

    # rows that share id and text give a node twice
    return saved(found.mapInArrow(pressed, "node binary, text binary").dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough.

    rows: node, k, text of all documents; nodes: node, k of the document that stands for a node. Members come
    to their leader a in blocks; a block's task holds the leader's multiset and streams the members.
    """
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows, nodes)
    sizes = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "leaders")
    # only leaders with several blocks are looked up, so that pairs needn't meet on a hot leader; Spark broadcasts
    # them where they are few, by their size
    members = pairs.join(sizes.where("blocks > 1"), "a", "left").withColumn("block", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int")).select("a", "block", F.col("b").alias("node"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"))
    both = leaders.withColumn("kind", F.lit(0)).unionByName(members.withColumn("kind", F.lit(1))).join(texts, "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, shingler, at, leader = zstandard.ZstdDecompressor(), Shingler(), None, None
        for batch in pieces(batches):
            a, b = [], []
            for first, kind, node, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                bag = multiset(shingler.hashes(words(expand.decompress(text).decode())))
                if not kind:
                    at, leader = first, bag
                elif at == first and similarity(leader, bag) >= least:
                    a.append(first)
                    b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    both = both.repartition(task_shares(rows), "a", "block").sortWithinPartitions("a", "block", "kind")
    return both.select("a", "block", "kind", "node", "text").mapInArrow(compared, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges (a, b) lead to, for every node of an edge.

    Each round maps a node to its smallest neighbour, follows that map twice, and contracts the edges; at
    least half of the nodes that still have edges go, so rounds grow with the logarithm of the nodes.
    """
    edges = saved(edges.where(F.col("a") != F.col("b")), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "up")
        for _ in range(2):
            nxt = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = up.join(nxt, "p").select("a", F.col("q").alias("p"))
        up = saved(up, "up")
        labels = saved(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        left = edges.join(up, "a").select(F.col("p").alias("a"), "b").join(up.select(F.col("a").alias("b"), F.col("p").alias("q")), "b")
        edges = saved(left.select(F.least("a", "q").alias("a"), F.greatest("a", "q").alias("b")).where("a <> b").distinct(), "edges")
    return labels


def _members(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: of each shingle its first, second, ... occurrence."""
    u, c = bag
    if not len(c) or c.max() == 1:
        return u
    number = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        return mixed(np.repeat(u, c) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spanning(bags: list[np.ndarray], labels: list, ask: list[int], least: float) -> list[tuple[int, int]]:
    """Links that join classes: of all similar pairs of different classes with a member in ask, enough to join what they join.

    Overlaps of one member with all others come from postings of its occurrences at once.
    """
    size = np.array([len(x) for x in bags])
    owner = np.repeat(np.arange(len(bags)), size)
    values, place = np.unique(np.concatenate(bags), return_inverse=True)
    order = np.argsort(place, kind="stable")
    posting, ends = owner[order], np.cumsum(np.bincount(place, minlength=len(values)))
    starts = np.append(0, ends[:-1])
    mine = np.split(place, np.cumsum(size)[:-1])
    root = {x: x for x in labels}

    def top(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in ask:
        if not size[i]:
            continue
        both = np.bincount(np.concatenate([posting[starts[e] : ends[e]] for e in mine[i].tolist()]), minlength=len(bags))
        for j in np.flatnonzero(both >= least * (size + size[i] - both)).tolist():
            x, y = top(labels[i]), top(labels[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _across(buckets: DataFrame, labels: DataFrame, rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Further links (a, b) between classes that share a bucket; enough to join the classes that links join.

    In a bucket, members outside the leader's class meet all members of other classes. Both sides come in
    blocks of about PART members or PART_WORDS shingles; only joining links leave a task, at most one for each member of it.
    """
    marked = saved(buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    seen = marked.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("members"), F.min_by("label", "node").alias("main"))
    seen = saved(seen.where("l0 <> l1 AND members > 2").select("bucket", "main"), "mixed")
    marked = marked.join(seen, "bucket").withColumn("outside", F.col("label") != F.col("main"))
    parts_of = lambda side: F.greatest(F.ceil(F.count_if(side) / PART), F.ceil(F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) / PART_WORDS)).cast("int")
    sizes = marked.groupBy("bucket").agg(parts_of(F.col("outside")).alias("outer"), F.greatest(F.lit(1), parts_of(~F.col("outside"))).alias("inner"))
    sizes = saved(sizes, "sizes")
    marked = marked.join(sizes, "bucket").withColumn("h", F.xxhash64("node"))
    i, j = F.pmod("h", F.col("outer")).cast("int"), F.pmod("h", F.col("inner")).cast("int")
    part = lambda x, kind, y: F.struct(x.cast("int").alias("i"), F.lit(kind).alias("kind"), y.cast("int").alias("j"))
    inside = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda x: part(x, 0, j))
    outside = F.concat(F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda y: part(i, 0, y)), F.when(F.col("outer") > 1, F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda x: part(F.least(i, x), 1, F.greatest(i, x)))).otherwise(F.array().cast("array<struct<i:int,kind:int,j:int>>")))
    parts = marked.select("bucket", "node", "label", "outside", F.explode(F.when(F.col("outside"), outside).otherwise(inside)).alias("part")).select("bucket", "part.*", "node", "label", "outside")
    parts = parts.join(_texts(marked.select("node").distinct(), rows, nodes), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, shingler = zstandard.ZstdDecompressor(), Shingler()
        at, nodes, labels, ask, bags = None, [], [], [], []

        def links() -> pa.RecordBatch:
            found = spanning(bags, labels, ask, least)
            a, b = [min(nodes[i], nodes[j]) for i, j in found], [max(nodes[i], nodes[j]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in pieces(batches):
            for *key, node, label, outside, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if nodes:
                        yield links()
                    at, nodes, labels, ask, bags = key, [], [], [], []
                if outside:
                    ask.append(len(nodes))
                nodes.append(node)
                labels.append(label)
                bags.append(_members(multiset(shingler.hashes(words(expand.decompress(text).decode())))))
        if nodes:
            yield links()

    parts = parts.repartition(task_shares(buckets), "bucket", "i", "kind", "j").sortWithinPartitions("bucket", "i", "kind", "j", "node")
    return parts.select("bucket", "i", "kind", "j", "node", "label", "outside", "text").mapInArrow(work, "a binary, b binary").distinct()


def classes(docs: DataFrame, least: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, k, doc_id, label of every row: label is one for all rows of a class of near copies."""
    rows = docs.select(order_key(doc_id).alias("k"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", _node())
    signed = saved(_signed(rows.select("node", "k", "doc_id", "text")), "signed")
    nodes = saved(signed.groupBy("node").agg(F.min("k").alias("k"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    # written, so that the join below reads two plain exchanges and a hot bucket can be split
    shared = saved(buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1").select("bucket", "a"), "shared")
    buckets = saved(buckets.join(shared, "bucket"), "buckets")
    pairs = saved(buckets.where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct(), "pairs")
    texts = rows.select("node", "k", "text")
    links = saved(_verified(pairs, texts, nodes, least), "links")
    labels = components(links)
    more = saved(_across(buckets.select("bucket", "node", "size"), labels, texts, nodes, least), "across")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    return signed.select("node", "k", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def class_ids(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size (rows) of every row."""
    rows = saved(classes(docs, least), "classes")
    # written, so that the join reads two plain exchanges and a class with a third of all rows can be split
    heads = saved(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "heads")
    return rows.join(heads, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of each class the row with the smallest id; same columns. Texts move once, keyed by node and id, one row of each key for each task."""
    docs, restored = set_aside(docs, "doc_id", "text")
    rows = classes(docs, least)
    heads = rows.groupBy("label").agg(F.min(F.struct("k", "node")).alias("h")).select(F.col("h.k").alias("_k"), F.col("h.node").alias("_node"))
    own = docs.select(order_key("doc_id").alias("_k"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("_node"), F.struct(*docs.columns).alias("_row"))
    # repeated rows become one before they move, and the join finds the rest where it is
    own = own.groupBy("_k", "_node").agg(F.first("_row").alias("_row")).join(heads, ["_k", "_node"], "left_semi").select("_row.*")
    return restored(own)
