"""Trie of conversation prefixes, as succinct level-order tries in shards.

Each conversation is a sequence of turns (role, text), ordered by turn; it may first be rebuilt on the first turns of
another one (:func:`rebuilt`). A node is a distinct sequence of first turns, its members are the conversations that
start with it. Texts leave at once: a turn is a 16-byte digest and a number of words, and a prefix is the exclusive or
of its turns' digests hashed with their places, twice 64 bits.

1. Equal sequences combine: conversations that end at a node become one sequence with their number, smallest id
   and the digest of their ids (joined in blocks of ids first, so a common sequence is many short rows).
2. Nodes that more than ``MOST`` distinct sequences pass are heavy; they are the upper levels, at most a
   ``MOST``-th of all rows. Every sequence leaves them at one light node, the root of its part of the trie. Nodes that
   more than the square (cube, ...) of ``MOST`` pass are the next upper level, and so on: a part of each level has a
   root of its own and at most ``MOST`` nodes of each depth.
3. Light parts go to tasks by their root, whole and bounded, some at a time. Numpy lays each lot out level by level
   as a LOUDS bit vector with its label arrays; parents come from rank and select on it, and the rollups from
   ``add.at`` over levels from the last to the first.
4. The heavy levels merge apart, one after the other: sums over the roots below by their heavy parent, then the same
   tries over the level's nodes, part by part.

A conversation is one path, and its turns are numbered in one task (as a stream that can spill).

Defined results: rows without conv_id take no part; a null turn comes first, a null role or text is empty; rows of one
conversation with the same turn count each and come in the order of their turns' digests, so repeated rows are turns of
their own; an empty table has no nodes, any other has a root; texts may be of any length (a task holds one row's at a
time); ids are whole numbers (text that isn't one fails the job); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import saved, spread

#: Fixed values of the contract: conversations follow the one whose id is a multiple of FAMILY, for up to LENT - 1 turns.
FAMILY, LENT = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct sequences that a light part has at most; rows that numpy lays out at a time (and the rest of a part).
MOST, LOT = 64, 40_000
#: Ids of one block of a node's members are those that agree above so many bits.
BLOCK_BITS = 7
#: Heavy nodes that are sent to all tasks; more of them are joined.
AT_HAND = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long, q1 long, q2 long, top boolean"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ROW = "conv_id long, depth int, p1 long, p2 long, q1 long, q2 long, words int, last boolean"


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, i (from 1), label and words of each turn."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), label.alias("label"), F.regexp_count(text_, F.lit(WORD)).cast("int").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "label")
    return rows.where("conv_id IS NOT NULL").withColumn("i", F.row_number().over(order)).select("conv_id", "i", "label", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, label and words of rebuilt conversations, and conv_id of those without turns.

    A conversation takes its first h turns, or as many as there are, from the one at the start of its family; its own
    follow after its first h, where h is the CRC-32 of its id as text, modulo ``LENT``.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    firsts = turns.where((F.col("i") < LENT) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "i", "label", "words")
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("n")).withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % LENT).cast("int"))
    convs = sizes.join(firsts.groupBy("base").agg(F.max("i").alias("there")), "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "base", "n", "h", "m")
    given = convs.where("m > 0").join(firsts, "base").where("i <= m").select("conv_id", F.col("i").alias("depth"), "label", "words")
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("i > h").select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "label", "words")
    return given.unionByName(own), convs.where("m = 0 AND n <= h").select("conv_id")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Each turn's row with the codes of its prefix (p1, p2) and of the one before (q1, q2); ``last`` marks ends."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    code = lambda *x: F.bit_xor(F.xxhash64(*x)).over(run)
    rows = sequences.withColumn("p1", code("label", "depth")).withColumn("p2", code("depth", "label", F.lit(1)))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0).cast("long"))
    last = F.lead("depth").over(order).isNull()
    return rows.select("conv_id", F.col("depth").cast("int").alias("depth"), "p1", "p2", before("p1").alias("q1"), before("p2").alias("q2"), "words", last.alias("last"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each end, from blocks of its members' ids in ascending order."""
    key, state, n, least = None, None, 0, None
    for batch in batches:
        done: list[tuple] = []
        for *at, _, ids, k, low in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if key is not None:
                    done.append((*key, n, least, state.hexdigest()))
                key, state, n, least = at, hashlib.sha256(ids.encode()), 0, low
            else:
                state.update(b"," + ids.encode())
            n += k
        if done:
            yield _end_rows(done)
    if key is not None:
        yield _end_rows([(*key, n, least, state.hexdigest())])


ENDS = "depth int, p1 long, p2 long, n_ends long, conv_id long, ends string"


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ENDS.split(", ")])


def ends(last: DataFrame) -> DataFrame:
    """For each node where conversations end: their number, smallest id, and the SHA-256 of their ids in ascending order."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    ids = F.array_sort(F.collect_list("conv_id"))
    blocks = last.groupBy("depth", "p1", "p2", block.alias("block")).agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return blocks.repartition("p1", "p2").sortWithinPartitions("depth", "p1", "p2", "block").mapInArrow(_ends, ENDS)


class Louds:
    """A forest in level order: bits, and the label arrays of its nodes.

    Bits start with the degree of a root above all roots, then come the degrees of the nodes, each as ones and
    a zero. So the i-th one stands for node i, and the zeros before it count the nodes before its parent.
    """

    def __init__(self, level: np.ndarray, parent: np.ndarray):
        """level and parent (-1: none) of nodes in any order; ``order`` puts them in level order."""
        levels = np.argsort(level, kind="stable")
        self.starts = np.append(np.searchsorted(level[levels], np.arange(level.max() + 1 if len(level) else 0)), len(level))
        rank = np.empty(len(level), np.int64)
        for a, b in zip(self.starts, self.starts[1:]):
            nodes = levels[a:b]
            if a:
                nodes = nodes[np.argsort(rank[parent[nodes]], kind="stable")]
            levels[a:b] = nodes
            rank[nodes] = np.arange(a, b)
        self.order = levels
        up = np.where(parent[levels] < 0, 0, rank[parent[levels]] + 1)
        degree = np.bincount(up, minlength=len(level) + 1)
        self.bits = np.ones(len(level) * 2 + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    @property
    def parents(self) -> np.ndarray:
        """The parent of each node in level order, -1 for roots: the zeros before its one, less one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    @property
    def degrees(self) -> np.ndarray:
        """The ones between a node's zero and the zero before."""
        return np.diff(np.flatnonzero(~self.bits)) - 1


def rollups(trie: Louds, n: np.ndarray, least: np.ndarray, words: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved_: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over subtrees. The arrays, in level order, hold what a node has besides its subtree in this trie."""
    up, degree = trie.parents, trie.degrees
    children = children + degree
    leaves = leaves + (children == 0)
    n, least, leaves, saved_ = n.copy(), least.copy(), leaves.copy(), saved_.copy()
    for a, b in zip(trie.starts[-2::-1], trie.starts[:0:-1]):
        saved_[a:b] += (n[a:b] - 1) * words[a:b]
        if a:
            np.add.at(n, up[a:b], n[a:b])
            np.minimum.at(least, up[a:b], least[a:b])
            np.add.at(leaves, up[a:b], leaves[a:b])
            np.add.at(saved_, up[a:b], saved_[a:b])
    return {"conv_id": least, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved_}


def _codes(*columns: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays(columns, names=[f"f{i}" for i in range(len(columns))])


def _trie(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of whole light parts. Rows: ROW with n_ends and ends of the sequence, and the part's root (r1, r2)."""
    root = (rows["p1"] == rows["r1"]) & (rows["p2"] == rows["r2"])
    first = rows["depth"].where(root).groupby([rows["r1"], rows["r2"]]).transform("min").to_numpy()
    level = rows["depth"].to_numpy() - first.astype(np.int64)
    keys = _codes(level, rows["p1"].to_numpy(), rows["p2"].to_numpy())
    nodes, one, node = np.unique(keys, return_index=True, return_inverse=True)
    above = _codes(nodes["f0"] - 1, rows["q1"].to_numpy()[one], rows["q2"].to_numpy()[one])
    parent = np.where(nodes["f0"] == 0, -1, np.minimum(np.searchsorted(nodes, above), len(nodes) - 1))
    trie = Louds(nodes["f0"].astype(np.int64), parent)
    n, least = np.zeros(len(nodes), np.int64), np.full(len(nodes), np.iinfo(np.int64).max)
    end = rows["last"].to_numpy(bool)
    n[node[end]] = rows["n_ends"].to_numpy(np.int64)[end]
    np.minimum.at(least, node, rows["conv_id"].to_numpy())
    digests = np.full(len(nodes), NOTHING, object)
    digests[node[end]] = rows["ends"].to_numpy()[end]
    o, zero = trie.order, np.zeros(len(nodes), np.int64)
    out = pd.DataFrame(rollups(trie, n[o], least[o], rows["words"].to_numpy(np.int64)[one][o], zero, zero, zero))
    up = trie.parents
    top = up < 0
    out["parent_conv_id"] = pd.array(np.where(top, 0, out["conv_id"].to_numpy()[np.maximum(up, 0)]), "Int64")
    out.loc[top, "parent_conv_id"] = pd.NA
    out["depth"], out["ends_sha256"], out["top"] = rows["depth"].to_numpy(np.int64)[one][o], digests[o], top
    for c in ("p1", "p2", "q1", "q2"):
        out[c] = rows[c].to_numpy()[one][o]
    return out


def _as_batch(out: pd.DataFrame) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in NODES.split(", ")]
    return pa.RecordBatch.from_pandas(out[[n for n, _ in fields]], pa.schema([(n, kinds[k]) for n, k in fields]), preserve_index=False)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lots of whole parts, from rows in the order of their roots."""
    held: list[pa.RecordBatch] = []
    count, fresh = 0, 0
    for batch in batches:
        held.append(batch)
        count, fresh = count + batch.num_rows, fresh + batch.num_rows
        if fresh < LOT:
            continue
        table = pa.Table.from_batches(held)
        r1, r2 = table["r1"].to_numpy(), table["r2"].to_numpy()
        other = np.flatnonzero((r1 != r1[-1]) | (r2 != r2[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield _as_batch(_trie(table.slice(0, cut).to_pandas()))
        held, count, fresh = table.slice(cut).combine_chunks().to_batches(), count - cut, 0
    if count:
        yield _as_batch(_trie(pa.Table.from_batches(held).to_pandas()))


def _upper(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a part of heavy nodes, with the sums of what hangs below them."""
    rows = rows.sort_values(["depth", "p1", "p2"], ignore_index=True)
    number = {k: i for i, k in enumerate(zip(rows["depth"], rows["p1"], rows["p2"]))}
    parent = np.array([number.get((d - 1, a, b), -1) for d, a, b in zip(rows["depth"], rows["q1"], rows["q2"])])
    trie = Louds(rows["depth"].to_numpy(np.int64) - int(rows["depth"].iloc[0]), parent)
    at = rows.iloc[trie.order]
    whole = lambda c: at[c].to_numpy(np.int64)
    out = pd.DataFrame(rollups(trie, whole("n"), whole("least"), whole("words"), whole("children"), whole("leaves"), whole("saved")))
    up, ids = trie.parents, out["conv_id"].to_numpy()
    out["parent_conv_id"] = pd.array([None if p < 0 else int(ids[p]) for p in up], "Int64")
    out["depth"], out["ends_sha256"], out["top"] = whole("depth"), at["ends"].to_numpy(), (up < 0) & (whole("depth") > 0)
    for c in ("p1", "p2", "q1", "q2"):
        out[c] = whole(c)
    return out[out["n_convs"] > 0]


def nodes(turns: DataFrame, none: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, depth, label, words) and of conversations without turns (conv_id)."""
    paths = saved(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    last = paths.where("last").select("depth", "p1", "p2", "conv_id").unionByName(none.select(F.lit(0).alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    stops = saved(ends(last), "ends")
    # a sequence's rows are those of its smallest conversation; every row but the last one of the others goes here
    one = saved(paths.join(stops.where("depth > 0").select("conv_id", "n_ends", "ends"), "conv_id"), "sequences")
    key = ["depth", "p1", "p2"]
    passing = one.groupBy(*key, "q1", "q2", "words").agg(F.count("*").alias("passing")).where(F.col("passing") > MOST)
    level = sum((F.col("passing") > min(MOST**k, (1 << 63) - 1)).cast("int") for k in range(1, 8))
    heavy = saved(passing.select(*key, level.alias("level")), "heavy")
    count, levels = heavy.agg(F.count("*"), F.max("level")).first()
    near = F.broadcast if count <= AT_HAND else lambda df: df
    order = Window.partitionBy("conv_id").orderBy("depth")
    light = one.join(near(heavy), key, "left_anti").withColumn("r1", F.first("p1").over(order)).withColumn("r2", F.first("p2").over(order))
    light = light.withColumn("ends", F.when(F.col("last"), F.col("ends")))
    done = [saved(light.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "conv_id", "depth").mapInArrow(_parts, NODES), "parts")]
    order = Window.partitionBy("conv_id", "level").orderBy("depth")
    above = one.join(near(heavy), key).withColumn("r1", F.first("p1").over(order)).withColumn("r2", F.first("p2").over(order))
    above = saved(above.select(*key, "q1", "q2", "words", "level", "r1", "r2").distinct(), "above") if levels else None
    root = heavy.sparkSession.range(1).select(F.lit(0).alias("depth"), *(zero.alias(c) for c in ("p1", "p2", "q1", "q2")), F.lit(0).alias("words"), zero.alias("r1"), zero.alias("r2"))
    for k in range(1, (levels or 0) + 2):
        rows = above.where(F.col("level") == k).drop("level") if k <= (levels or 0) else root
        done.append(saved(_on_top(rows, done, stops).groupBy("r1", "r2").applyInPandas(_upper, NODES), f"upper-{k}"))
    parents = None
    for df in done[1:]:
        df = df.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up"))
        parents = df if parents is None else parents.unionByName(df)
    out = None
    for df in done:
        tops = df.where("top").join(near(parents), ["depth", "q1", "q2"]).withColumn("parent_conv_id", F.col("up"))
        df = df.where("NOT top").select(*COLUMNS).unionByName(tops.select(*COLUMNS))
        out = df if out is None else out.unionByName(df)
    return out


def _on_top(rows: DataFrame, done: list[DataFrame], stops: DataFrame) -> DataFrame:
    """Heavy nodes with the sums over the roots of lower levels right below them, and what ends at them."""
    key, zero, far = ["depth", "p1", "p2"], F.lit(0).cast("long"), F.lit((1 << 63) - 1)
    tops = None
    for df in done:
        df = df.where("top")
        tops = df if tops is None else tops.unionByName(df)
    below = tops.groupBy((F.col("depth") - 1).cast("int").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    below = below.agg(F.sum("n_convs").alias("n"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.min("conv_id").alias("least"))
    of = lambda c: F.coalesce(F.col(c), zero)
    rows = rows.join(below, key, "left").join(stops.select(*key, F.col("conv_id").alias("end_id"), "n_ends", "ends"), key, "left")
    least = F.least(F.coalesce("least", far), F.coalesce("end_id", far))
    return rows.select(*key, "q1", "q2", "words", "r1", "r2", (of("n") + of("n_ends")).alias("n"), least.alias("least"), of("children").alias("children"), of("leaves").alias("leaves"), of("saved").alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of rebuilt conversations: ids and sums as in ``COLUMNS``."""
    turns = saved(numbered(spread(conversations)), "turns")
    return nodes(*rebuilt(turns))
