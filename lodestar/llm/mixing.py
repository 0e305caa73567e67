"""Mixing sources to target weights by pivotal dependent rounding.

Every document is to be copied target / size of its source times on average: a whole part and a fraction.
Fractions of a source meet in pairs; of a pair, words move from one to the other, in a randomly chosen
direction with odds that keep each expectation, until one of the two fractions is 0 or 1. What is left goes
on to the next pair. Each leaf of a reduction tree leaves at most one fraction for each source; leaves of
a level combine in groups of ``FAN`` on the next, down to one leaf, where the last fraction is rounded. So a
source's words miss its target by at most half of one document's size. A leaf takes its documents from large
to small: neighbours of like size settle each other quickly, so the one that is left is mostly a small one.

Leaves are chosen by a hash of the document, never by partition, so reruns and retries agree and a source
with a third of all rows spreads over many leaves. Only ids and sizes move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import saved, set_aside, task_shares

#: Documents of a leaf of the tree on average, and leaves that combine on the next level.
LEAF, FAN = 2_000, 256
#: Copies of a row that one task makes.
AT_ONCE = 1_000
#: Fixed values of the contract: weights of the sources in order, share of all words, most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def words_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target: share of all words dealt by weight, none above most times its size.

    A row for each source, so the windows below sort as many rows as there are sources. Sources that stop at
    their limit come first by limit per weight; each adds its rest to what the others share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(most)).withColumn("reach", F.col("limit") / F.col("w"))
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = F.try_divide(left, F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy("reach", F.col("source").asc_nulls_last())))
    level = F.min_by(F.col("per"), F.when(F.col("per") < F.col("reach"), F.col("place"))).over(everything)
    out = ranked.withColumn("per", per).withColumn("level", level)
    return out.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(sizes: list[float], fractions: list[float], draws: list[float]) -> tuple[list[float], int]:
    """Fractions after all pairs of a leaf met, and the position of the one that is left (-1: none).

    The sum of size times fraction stays as it is.
    """
    out, held = list(fractions), -1
    for i, (n, u) in enumerate(zip(sizes, draws)):
        if not 0 < out[i] < 1:
            continue
        if n <= 0:
            out[i] = float(u < out[i])
            continue
        if held < 0:
            held = i
            continue
        m, a, b = sizes[held], out[held], out[i]
        up, down = min(m * (1 - a), n * b), min(m * a, n * (1 - b))
        if u * (up + down) < down:  # words go to the one held
            a, b = (1.0, b - up / n) if up == m * (1 - a) else (a + up / m, 0.0)
        else:
            a, b = (0.0, b + down / n) if down == m * a else (a - down / m, 1.0)
        a, b = (min(1.0, max(0.0, x)) for x in (a, b))
        out[held], out[i] = a, b
        if not 0 < a < 1:
            held = i if 0 < b < 1 else -1
    return out, held


def _level(df: DataFrame, level: int, seed: int) -> DataFrame:
    """key, source, size, h, p, leaves -> p after the pairs of each leaf met, and open where a fraction is left.

    A source has a tree of its own: leaves says how many of its leaves this level has.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(part):
                continue
            # the last group may go on in the next batch
            last = part.iloc[-1]
            goes_on = (part.leaf == last.leaf) & ((part.source == last.source) | (part.source.isna() & pd.isna(last.source)))
            rest = part[goes_on]
            if len(done := part[~goes_on]):
                yield met(done)
        if rest is not None and len(rest):
            yield met(rest)

    def met(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        u = _uniform(part.h.to_numpy(np.int64), seed * 64 + level)
        p, left = part.p.to_numpy(float).copy(), np.zeros(len(part), bool)
        size, single = part["size"].to_numpy(float), part.leaves.to_numpy() == 1
        changes = (part.leaf.to_numpy()[1:] != part.leaf.to_numpy()[:-1]) | (part.source.fillna("").to_numpy()[1:] != part.source.fillna("").to_numpy()[:-1]) | (part.source.isna().to_numpy()[1:] != part.source.isna().to_numpy()[:-1])
        for rows in np.split(np.arange(len(part)), np.flatnonzero(changes) + 1):
            out, held = pivot(size[rows].tolist(), p[rows].tolist(), u[rows].tolist())
            p[rows] = out
            if held >= 0 and not single[rows[held]]:
                left[rows[held]] = True
            elif held >= 0:
                p[rows[held]] = float(out[held] >= 0.5)
        return part.assign(p=p, open=left)[["key", "source", "size", "h", "p", "leaves", "open"]]

    dealt = df.withColumn("leaf", F.pmod(F.shiftrightunsigned("h", 8), F.col("leaves")))
    dealt = dealt.repartition(task_shares(df), "source", "leaf").sortWithinPartitions("source", "leaf", F.desc("size"), "h", "key")
    return dealt.select("key", "source", "size", "h", "p", "leaves", "leaf").mapInPandas(work, "key string, source string, size long, h long, p double, leaves long, open boolean")


def _key(doc_id: str, *more: str | Column) -> Column:
    """One text for rows that agree in these columns: the id, and 96 bits for all others."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(F.xxhash64(*more)), F.hex(F.hash(*more)))


def copies(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, key: str | None = None) -> DataFrame:
    """_key, doc_id, source, size, source_size, target, n_copies: how often the mix takes each row.

    Rows with the same id, source and text (or the same value of the column key) are told apart by their number
    among them, so each is drawn by itself. A null text has 0 words; words-less documents are drawn like others and take nothing. Null ids
    and a null source are values like others. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text)).alias("h0"), (_key(doc_id, source, text) if key is None else F.col(key)).alias("k0"), F.spark_partition_id().alias("part"))
    # equal rows are numbered: those of a part of the table by themselves, after those of the parts before it, so a
    # key with a third of all rows is never in one task and has the same numbers however the table is cut
    rows = saved(rows, "mix-read")
    parts = rows.groupBy("k0", "part").agg(F.count("*").alias("c"))
    parts = parts.select("k0", "part", (F.sum("c").over(Window.partitionBy("k0").orderBy("part")) - F.col("c")).alias("before"))
    rows = rows.join(parts, ["k0", "part"]).withColumn("same", F.col("before") + F.row_number().over(Window.partitionBy("k0", "part").orderBy("size")))
    rows = rows.select("doc_id", "source", "size", "k0", F.concat_ws("#", "k0", "same").alias("key"), F.xxhash64("h0", "same").alias("h"))
    rows = saved(rows, "mix-rows")
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    goal = targets(sizes.drop("n"), weights, share, most).withColumnRenamed("source", "s").drop("source_size")
    goal = saved(sizes.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", F.ceil(F.col("n") / LEAF).alias("leaves")), "mix-targets")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(mean)).withColumn("p", mean - F.floor(mean))
    most_leaves, level, decided = goal.agg(F.max("leaves")).first()[0] or 1, 0, None
    state = rows.select("key", "source", "size", "h", "p", "leaves")
    while True:
        state = saved(_level(state, level, seed), f"mix-{level}")
        settled = state.where(~F.col("open")).select("key", "p")
        decided = settled if decided is None else decided.unionAll(settled)
        if most_leaves == 1:
            break
        state = state.where("open").drop("open").withColumn("leaves", F.ceil(F.col("leaves") / FAN))
        most_leaves, level = -(-most_leaves // FAN), level + 1
    out = rows.select("key", "k0", "doc_id", "source", "size", "source_size", "target", "whole").join(decided, "key")
    return out.select(F.col("k0").alias("_key"), "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p")).cast("int").alias("n_copies"))


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """docs with every row as often as the mix takes it; same columns.

    Rows that agree in all columns are one, with the sum of their copies, before texts move; more than ``AT_ONCE``
    copies of one are made by several tasks.
    """
    docs, restored = set_aside(docs, "doc_id", "text", "source")
    plain = lambda f: F.to_json(F.struct(f.name)) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f.name)
    docs = docs.withColumn("_k0", _key("doc_id", *(plain(f) for f in docs.schema.fields if f.name != "doc_id")))
    taken = copies(docs, seed, key="_k0", **how).groupBy(F.col("_key").alias("_k0")).agg(F.sum("n_copies").alias("_n"), F.count("*").alias("_rows"))
    taken = saved(taken, "mix-taken")
    most, rows = taken.agg(F.max("_n"), F.max("_rows")).first()
    if (rows or 0) > 1:
        names = docs.columns
        docs = docs.groupBy("_k0").agg(F.first(F.struct(*[x for x in names if x != "_k0"])).alias("r")).select("_k0", "r.*")
    out = docs.join(taken.where("_n > 0").select("_k0", "_n"), "_k0")
    if (most or 0) > AT_ONCE:
        chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / AT_ONCE))).alias("_chunk")
        out = out.select("*", chunk).withColumn("_n", F.least(F.lit(AT_ONCE), F.col("_n") - F.col("_chunk") * AT_ONCE))
        out = out.repartition(task_shares(docs), "_k0", "_chunk")
    return restored(out.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))))
