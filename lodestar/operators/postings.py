"""A persisted inverted index and top-k search over it, for many queries at once.

Documents are dealt to parts by a hash of their id, ``PART`` on average. A row of the index is a term's postings in a
part: its documents in order, what each of them would give a query of weight one, the greatest such gain of every
block of ``BLOCK`` documents, and of all. A search reads the postings of the terms it asks for, and each part answers
blocks of queries by MaxScore: terms are taken from the greatest bound down; once the bounds of what is left can't lift
a new document among the k best, only documents already met go on, and of these those alone whose block's maximum can
still matter are looked up. So a common term is not met by documents times queries, and a document with all terms of
a query is scored exactly.

A group holds the postings of a block's terms in a part, whatever the corpus; parts answer apart, and the best k of
each meet at the end. Documents of equal scores come in the order of their ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of a part on average, postings of a block, queries of a block.
PART, BLOCK, QUERIES = 2_048, 128, 100
#: Fixed values of the ranking: saturation, and what a term in the section or the file's name adds.
K1, SECTION, STEM = 1.2, 0.75, 0.5
#: Room for rounding where scores are compared with bounds, and digits that scores are compared at.
ROOM, DIGITS = 1e-5, 6
IN_SECTION, IN_STEM = 1, 2


def _gain(f: Column, flag: Column) -> Column:
    bonus = F.when(flag.bitwiseAND(IN_SECTION) > 0, SECTION).otherwise(0.0) + F.when(flag.bitwiseAND(IN_STEM) > 0, STEM).otherwise(0.0)
    return F.when(f > 0, f * (K1 + 1) / (f + K1) + bonus).otherwise(0.0)


def build(units: DataFrame, path: str, only: DataFrame | None = None) -> None:
    """Writes the index of units (doc, unit, tokens and, if there are any, section and stem: arrays of tokens) below path.

    A document may have many units, each numbered; frequencies count units with the term in body or section. only:
    a table of the terms to index. Rows repeat no doc and unit.
    """
    total = units.count()
    parts = max(1, total // PART)
    none = F.array().cast("array<string>")
    of = lambda c: F.array_distinct(F.col(c)) if c in units.columns else none
    entry = lambda f, flag: lambda t: F.struct(t.alias("term"), F.lit(f).alias("f"), F.lit(flag).alias("flag"))
    each = units.select("doc", "unit", F.inline(F.concat(F.transform("tokens", entry(1, 0)), F.transform(of("section"), entry(0, IN_SECTION)), F.transform(of("stem"), entry(0, IN_STEM)))))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    each = each.groupBy("doc", "unit", "term").agg(F.sum("f").cast("int").alias("f"), F.bit_or("flag").alias("flag"))
    each = each.where((F.col("f") > 0) | (F.col("flag").bitwiseAND(IN_SECTION) > 0))
    one = each.groupBy("doc", "term").agg(F.sum(_gain(F.col("f").cast("double"), F.col("flag"))).alias("g"), F.array_sort(F.collect_list(F.col("f") * 4 + F.col("flag"))).alias("units"))
    part = F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")
    rows = one.groupBy(part.alias("part"), "term").agg(F.array_sort(F.collect_list(F.struct("doc", "g", "units"))).alias("p"))
    tops = F.transform(F.sequence(F.lit(0), F.floor((F.size("g") - 1) / BLOCK).cast("int")), lambda i: F.array_max(F.slice("g", i * BLOCK + 1, F.lit(BLOCK))))
    rows = rows.select("part", "term", F.col("p.doc").alias("docs"), F.col("p.g").alias("g"), F.col("p.units").alias("units"))
    rows = rows.select("*", F.size(F.flatten("units")).alias("n"), tops.alias("tops"), F.array_max("g").alias("most"))
    rows.write.parquet(f"{path}/postings")
    units.sparkSession.createDataFrame([(json.dumps({"units": total, "parts": parts}),)], "value string").coalesce(1).write.text(f"{path}/about")


class Index:
    """An index that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.units, self.parts = about["units"], about["parts"]
        self.postings = spark.read.parquet(f"{path}/postings")

    def frequencies(self) -> DataFrame:
        """term and df; reads two columns."""
        return self.postings.groupBy("term").agg(F.sum("n").alias("df"))

    def top(self, asked: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
        """query_id, doc, score, rank of the k best documents of each query; asked: query_id and term, each pair once.

        digits: what each term's part of a unit's score is rounded to before the sum.
        """
        weights = asked.join(self.frequencies().join(asked.select("term").distinct(), "term", "left_semi"), "term")
        weight = F.ln(1 + (F.lit(float(max(1, self.units))) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        # a term's queries in a block: QUERIES on average
        wanted = weights.groupBy(block.alias("block"), "term").agg(F.collect_list(F.struct(F.col("query_id").cast("string").alias("q"), weight.alias("w"))).alias("queries"))
        hits = self.postings.join(wanted, "term").select("part", "block", "docs", "g", "units", "tops", "most", "queries")
        doc = self.postings.schema["docs"].dataType.elementType.simpleString()
        best = hits.groupBy("part", "block").applyInPandas(_scorer(k, digits), f"q string, doc {doc}, score double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        kind = asked.schema["query_id"].dataType
        return best.select(F.col("q").cast(kind).alias("query_id"), "doc", "score", "rank")


class Term:
    """A term's postings in a part, with documents as numbers in the order of the part's documents."""

    def __init__(self, at: np.ndarray, g: np.ndarray, units: list, tops: np.ndarray, most: float):
        self.at, self.g, self.tops, self.most = at, np.asarray(g, float), np.asarray(tops, float), float(most)
        self.units = units

    def parts(self, where: np.ndarray, weight: float, digits: int | None) -> np.ndarray:
        """What each document at these places gets, unit by unit; the units of others are not touched."""
        if not len(where):
            return np.zeros(0)
        held = [np.asarray(self.units[i], np.int64) for i in where]
        codes, first = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
        f, flag = codes // 4, codes % 4
        value = np.where(f > 0, weight * f * (K1 + 1) / (f + K1) + weight * ((flag & IN_SECTION > 0) * SECTION + (flag & IN_STEM > 0) * STEM), 0.0)
        value = value if digits is None else np.round(value, digits)
        return np.add.reduceat(value, first)


def _found(at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the documents stand, and which of them are there."""
    place = np.minimum(np.searchsorted(at, docs), len(at) - 1)
    return place, at[place] == docs


def best(terms: list[tuple[float, Term]], n: int, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best of n documents, by MaxScore with block maxima."""
    terms = sorted(terms, key=lambda t: -t[0] * t[1].most)
    rest = np.concatenate([np.cumsum([w * t.most for w, t in terms][::-1])[::-1], [0.0]])
    acc, least, i = np.zeros(n), 0.0, 0

    def kth(values: np.ndarray) -> float:
        return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0

    while i < len(terms) and not (least > 0 and rest[i] + ROOM < least):
        w, t = terms[i]
        acc[t.at] += w * t.g
        i += 1
        least = kth(acc)
    alive = np.flatnonzero(acc > 0)
    while i < len(terms) and len(alive):
        alive = alive[acc[alive] + rest[i] + ROOM >= least]
        w, t = terms[i]
        place, there = _found(t.at, alive)
        # the block's maximum rules out most of those that are there
        look = there & (acc[alive] + w * t.tops[place // BLOCK] + rest[i + 1] + ROOM >= least)
        alive, place, there = (x[look | ~there] for x in (alive, place, there))
        acc[alive[there]] += w * t.g[place[there]]
        i += 1
        least = max(least, kth(acc[alive]))
    alive = alive[acc[alive] + ROOM >= kth(acc[alive])]
    score = np.zeros(len(alive))
    for w, t in terms:
        place, there = _found(t.at, alive)
        score[there] += t.parts(place[there], w, digits)
    score = np.round(score, DIGITS)
    order = np.lexsort((alive, -score))[:k]
    order = order[score[order] > 0]
    return alive[order], score[order]


def _scorer(k: int, digits: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        docs = np.unique(np.concatenate([np.asarray(d) for d in rows["docs"]]))
        queries: dict[str, list[tuple[float, Term]]] = {}
        for r in rows.itertuples():
            term = Term(np.searchsorted(docs, np.asarray(r.docs)), r.g, list(r.units), r.tops, r.most)
            for q in r.queries:
                queries.setdefault(q["q"], []).append((q["w"], term))
        out: tuple[list, list, list] = ([], [], [])
        for q, terms in queries.items():
            at, scores = best(terms, len(docs), k, digits)
            out[0].extend([q] * len(at))
            out[1].extend(docs[at].tolist())
            out[2].extend(scores.tolist())
        return pd.DataFrame({"q": np.array(out[0], object), "doc": np.array(out[1], docs.dtype), "score": np.array(out[2], float)})

    return score
