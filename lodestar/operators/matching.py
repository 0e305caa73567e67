"""Cross-source duplicates: exact, probable, possible or none.

An exact match is an "or" of equalities with vetoes that a null lifts. Each record gets a few tokens for either
side of a pair, such that a pair matches if and only if its sides share one. So the smallest match of every record
comes from the two smallest ids of each token: no pair is ever made, and a template address on a third of all rows
costs no more than others. Review matches work alike: titles of a programme meet as distinct sets of words (by the
rarest words that a Jaccard similarity of 0.8 must share, a prefix filter), and records behind them by tokens again,
one for each combination of missing values that the other side has.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import casefold, normal_url, plain_text, plain_words

#: Title words that don't count, and the least title similarity.
TITLE_STOP_WORDS = "a ao aos as da das de do dos e em na nas no nos o os para por com sem um uma uns umas".split()
SIMILAR = 0.8
COLUMNS = ("id", "source_id", "canonical_url", "topic_id", "call_id", "programme", "title", "authority", "deadline", "opening_date", "source_family", "canonical_source")


def prepared(df: DataFrame) -> DataFrame:
    """What matching compares, computed once for each record."""
    words = F.array_distinct(F.filter(plain_words(F.col("title")), lambda w: ~w.isin(*TITLE_STOP_WORDS)))
    empty = F.array().cast("array<string>")
    return df.select(
        "id", "source_id", "deadline", "opening_date", "source_family", "canonical_source",
        normal_url(F.col("canonical_url")).alias("url"),
        F.coalesce(F.contains(casefold(F.col("canonical_url")), F.lit("/topic-details/")), F.lit(False)).alias("topic_url"),
        F.when(F.col("topic_id") != "", plain_text(F.col("topic_id"))).alias("topic"),
        F.when(F.col("call_id") != "", plain_text(F.col("call_id"))).alias("call"),
        F.when(F.col("programme").isNotNull(), plain_text(F.col("programme"))).alias("programme"),
        F.when(F.col("authority").isNotNull(), plain_text(F.col("authority"))).alias("authority"),
        F.when(F.col("title").isNotNull(), words).otherwise(empty).alias("words"),
    )


def _either_null(name: str, side: str) -> Column:
    """Tokens that two sides share if they agree in a column or one of them lacks it; side: a or b."""
    c, text = F.col(name), F.col(name).cast("string")
    if side == "a":
        return F.when(c.isNull(), F.array(F.lit("a0"))).otherwise(F.array(F.concat(F.lit("="), text), F.lit("b0")))
    return F.when(c.isNull(), F.array(F.lit("b0"), F.lit("a0"))).otherwise(F.array(F.concat(F.lit("="), text), F.lit("a0")))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def _strong_tokens(side: str) -> Column:
    """Tokens of exact matches: the same address with topics and calls that don't differ, or the same topic."""
    none = F.array().cast("array<string>")
    lacks = F.when(F.col("topic").isNull(), F.array(F.lit("a0")) if side == "a" else F.array(F.lit("b0"), F.lit("a0"))).otherwise(F.array(F.lit("b0" if side == "a" else "a0")))
    by_both = F.when(F.col("url").isNotNull() & F.col("topic").isNotNull(), F.array(_joined(F.lit("ut"), F.col("url"), F.col("topic")))).otherwise(none)
    by_url = F.when(F.col("url").isNotNull(), F.flatten(F.transform(lacks, lambda t: F.transform(_either_null("call", side), lambda c: _joined(F.lit("u"), F.col("url"), t, c))))).otherwise(none)
    own, other = ("n", "bn") if side == "a" else ("bn", "n")
    page = F.when(F.col("topic_url"), F.array(F.concat(F.lit("u"), F.col("url")), F.lit(other))).otherwise(F.array(F.lit(own)) if side == "a" else F.array(F.lit("bn"), F.lit("n")))
    by_topic = F.when(F.col("topic").isNotNull(), F.transform(page, lambda p: _joined(F.lit("t"), F.col("topic"), p))).otherwise(none)
    return F.array_distinct(F.concat(by_both, by_url, by_topic))


def _two_least(rows: DataFrame, *by: str) -> DataFrame:
    """Columns by and ids: the two smallest ids of each; the limit holds before the shuffle too."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    return rows.select(*by, "id").distinct().withColumn("n", n).where(F.col("n") <= 2).groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def smallest_match(new: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, existing: of each prepared() record with exact matches among known the smallest id but its own."""
    held = _two_least(known.select("id", F.explode(_strong_tokens("b")).alias("token")), "token")
    asked = new.select(F.col("id").alias("candidate"), F.explode(_strong_tokens("a")).alias("token")).join(held, "token")
    other = F.try_element_at(F.filter("ids", lambda i: i != F.col("candidate")), F.lit(1))
    return asked.groupBy("candidate").agg(F.min(other).alias("existing")).where(F.col("existing").isNotNull())


def strong_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, existing, matched_by of the smallest exact match of each record that has one."""
    own = new.select(F.col("id").alias("candidate"), F.col("url").alias("u"), F.col("topic").alias("t"))
    other = known.select(F.col("id").alias("existing"), "url", "topic")
    both = smallest_match(new, known).join(own, "candidate").join(other, "existing")
    by = F.array_compact(F.array(F.when(F.col("u") == F.col("url"), "canonical_url"), F.when(F.col("t") == F.col("topic"), "topic_id")))
    return both.select("candidate", "existing", by.alias("matched_by"))


def _similar_titles(new: DataFrame, known: DataFrame) -> DataFrame:
    """programme, wa, wb: word sets of titles of a programme that are similar; equal ones too."""
    sets = lambda df: df.where(F.col("programme").isNotNull() & (F.size("words") > 0)).select("programme", F.array_sort("words").alias("words")).distinct()
    a, b = sets(new), sets(known)
    rank = a.union(b).distinct().select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))

    def rare(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("programme", "words").orderBy("df", "word"))
        each = df.select("programme", "words", F.explode("words").alias("word")).join(rank, "word").withColumn("place", place)
        return each.where(F.col("place") <= F.size("words") - F.ceil(F.size("words") * SIMILAR) + 1).select("programme", "words", "word")

    near = F.size("wa").between(F.ceil(F.size("wb") * SIMILAR), F.floor(F.size("wb") / SIMILAR))
    pairs = rare(a).withColumnRenamed("words", "wa").join(rare(b).withColumnRenamed("words", "wb"), ["programme", "word"]).where(near).select("programme", "wa", "wb").distinct()
    return pairs.where(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")) >= SIMILAR)


#: What differing values veto in a review match, unless a side lacks one; page: the address of a topic's page.
_VETOES = ("page", "topic", "deadline", "opening_date", "call")
#: What else review matches look at; records that agree in all of both are one profile.
_PROFILE = (*_VETOES, "programme", "title_key", "authority", "source_family", "source_id", "canonical_source")


def _reviewed(df: DataFrame) -> DataFrame:
    """prepared() records that can have review matches, with their profile and the mask of the vetoes they have."""
    out = df.where(F.col("programme").isNotNull() & (F.size("words") > 0)).withColumn("title_key", F.md5(F.array_join(F.array_sort("words"), " ")))
    out = out.withColumn("page", F.when(F.col("topic_url"), F.col("url")))
    mask = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(_VETOES)), F.lit(0))
    profile = F.md5(_joined(*[F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\x1e"))) for c in _PROFILE]))
    return out.select("id", *_PROFILE, mask.alias("mask"), profile.alias("profile"))


def _review_tokens(side: str, masks: list[int]) -> Column:
    """Structs of kind and token that a pair shares if and only if it is related or of one authority, and no veto holds.

    masks: those of the other side. A token names what both sides have, the mask of side b, and the values there;
    title is the title of side b.
    """
    pair = lambda kind, *c: F.when(F.concat(*map(F.col, c)).isNotNull(), _joined(F.lit(kind), *map(F.col, c)))
    own, other = ("source_family", "canonical_source"), ("source_family", "source_id")
    relations = F.array_compact(F.array(pair("A", "authority"), pair("F", *(own if side == "a" else other)), pair("S", *(other if side == "a" else own))))
    given = F.array(*[F.lit(m).cast("int") for m in masks]) if masks else F.array().cast("array<int>")
    values = lambda c: [F.when(c.bitwiseAND(F.lit(1 << i)) != 0, F.col(n).cast("string")).otherwise(F.lit("")) for i, n in enumerate(_VETOES)]
    one = lambda c, b: _joined(c.cast("string"), b.cast("string"), *values(c))
    if side == "a":
        parts = F.transform(given, lambda m: one(F.col("mask").bitwiseAND(m), m))
    else:
        parts = F.transform(F.array_distinct(F.transform(given, lambda m: F.col("mask").bitwiseAND(m))), lambda c: one(c, F.col("mask")))
    token = lambda r, p: F.struct(F.when(F.left(r, F.lit(1)) == "A", "possible").otherwise("probable").alias("kind"), F.md5(_joined(r, F.col("programme"), F.col("title"), p)).alias("token"))
    return F.flatten(F.transform(relations, lambda r: F.transform(parts, lambda p: token(r, p))))


def review_matches(new: DataFrame, known: DataFrame, earlier: bool = False) -> DataFrame:
    """candidate, existing, kind, matched_by: of each record the smallest probable match, else the smallest possible one.

    earlier: only matches whose id is smaller than the candidate's. Like exact matches these come without pairs: a
    profile has a token for each combination of missing values that the other side has (32 at most), and of each token
    the two smallest ids count. Who has no probable match has no possible one that is related, so kinds need no pairs.
    """
    a, b = _reviewed(new), _reviewed(known)
    masks = [sorted(r[0] for r in side.select("mask").distinct().collect()) for side in (a, b)]  # 32 at most
    heads = lambda df: df.select("profile", "mask", *_PROFILE).dropDuplicates(["profile"])
    titles = _similar_titles(new, known).select("programme", F.md5(F.array_join("wa", " ")).alias("title_key"), F.md5(F.array_join("wb", " ")).alias("title"))
    asked = heads(a).join(titles, ["programme", "title_key"]).select("profile", F.inline(_review_tokens("a", masks[1])))
    # the two smallest records of each profile, then of each token
    least = _two_least(b.select("profile", F.struct("id", F.col("deadline").isNotNull().alias("d"), F.col("opening_date").isNotNull().alias("o")).alias("id")), "profile")
    held = heads(b).withColumn("title", F.col("title_key")).join(least, "profile").select(F.inline(_review_tokens("b", masks[0])), "ids")
    held = _two_least(held.select("token", F.explode("ids").alias("id")), "token")
    best = _two_least(asked.join(held, "token").select("profile", "kind", F.explode("ids").alias("id")), "profile", "kind")
    mine = a.select(F.col("id").alias("candidate"), "profile", F.col("deadline").isNotNull().alias("has_d"), F.col("opening_date").isNotNull().alias("has_o"))
    found = mine.join(best.select("profile", "kind", F.explode("ids").alias("e")), "profile").where("e.id < candidate" if earlier else "e.id <> candidate")
    by = F.array_compact(F.array(F.lit("programme"), F.lit("normalized_title_context"), F.when(F.col("has_d") & F.col("e.d"), "deadline"), F.when(F.col("has_o") & F.col("e.o"), "opening_date"), F.when(F.col("kind") == "probable", "known_source_relationship")))
    one = found.select("candidate", F.col("e.id").alias("existing"), "kind", by.alias("matched_by"))
    one = one.groupBy("candidate").agg(F.min_by(F.struct("existing", "kind", "matched_by"), F.struct(F.col("kind") != "probable", "existing")).alias("m"))
    return one.select("candidate", "m.existing", "m.kind", "m.matched_by")


def _results(new: DataFrame, strong: DataFrame, review: DataFrame) -> DataFrame:
    out = new.select(F.col("id").alias("candidate")).join(strong.select("candidate", "existing", F.col("matched_by").alias("by")), "candidate", "left").join(review.select("candidate", "kind", "matched_by"), "candidate", "left")
    exact = F.col("existing").isNotNull()
    return out.select("candidate", F.when(exact, "exact").otherwise(F.coalesce("kind", F.lit("none"))).alias("kind"), F.col("existing").alias("canonical_id"), F.when(exact, F.col("by")).otherwise(F.coalesce("matched_by", F.array().cast("array<string>"))).alias("matched_by"))


def find_duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidate, kind, canonical_id, matched_by: the best match of each candidate; only exact ones name a canonical id."""
    shared_checkpoints(candidates.sparkSession)
    new, known = prepared(candidates).checkpoint(), prepared(existing).checkpoint()
    return _results(new, strong_matches(new, known), review_matches(new, known))


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that driver and executors share; a temporary one only in a local session."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="lodestar-"))


def canonical_among(new: DataFrame, known: DataFrame) -> DataFrame:
    """id, canonical_id (null if canonical itself) of prepared() records that arrive in the order of their ids after known ones.

    A record is a duplicate if a known record, or an earlier one of its batch that is no duplicate, matches it
    exactly; the smallest of those is canonical. Each round settles records that have no earlier one undecided, and
    all that match these; records of one address or topic settle in two rounds, however many they are.
    """
    shared_checkpoints(new.sparkSession)
    before = smallest_match(new, known)
    fresh = new.join(before, new.id == before.candidate, "left_anti").checkpoint()
    open_, heads = fresh, fresh.limit(0)
    while True:
        least = smallest_match(open_, open_)
        first = open_.join(least.where("existing < candidate"), open_.id == least.candidate, "left_anti").checkpoint()
        heads = heads.unionByName(first)
        left = open_.join(first.select("id"), "id", "left_anti")
        found = smallest_match(left, first)
        # an earlier record only: ids are in order, and the smallest match tells whether there is one
        found = found.where("existing < candidate")
        open_ = left.join(found, left.id == found.candidate, "left_anti").checkpoint()
        if open_.isEmpty():
            break
    # a record may match known and earlier ones alike: the smallest id of both counts
    inner = smallest_match(new.join(heads.select("id"), "id", "left_anti"), heads).where("existing < candidate")
    to = before.unionByName(inner).groupBy("candidate").agg(F.min("existing").alias("canonical_id"))
    return new.select("id").join(to, F.col("id") == F.col("candidate"), "left").select("id", "canonical_id")


def discover_duplicates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidate, kind, canonical_id, matched_by, where candidates also see earlier canonical ones of their batch."""
    shared_checkpoints(candidates.sparkSession)
    new, known = prepared(candidates).checkpoint(), prepared(existing).checkpoint()
    to = canonical_among(new, known).checkpoint()
    heads = new.join(to.where(F.col("canonical_id").isNull()).select("id"), "id").checkpoint()
    own = new.select("id", "url", "topic").join(to.where(F.col("canonical_id").isNotNull()), "id")
    other = known.unionByName(heads).select(F.col("id").alias("canonical_id"), F.col("url").alias("u"), F.col("topic").alias("t")).dropDuplicates(["canonical_id"])
    by = F.array_compact(F.array(F.when(F.col("u") == F.col("url"), "canonical_url"), F.when(F.col("t") == F.col("topic"), "topic_id")))
    strong = own.join(other, "canonical_id").select(F.col("id").alias("candidate"), F.col("canonical_id").alias("existing"), by.alias("matched_by"))
    inner = review_matches(new, heads, earlier=True)
    review = review_matches(new, known).unionByName(inner)
    one = review.groupBy("candidate").agg(F.min_by(F.struct("existing", "kind", "matched_by"), F.struct(F.col("kind") != "probable", "existing")).alias("m"))
    return _results(new, strong, one.select("candidate", "m.existing", "m.kind", "m.matched_by")).checkpoint()


def incremental(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, canonical_id (null if the record is canonical itself): records arrive in the order of ord.

    edges: a, b with a arriving before b. A record is a duplicate if an earlier record that is no duplicate
    matches it; the smallest such id is canonical. Each round settles the records that no undecided earlier one
    matches, and all that match these; their edges go. State is checkpointed, not collected.
    """
    shared_checkpoints(nodes.sparkSession)
    edges = edges.select("a", "b").distinct().checkpoint()
    left, gone = edges, None
    while not left.isEmpty():
        roots = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        settled = left.join(roots, "a").select("b").distinct().checkpoint()
        gone = settled if gone is None else gone.unionByName(settled)
        left = left.join(settled, "b", "left_anti").join(settled.withColumnRenamed("b", "a"), "a", "left_anti").checkpoint()
    if gone is None:
        return nodes.select("id", F.lit(None).cast(edges.schema["a"].dataType).alias("canonical_id"))
    to = edges.join(gone.withColumnRenamed("b", "a"), "a", "left_anti").join(gone, "b").groupBy("b").agg(F.min("a").alias("canonical_id"))
    return nodes.select("id").join(to, F.col("id") == F.col("b"), "left").select("id", "canonical_id")


def discovery_counts(results: DataFrame) -> DataFrame:
    """Counters of a run over find_duplicates() joined with new_snapshot."""
    kind = F.col("kind")
    return results.agg(F.count_if(kind == "exact").alias("exact"), F.count_if(kind == "possible").alias("possible"), F.count_if(kind == "probable").alias("probable"), F.count_if(kind.isin("possible", "probable")).alias("review"), F.count_if(F.col("new_snapshot")).alias("new_snapshots"))
