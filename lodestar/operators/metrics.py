"""Evaluation metrics. Ratios over nothing are null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import squeezed


#: Slices of the confidences that a calibration sums by.
BINS = 4_096


def _ratio(top, bottom):
    return F.try_divide(top.cast("double"), bottom)


def normalization_score(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Fields (id, field, value) that both sides know, and how many agree but for case and spaces."""
    known = lambda df, name: df.where(F.col("value").isNotNull() & (F.col("value") != "")).select("id", "field", F.col("value").alias(name))
    both = known(expected, "e").join(known(observed, "o"), ["id", "field"])
    return both.agg(F.count("*").alias("available"), F.count_if(squeezed(F.col("e")) == squeezed(F.col("o"))).alias("correct")).withColumn("score", _ratio(F.col("correct"), F.col("available")))


def recall_at_k(relevant: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """For each query: relevant ids, those among the first k retrieved, and their ratio."""
    if k < 1:
        raise ValueError("k must be positive")
    want = relevant.select("query_id", "item_id").distinct()
    got = retrieved.where(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias("hit")).distinct()
    out = want.join(got, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("retrieved"))
    return out.withColumn("score", _ratio(F.col("retrieved"), F.col("relevant")))


def reciprocal_rank(relevant: DataFrame, retrieved: DataFrame) -> DataFrame:
    """For each query with relevant ids: 1 / rank of the first that is retrieved, else 0."""
    want = relevant.select("query_id", "item_id").distinct()
    best = retrieved.join(want, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return want.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def reciprocal_rank_of_scores(relevant: DataFrame, scores: DataFrame) -> DataFrame:
    """reciprocal_rank() where items have scores (query_id, item_id, score; ties to smaller ids) and no ranks yet.

    The first relevant item's rank is one more than the items before it, so nothing is sorted.
    """
    want = relevant.select("query_id", "item_id").distinct()
    best = scores.join(want, ["query_id", "item_id"]).groupBy("query_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("i"))).alias("top"))
    above = scores.join(best, "query_id").groupBy("query_id").agg(F.count_if(F.struct("score", (-F.col("item_id")).alias("i")) > F.col("top")).alias("n"))
    return want.select("query_id").distinct().join(above, "query_id", "left").select("query_id", F.coalesce(1.0 / (F.col("n") + 1), F.lit(0.0)).alias("rr"))


def ranked(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def unordered(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs, smaller id first; a pair of one id is an error."""
    ok = F.when(F.col(a) != F.col(b), F.lit(True)).otherwise(F.raise_error(F.lit("a pair needs two ids")).cast("boolean"))
    return df.where(ok).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def pair_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """predicted, correct, precision, recall of pairs."""
    e, p = unordered(expected).withColumn("e", F.lit(1)), unordered(predicted).withColumn("p", F.lit(1))
    out = e.join(p, ["a", "b"], "full").agg(F.count("p").alias("predicted"), F.count("e").alias("expected"), F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("correct"))
    return out.withColumn("precision", _ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", _ratio(F.col("correct"), F.col("expected")))


def duplicate_report(labels: DataFrame, found: DataFrame) -> DataFrame:
    """kind (merge or candidate), predicted, correct, false_positives, precision, recall of labelled pairs.

    labels: a, b, same; found: a, b, kind of match. Exact matches merge; those and review matches are candidates.
    Pairs without a label don't count.
    """
    known = labels.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").distinct()
    got = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("kind") == "exact").alias("exact")).groupBy("a", "b").agg(F.max("exact").alias("exact"))
    rows = known.join(got, ["a", "b"], "left").select("same", F.inline(F.array(F.struct(F.lit("merge").alias("kind"), F.coalesce("exact", F.lit(False)).alias("hit")), F.struct(F.lit("candidate").alias("kind"), F.col("exact").isNotNull().alias("hit")))))
    out = rows.groupBy("kind").agg(F.count_if("hit").alias("predicted"), F.count_if(F.col("hit") & F.col("same")).alias("correct"), F.count_if(F.col("hit") & ~F.col("same")).alias("false_positives"), F.count_if("same").alias("expected"))
    return out.withColumns({"precision": _ratio(F.col("correct"), F.col("predicted")), "recall": _ratio(F.col("correct"), F.col("expected"))})


def agreement(samples: DataFrame, expected: str = "expected", observed: str = "observed") -> DataFrame:
    """Share of samples whose states (or safe flags) agree; two nulls agree."""
    out = samples.agg(F.count("*").alias("available"), F.count_if(F.col(expected).eqNullSafe(F.col(observed))).alias("correct"))
    return out.withColumn("score", _ratio(F.col("correct"), F.col("available")))


def citation_validity(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations, repeats counted, whose id is among the evidence."""
    known = evidence.select("evidence_id").distinct().withColumn("ok", F.lit(1))
    out = citations.select("evidence_id").join(known, "evidence_id", "left").agg(F.count("*").alias("citations"), F.count("ok").alias("valid"))
    return out.withColumn("score", _ratio(F.col("valid"), F.col("citations")))


def tenant_isolation(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Tenants seen, and distinct records that a tenant saw without being allowed to."""
    side = lambda df, seen: df.select("tenant", "record_id", F.lit(seen).alias("seen"))
    each = side(expected, 0).unionByName(side(observed, 1)).groupBy("tenant", "record_id").agg(F.min("seen").alias("leak"))
    by_tenant = each.groupBy("tenant").agg(F.sum(F.when(F.col("record_id").isNotNull(), F.col("leak")).otherwise(0)).alias("n"))
    return by_tenant.agg(F.count("tenant").alias("tenants"), F.coalesce(F.sum("n"), F.lit(0)).alias("leaks")).withColumn("isolated", F.col("leaks") == 0)


def change_recall(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Expected changes (call_id, field, new_value) that were detected."""
    keys = lambda df: df.select("call_id", "field", squeezed(F.col("new_value")).alias("v")).distinct()
    e, d = keys(expected), keys(detected).withColumn("ok", F.lit(1)).withColumnsRenamed({"call_id": "c", "field": "f", "v": "w"})
    same = e.call_id.eqNullSafe(d.c) & e.field.eqNullSafe(d.f) & e.v.eqNullSafe(d.w)
    out = e.join(d, same, "left").agg(F.count("*").alias("changes"), F.count("ok").alias("detected"))
    return out.withColumn("score", _ratio(F.col("detected"), F.col("changes")))


def calibrate(labels: DataFrame, confidence: str = "confidence", answerable: str = "answerable") -> DataFrame:
    """threshold, balanced_accuracy: the lowest threshold of best balanced accuracy, its threshold rounded up to 6 places.

    Candidates are 0, 1 and just above each confidence. Counts below a candidate are those of the slices of [0, 1]
    before its own, of which there are BINS, and of the smaller confidences in its slice.
    """
    c = F.col(confidence)
    groups = labels.groupBy(c.alias("c")).agg(F.count_if(~F.col(answerable)).alias("no"), F.count_if(F.col(answerable)).alias("yes"))
    groups = groups.withColumn("bin", F.greatest(F.lit(-1), F.least(F.lit(BINS), F.floor(F.col("c") * BINS))))
    before, all_of = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row for each slice
    bins = groups.groupBy("bin").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    bins = bins.select("bin", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("no", "yes")], *[F.sum(x).over(all_of).alias(f"n_{x}") for x in ("no", "yes")])
    w = Window.partitionBy("bin").orderBy("c")
    own = groups.select("c", "bin", "no", "yes", F.sum("no").over(w).alias("no_in"), F.sum("yes").over(w).alias("yes_in"))
    sums = own.join(bins, "bin").withColumns({"no_to": F.col("no_before") + F.col("no_in"), "yes_to": F.col("yes_before") + F.col("yes_in")})
    t = F.least(F.lit(1.0), F.col("c") + 1e-9)
    # a threshold just above c lets c's own labels count as below, unless it is cut at 1
    below = lambda to, own: F.when(F.col("c") < t, F.col(to)).otherwise(F.col(to) - F.col(own))
    at = sums.select(t.alias("t"), below("no_to", "no").alias("tn"), (F.col("n_yes") - below("yes_to", "yes")).alias("tp"), "n_no", "n_yes")
    zero = groups.agg(F.sum("no").alias("n_no"), F.sum("yes").alias("n_yes")).select(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("tn"), F.col("n_yes").alias("tp"), "n_no", "n_yes")
    one = groups.agg(F.sum(F.when(F.col("c") < 1, F.col("no")).otherwise(0)).alias("tn"), F.sum(F.when(F.col("c") >= 1, F.col("yes")).otherwise(0)).alias("tp"), F.sum("no").alias("n_no"), F.sum("yes").alias("n_yes")).select(F.lit(1.0).alias("t"), "tn", "tp", "n_no", "n_yes")
    score = 0.5 * (F.try_divide(F.col("tn").cast("double"), "n_no") + F.try_divide(F.col("tp").cast("double"), "n_yes"))
    best = at.unionByName(zero).unionByName(one).withColumn("balanced_accuracy", score).orderBy(F.desc("balanced_accuracy"), "t").limit(1)
    return best.select((F.ceil(F.col("t") * 1_000_000) / 1_000_000).alias("threshold"), "balanced_accuracy")


def abstention(decisions: DataFrame) -> DataFrame:
    """decisions: answerable, abstained -> precision, recall and miss rate of no answer, and abstentions on answerable."""
    a, s = F.col("answerable"), F.col("abstained")
    out = decisions.agg(F.count_if(~a).alias("no_answer"), F.count_if(a).alias("answerable_n"), F.count_if(s).alias("predicted"), F.count_if(s & ~a).alias("true_positives"), F.count_if(s & a).alias("wrong"))
    return out.select("no_answer", "predicted", "true_positives", _ratio(F.col("true_positives"), F.col("predicted")).alias("precision"), _ratio(F.col("true_positives"), F.col("no_answer")).alias("recall"), _ratio(F.col("no_answer") - F.col("true_positives"), F.col("no_answer")).alias("miss_rate"), _ratio(F.col("wrong"), F.col("answerable_n")).alias("answerable_abstention_rate"))


def field_report(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """For each field: available, correct, wrong, unknown and score."""
    e = expected.where(F.col("value").isNotNull()).select("id", "field", F.col("value").alias("e"))
    both = e.join(observed.select("id", "field", F.col("value").alias("o")), ["id", "field"], "left")
    right = F.coalesce(squeezed(F.col("e")) == squeezed(F.col("o")), F.lit(False))
    out = both.groupBy("field").agg(F.count("*").alias("available"), F.count_if(right).alias("correct"), F.count_if(F.col("o").isNotNull() & ~right).alias("wrong"), F.count_if(F.col("o").isNull()).alias("unknown"))
    return out.withColumn("score", _ratio(F.col("correct"), F.col("available")))


def span_validity(evidence: DataFrame) -> DataFrame:
    """Evidence whose excerpt is the text between its offsets."""
    ok = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("excerpt")
    return evidence.agg(F.count("*").alias("spans"), F.count_if(ok).alias("valid")).withColumn("score", _ratio(F.col("valid"), F.col("spans")))
