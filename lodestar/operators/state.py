"""Tables that batches are merged into: pure functions from (state, batch) to the new state.

The same functions serve a batch job and foreachBatch. Keys that repeat across batches are settled by
aggregates, which combine before their shuffle; no batch is applied row by row. Joins of whole states are merges
(hint "merge"): files of alike rows are much smaller than what they hold, so a broadcast chosen by their size would
fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.changes import canonical_json, deadline_approaching, detect_changes, notifications

VOLATILE = ("source_retrieved_at", "last_checked_at")


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    return keep_latest(df, keys, [F.desc(by), F.desc(tie)])


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Later rows of a key replace earlier ones; of equal times the batch's wins."""
    both = state.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return keep_latest(both, keys, [F.desc(by), F.desc("_side")]).drop("_side")


def insert_new(state: DataFrame, batch: DataFrame, ident: str) -> DataFrame:
    """Rows of the batch whose id is new; replays add nothing."""
    return batch.dropDuplicates([ident]).join(state.select(ident).hint("merge"), ident, "left_anti")


def document_snapshots(documents: DataFrame) -> DataFrame:
    """One row for each source and content: first and last time seen, and the last url and etag.

    documents: source_id, text, source_url, etag, retrieved_at. Applying the same rows again changes nothing.
    """
    rows = documents.withColumn("content_hash", F.sha2("text", 256))
    return rows.groupBy("source_id", "content_hash").agg(F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"), F.max_by("source_url", F.struct("retrieved_at", "source_url")).alias("source_url"), F.max_by("etag", F.struct("retrieved_at", "etag")).alias("etag"))


def stable_payload(df: DataFrame) -> Column:
    """A record as canonical JSON, without the times of its retrieval."""
    return canonical_json(F.struct(*sorted(c for c in df.columns if c not in VOLATILE)))


def stable_hash(df: DataFrame) -> Column:
    return F.sha2(stable_payload(df), 256)


def save_opportunities(state: DataFrame, batch: DataFrame, at: Column, window_days: int = 30) -> dict[str, DataFrame]:
    """opportunities (new state), snapshots, changes and notifications of a batch with one row for each id.

    A record's snapshot is its payload, where that differs from the one before. Records that are no duplicates are
    announced once when new, and while open when their deadline is near.
    """
    changes = detect_changes(state, batch, at)
    after = batch.select("id", stable_payload(batch).alias("payload_json")).withColumn("hash", F.sha2("payload_json", 256))
    before = state.select("id", stable_hash(state).alias("old"))
    snapshots = after.join(before.hint("merge"), "id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("id", "hash", "payload_json").withColumn("captured_at", at)
    own = batch.where(F.col("duplicate_of").isNull()) if "duplicate_of" in batch.columns else batch
    created = own.join(state.select("id").hint("merge"), "id", "left_anti").select(F.concat(F.lit("evt-"), F.left(F.sha2(F.concat(F.lit("new"), F.char(F.lit(0)), "id"), 256), F.lit(24))).alias("event_id"), F.lit("new_opportunity").alias("event_type"), F.col("id").alias("opportunity_id"), at.alias("created_at"), F.create_map(F.lit("field"), F.lit("id")).alias("payload"))
    events = notifications(changes).unionByName(created)
    if {"status", "deadline"} <= set(batch.columns):
        near = deadline_approaching(own, at, window_days)
        events = events.unionByName(near.select("event_id", "event_type", "opportunity_id", at.alias("created_at"), F.create_map(F.lit("field"), F.lit("deadline")).alias("payload")))
    kept = state.join(batch.select("id").hint("merge"), "id", "left_anti")
    return {"opportunities": kept.unionByName(batch), "snapshots": snapshots, "changes": changes, "notifications": events}


def variants(opportunities: DataFrame, canonical_id: str) -> DataFrame:
    return opportunities.where(F.col("duplicate_of") == canonical_id).orderBy("id")


def dangling(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose key parent doesn't have."""
    return child.join(parent.select(*keys).distinct().hint("merge"), keys, "left_anti")


def merge_given(profile: DataFrame, given: DataFrame, key: str = "id") -> DataFrame:
    """profile with the values of given that are not null."""
    g = given.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in given.columns if c != key])
    out = profile.join(g.hint("merge"), key, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in g.columns else F.col(c) for c in profile.columns])


def enrich(profiles: DataFrame, facts: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Null fields get the first fact about them; known values stay.

    facts: key, profile_field, value, ord. One pivoted aggregate, then coalesce.
    """
    first = facts.groupBy(key).agg(*[F.min_by(F.when(F.col("profile_field") == f, F.col("value")), F.when(F.col("profile_field") == f, F.col("ord"))).alias(f"_{f}") for f in fields])
    out = profiles.join(first.hint("merge"), key, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in profiles.columns])
