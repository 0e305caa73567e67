"""What a user calls: each function takes DataFrames and returns one, or a few by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import changes, eligibility, filters, matching, reports, state
from lodestar.sources import evidence, records, registry

PROFILE = {"country": "str", "regions": "arr", "applicant_types": "arr", "company_size": "str", "employees": "num", "turnover": "num", "balance_sheet": "num", "financial_autonomy": "num", "sectors": "arr", "activities": "arr", "certifications": "arr", "consortium_capability": "str"}


def source_list(sources: DataFrame) -> DataFrame:
    """The registry as a list, with a label of how each source stands."""
    label = F.when(F.col("enabled") & (F.col("status") == "active"), "active").when(F.col("status") == "active", "off").otherwise(F.col("status"))
    return sources.select("source_id", "name", F.col("source_family").alias("family"), label.alias("label"), "last_verified").orderBy("source_id")


def source_check(scanned: DataFrame) -> dict[str, DataFrame]:
    """A scan's counts and reasons, its records' quality, and their date range; records without evidence are rejected."""
    docs = scanned.where(F.col("reject_reason").isNull()).withColumn("retrieved_at", F.current_timestamp())
    found = filters.check_evidence(evidence.normalize(docs))
    kept = found.where(F.col("reject_reason").isNull())
    return {"report": records.report(scanned), "rejected": found.where(F.col("reject_reason").isNotNull()).select("id", "reject_reason"), "quality": reports.source_quality(kept), "dates": reports.date_range(kept)}


def discover(documents: DataFrame, known: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Normalises new documents, matches them with known canonical records and among themselves, and merges them.

    A record sees the known table as it was before, and the canonical ones of its batch that came before it, as
    exact, probable and possible matches; of records that share an id in the batch the last retrieved counts.
    Within the batch records arrive in the order of their ids. "batch" holds the batch's records, "opportunities" all.
    """
    # written once: several joins below read it, and none of them should parse the documents again
    matching.shared_checkpoints(documents.sparkSession)
    new = state.keep_latest(evidence.normalize(documents), ["id"], [F.desc("source_retrieved_at")]).checkpoint()
    results = matching.discover_duplicates(new, known.where(F.col("duplicate_of").isNull()))
    marked = new.join(results.select(F.col("candidate").alias("id"), "canonical_id"), "id").withColumn("duplicate_of", F.col("canonical_id")).select(*new.columns)
    # only records of the batch meet their own former state
    out = state.save_opportunities(known.join(marked.select("id"), "id", "left_semi").select(*new.columns), marked, at)
    every = known.select(*new.columns).join(marked.select("id"), "id", "left_anti").unionByName(marked)
    return out | {"batch": marked, "opportunities": every, "matches": results, "counts": matching.discovery_counts(results.withColumn("new_snapshot", F.lit(False)).unionByName(out["snapshots"].select(F.lit(None).cast("string").alias("candidate"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("canonical_id"), F.lit(None).cast("array<string>").alias("matched_by"), F.lit(True).alias("new_snapshot"))))}


def organisation_add(profiles: DataFrame, given: DataFrame) -> DataFrame:
    """New profiles join; of known ones only the values given change."""
    merged = state.merge_given(profiles, given.join(profiles.select("id"), "id", "left_semi"))
    return merged.unionByName(given.join(profiles.select("id"), "id", "left_anti"), allowMissingColumns=True)


def organisation_show(profiles: DataFrame, workspace_id: str, organisation_id: str) -> DataFrame:
    return profiles.where((F.col("workspace_id") == workspace_id) & (F.col("id") == organisation_id))


def opportunity_list(opportunities: DataFrame, criteria: filters.Criteria, now: Column, show_excluded: bool = False) -> DataFrame:
    found = filters.filter_opportunities(filters.canonical_only(opportunities), criteria, now)
    return filters.hide_excluded(found, show_excluded).orderBy(F.col("deadline").asc_nulls_last(), "id")


def change_list(found: DataFrame, opportunity_id: str | None = None) -> DataFrame:
    out = found if opportunity_id is None else found.where(F.col("opportunity_id") == opportunity_id)
    return out.orderBy("detected_at", "change_id")


def notification_list(events: DataFrame, workspace_id: str, organisation_id: str) -> DataFrame:
    return filters.visible_to(events, workspace_id, organisation_id).orderBy("created_at", "event_id")


def profile_values(profiles: DataFrame) -> DataFrame:
    """organisation_id, profile_field, actual of the fields that rules may ask for."""
    entries = [F.struct(F.lit(n).alias("profile_field"), eligibility.value(k, **{{"str": "string", "num": "number", "arr": "array"}[k]: F.col(n)}).alias("actual")) for n, k in PROFILE.items() if n in profiles.columns]
    return profiles.select(F.col("id").alias("organisation_id"), F.inline(F.array(*entries))).where(F.col("actual").isNotNull())


def assess(opportunities: DataFrame, profiles: DataFrame, signals: DataFrame, at: Column, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """findings, assessments and high-fit events of the pairs in signals (organisation_id, opportunity_id, scores)."""
    rules = opportunities.select(F.col("id").alias("opportunity_id"), F.inline("eligibility_rules"))
    pairs = signals.select("organisation_id", "opportunity_id").join(opportunities.select(F.col("id").alias("opportunity_id"), F.col("evidence").alias("opp_evidence_ids")), "opportunity_id")
    found = eligibility.findings(pairs, rules, profile_values(profiles))
    scored = signals.join(eligibility.assess(found), ["organisation_id", "opportunity_id"]).join(profiles.select(F.col("id").alias("organisation_id"), "workspace_id"), "organisation_id")
    given = {n: F.col(n) for n in eligibility.WEIGHTS if n in signals.columns}
    parts = eligibility.components(F.col("state"), given, weights)
    out = scored.select("workspace_id", "organisation_id", "opportunity_id", "state", "n_findings", eligibility.fit_score(F.col("state"), given, weights).alias("overall"), parts.alias("components"), eligibility.strengths(parts).alias("strengths"), at.alias("assessed_at"))
    return {"findings": found, "assessments": out, "events": changes.high_fit_events(out)}


def active_sources(sources: DataFrame) -> DataFrame:
    return registry.active(sources)
