"""Field-level changes between versions of a record, and the notifications that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.parse import hash_id

#: Fields whose changes count, and those that bear on eligibility.
TRACKED = (
    "programme", "title", "authority", "canonical_url", "publication_date", "opening_date", "deadline", "additional_deadlines", "budget_total", "funding_min",
    "funding_max", "aid_intensity", "project_cost_min", "project_cost_max", "trl_min", "trl_max", "consortium_rules", "project_duration", "documents", "call_id",
    "opportunity_type", "eligibility_rules", "eligible_applicant_types", "eligible_company_sizes", "geography", "eligible_sectors", "eligible_regions",
    "eligible_activities", "excluded_activities", "financial_requirements", "other_hard_requirements", "status",
)
ELIGIBILITY = (
    "eligibility_rules", "eligible_applicant_types", "eligible_company_sizes", "geography", "eligible_sectors", "eligible_regions", "eligible_activities",
    "excluded_activities", "financial_requirements", "other_hard_requirements",
)


def canonical_json(c: Column, kind: str = "string") -> Column:
    """A value as compact JSON; null stays null. Numbers and strings compare by value and type."""
    text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.regexp_replace(text, r'^\{"v":(.*)\}$', "$1"))


def values(df: DataFrame, fields: list[str], ident: str = "id", rules: str = "eligibility_rules") -> DataFrame:
    """id and values: tracked fields as JSON, in order; rules are compared without the evidence they cite."""
    kinds = dict(df.dtypes)
    bare = lambda name: F.transform(name, lambda r: r.dropFields("evidence_ids")) if name == rules and "evidence_ids" in kinds[name] else F.col(name)
    return df.select(ident, F.array(*[canonical_json(bare(name)) for name in fields]).alias("values"))


def long_form(df: DataFrame, fields: tuple[str, ...], ident: str = "id") -> DataFrame:
    """id, field, value: a row for each of values()."""
    held = [name for name in fields if name in df.columns]
    return values(df, held, ident).select(ident, F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col("values")[i].alias("value")) for i, name in enumerate(held)])))


def detect_changes(before: DataFrame, after: DataFrame, detected_at: Column, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """change_id, opportunity_id, field, old_value, new_value, detected_at for ids on both sides.

    Records meet whole, a row for each. Files of alike records are much smaller than what they hold, so their size must
    not choose a broadcast.
    """
    shared = [name for name in fields if name in before.columns and name in after.columns]
    old, new = (values(df, shared).withColumnRenamed("values", side) for df, side in ((before, "old"), (after, "new")))
    entries = [F.struct(F.lit(name).alias("field"), F.col("old")[i].alias("old_value"), F.col("new")[i].alias("new_value")) for i, name in enumerate(shared)]
    rows = old.join(new.hint("merge"), "id").select("id", F.inline(F.array(*entries)))
    rows = rows.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("detected_at", detected_at)
    iso = F.date_format(F.to_utc_timestamp("detected_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return rows.select(hash_id("chg-", 24, F.col("id"), F.col("field"), F.col("old_value"), F.col("new_value"), iso).alias("change_id"), F.col("id").alias("opportunity_id"), "field", "old_value", "new_value", "detected_at")


def notification_types(field: Column, new_value: Column) -> Column:
    first = F.when((field == "status") & (new_value == '"open"'), "call_opened").when((field == "status") & (new_value == '"closed"'), "call_closed").when(field.isin(*ELIGIBILITY), "eligibility_requirement_changed")
    return F.array_compact(F.array(first, F.lit("important_call_change")))


def notifications(changes: DataFrame) -> DataFrame:
    """One or two events for each change, with ids that repeat on replay."""
    rows = changes.withColumn("event_type", F.explode(notification_types(F.col("field"), F.col("new_value"))))
    return rows.select(hash_id("evt-", 24, F.col("change_id"), F.col("event_type")).alias("event_id"), "event_type", "opportunity_id", F.col("detected_at").alias("created_at"), F.create_map(F.lit("field"), F.col("field")).alias("payload"))


def deadline_approaching(df: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Events of open calls whose deadline lies in [now, now + days]."""
    if days <= 0:
        return df.sparkSession.createDataFrame([], "event_id string, event_type string, opportunity_id string, deadline timestamp")
    rows = df.where((F.col("status") == "open") & F.col("deadline").between(now, now + F.make_interval(days=F.lit(days))))
    iso = F.date_format(F.to_utc_timestamp("deadline", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return rows.select(hash_id("evt-", 24, F.col("id"), iso, F.lit(days * 86400)).alias("event_id"), F.lit("deadline_approaching").alias("event_type"), F.col("id").alias("opportunity_id"), "deadline")


def high_fit_events(assessments: DataFrame) -> DataFrame:
    """Events of assessments that are not ineligible, score 80 or more, and score more than eligibility; once for each tenant and call."""
    scored = F.exists("components", lambda c: (c["name"] != "eligibility") & c["score"].isNotNull() & (c["weight"] > 0))
    rows = assessments.where((F.col("state") != "ineligible") & (F.col("overall") >= 80) & scored)
    return rows.select(hash_id("evt-", 24, F.lit("new_high_fit"), F.col("workspace_id"), F.col("organisation_id"), F.col("opportunity_id")).alias("event_id"), F.lit("new_high_fit_opportunity").alias("event_type"), "opportunity_id", "workspace_id", "organisation_id", "overall").dropDuplicates(["event_id"])
