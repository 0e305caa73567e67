"""Three-state filtering: excluded by an explicit mismatch, else for review if something is unknown, else included."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import squeezed_set


@dataclass(frozen=True)
class Criteria:
    """What a user selects; an empty value falls back to the profile's preference of the same meaning."""

    opportunity_types: tuple[str, ...] = ()
    excluded_types: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    applicant_types: tuple[str, ...] = ()
    minimum_funding: float | None = None
    deadline_window_days: int | None = None
    profile: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.minimum_funding is not None and not self.minimum_funding >= 0:
            raise ValueError("minimum_funding must not be negative")
        if self.deadline_window_days is not None and not 0 <= self.deadline_window_days <= 3650:
            raise ValueError("deadline_window_days must be from 0 to 3650")

    def of(self, name: str, preference: str) -> tuple[str, ...]:
        return tuple(getattr(self, name) or self.profile.get(preference) or ())


def _overlap(wanted: tuple[str, ...], known: Column) -> Column:
    return F.arrays_overlap(squeezed_set(F.array(*map(F.lit, wanted))), squeezed_set(known))


def filter_opportunities(df: DataFrame, criteria: Criteria, now: Column) -> DataFrame:
    """df with state and reasons (codes in a fixed order)."""
    types, excluded = criteria.of("opportunity_types", "preferred_opportunity_types"), set(criteria.excluded_types) | set(criteria.profile.get("excluded_opportunity_types") or ())
    kind = F.col("opportunity_type")
    unknown_kind = kind.isNull() | (kind == "unknown")
    checks: list[tuple[str, str, Column, Column]] = []
    if types:
        checks.append(("type_unknown", "type_mismatch", unknown_kind, ~kind.isin(*types)))
    if excluded:
        checks.append(("type_maybe_excluded", "type_excluded", unknown_kind & ~kind.isin(*excluded), kind.isin(*excluded)))
    for code, wanted, column in (
        ("region", criteria.of("regions", "regions"), "eligible_regions"),
        ("geography", criteria.of("geographies", "preferred_geographies"), "geography"),
        ("sector", criteria.of("sectors", "sectors"), "eligible_sectors"),
        ("applicant", criteria.of("applicant_types", "applicant_types"), "eligible_applicant_types"),
    ):
        if wanted:
            checks.append((f"{code}_unknown", f"{code}_mismatch", F.col(column).isNull(), ~_overlap(wanted, F.col(column))))
    if criteria.minimum_funding is not None:
        checks.append(("funding_unknown", "funding_below_minimum", F.col("funding_max").isNull(), F.col("funding_max") < F.lit(criteria.minimum_funding)))
    if criteria.deadline_window_days is not None:
        end = now + F.make_interval(days=F.lit(criteria.deadline_window_days))
        checks.append(("deadline_unknown", "deadline_outside_window", F.col("deadline").isNull(), ~F.col("deadline").between(now, end)))
    none = F.lit(None).cast("string")
    codes = [F.when(unknown, F.lit(a)).when(mismatch, F.lit(b)).otherwise(none) for a, b, unknown, mismatch in checks]
    mismatched = F.lit(False)
    for _, _, unknown, mismatch in checks:
        mismatched = mismatched | F.coalesce(~unknown & mismatch, F.lit(False))
    out = df.withColumn("reasons", F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>"))
    return out.withColumn("state", F.when(mismatched, "excluded").when(F.size("reasons") > 0, "needs_review").otherwise("included"))


def canonical_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("duplicate_of").isNull())


def hide_excluded(df: DataFrame, show: bool = False) -> DataFrame:
    return df if show else df.where(F.col("state") != "excluded")


def of_tenant(df: DataFrame, workspace_id: str, organisation_id: str) -> DataFrame:
    return df.where((F.col("workspace_id") == workspace_id) & (F.col("organisation_id") == organisation_id))


def visible_to(df: DataFrame, workspace_id: str, organisation_id: str) -> DataFrame:
    """Rows for everyone, and those of this organisation in this workspace."""
    everyone = F.col("workspace_id").isNull() & F.col("organisation_id").isNull()
    own = (F.col("workspace_id") == workspace_id) & (F.col("organisation_id") == organisation_id)
    return df.where(everyone | own)


def check_evidence(df: DataFrame) -> DataFrame:
    """df with reject_reason: missing_evidence if a record has no title or no evidence."""
    return df.withColumn("reject_reason", F.when(F.col("title").isNull() | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "missing_evidence"))


def mark_delivered(df: DataFrame, event_id: str, at: Column) -> DataFrame:
    """delivered_at set once; a second call changes nothing."""
    return df.withColumn("delivered_at", F.when((F.col("event_id") == event_id) & F.col("delivered_at").isNull(), at).otherwise(F.col("delivered_at")))


def valid_tenant(workspace: Column, organisation: Column) -> Column:
    """Both are given or neither."""
    return workspace.isNull() == organisation.isNull()
