"""Row constraints as boolean expressions, and a reject reason from the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required_text(c: Column, most: int) -> Column:
    return F.coalesce((F.length(F.trim(c)) > 0) & (F.length(c) <= most), F.lit(False))


def not_negative(c: Column, most: float | None = None) -> Column:
    """Null or at least 0 (and at most most)."""
    ok = (c >= 0) if most is None else c.between(0, most)
    return c.isNull() | F.coalesce(ok & ~F.isnan(c.cast("double")), F.lit(False))


def https_url(c: Column) -> Column:
    """https with a host and without user information."""
    return F.coalesce(c.rlike(r"^https://[^/?#@\s]+([/?#]|$)"), F.lit(False))


def span(start: Column, end: Column, excerpt: Column) -> Column:
    return F.coalesce((start >= 0) & (end - start == F.length(excerpt)), F.lit(False))


def sha256_hex(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def evidence_row(provenance: Column, payload_hash: Column, snapshot: Column) -> Column:
    """Live evidence needs its payload's hash; a snapshot has at most 16 KiB."""
    return (F.coalesce(provenance != "live", F.lit(True)) | sha256_hex(payload_hash)) & (snapshot.isNull() | (F.octet_length(snapshot) <= 16 * 1024))


def document_row(text: Column, metadata: Column, links: Column) -> Column:
    return (F.octet_length(text) <= 5 * 1024 * 1024) & (F.coalesce(F.size(metadata), F.lit(0)) <= 100) & (F.coalesce(F.size(links), F.lit(0)) <= 500)


def unique_ids(c: Column, most: int = 12) -> Column:
    return (F.size(c) <= most) & (F.size(F.array_distinct(c)) == F.size(c))


def scores(c: Column) -> Column:
    return c.isNull() | c.between(0, 100)


def source_definition(row: dict[str, Column] | None = None) -> Column:
    """Policy of a registered source: enabled needs active and an URL, active needs a check date, commercial use needs documented reuse."""
    c = row or {x: F.col(x) for x in ("enabled", "status", "endpoint", "last_verified", "commercial_use", "reuse_status")}
    return (~c["enabled"] | ((c["status"] == "active") & c["endpoint"].isNotNull())) & ((c["status"] != "active") | c["last_verified"].isNotNull()) & (~c["commercial_use"] | (c["reuse_status"] == "documented_reuse"))


def brief_limits(requirements: Column, deadlines: Column, risks: Column, citations: Column) -> Column:
    return (F.size(requirements) <= 30) & (F.size(deadlines) <= 20) & (F.size(risks) <= 20) & F.size(citations).between(1, 12) & unique_ids(citations)


def rejected(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with reject_reason: the name of the first rule whose condition holds, in the order given."""
    reason = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        reason = F.when(fails, F.lit(name)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def strict(df: DataFrame, name: str, ok: Column) -> DataFrame:
    """Fails the job at the first row that breaks the rule."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"row breaks {name}")).cast("boolean")))


def query_args(query: str, limit: int, most_chars: int = 500, most: int = 100, blank: bool = True) -> None:
    """Checks arguments of a fetch or search on the driver."""
    if not isinstance(query, str) or len(query) > most_chars or (not blank and not query.strip()):
        raise ValueError(f"query must be text of at most {most_chars} characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
