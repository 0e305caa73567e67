"""The registry of sources, adapter choice, and provenance of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Adapters that read a source.
ADAPTERS = ("funding_tenders", "ted_search", "portugal2030_annual_plan_xlsx", "cinea_life_html")
#: Registry keys that differ from the source id of documents.
SOURCE_ALIASES = {"cinea_life": "cinea"}
#: Fields of a registry file's sources.
SOURCE = """struct<source_id:string,name:string,status:string,authority:string,jurisdiction:string,official:boolean,base_url:string,discovery_method:string,content_types:array<string>,
opportunity_types:array<string>,check_cadence:string,enabled:boolean,priority:int,legal_notes:string,last_verified:string,adapter:string,legal_status:string,commercial_redistribution:boolean,
source_family:string,source_role:string,canonical_source:string,authority_relationship:string,snapshot_policy:string>"""
SCHEMA = f"version int, default_cadence string, sources array<{SOURCE}>"
#: What the fields of a source may say.
CADENCES = ("daily", "twice_weekly", "weekly", "manual")
STATUSES, JURISDICTIONS, ROLES = ("active", "pending_policy", "pending_verification", "discovery_only"), ("portugal", "direct_eu", "unknown"), ("canonical", "discovery", "forecast", "publisher")
LEGAL = ("documented_reuse", "terms_need_confirmation", "permission_required", "license_unspecified", "policy_unverified")
POLICIES = ("hash_and_excerpt", "bounded_normalized")
#: What each source must be, and what to say of one that isn't.
_CHECKS = {
    "source_id": "source_id <> '' AND length(source_id) <= 100",
    "status": f"status IN {STATUSES}",
    "jurisdiction": f"jurisdiction IN {JURISDICTIONS}",
    "check_cadence": f"check_cadence IN {CADENCES}",
    "priority": "priority BETWEEN 1 AND 5",
    "enabled": "NOT enabled OR (status = 'active' AND base_url IS NOT NULL)",
    "base_url": "base_url IS NULL OR base_url RLIKE '^https://[^/?#@]+([/?#]|$)'",
    "legal_notes": "official IS NOT NULL AND trim(legal_notes) <> ''",
    "content_types": "content_types IS NOT NULL AND forall(content_types, x -> trim(coalesce(x, '')) <> '')",
    "opportunity_types": "opportunity_types IS NOT NULL AND forall(opportunity_types, x -> trim(coalesce(x, '')) <> '')",
    "last_verified": "last_verified IS NULL AND status <> 'active' OR try_to_date(last_verified) IS NOT NULL",
    "legal_status": f"legal_status IN {LEGAL}",
    "commercial_redistribution": "NOT commercial_redistribution OR legal_status = 'documented_reuse'",
    "source_role": f"source_role IS NULL OR source_role IN {ROLES}",
    "snapshot_policy": f"snapshot_policy IN {POLICIES}",
    **{x: f"{x} IS NULL OR (trim({x}) <> '' AND length({x}) <= 100)" for x in ("source_family", "canonical_source", "authority_relationship")},
}
_DEFAULTS = {"legal_status": "policy_unverified", "commercial_redistribution": False, "snapshot_policy": "hash_and_excerpt"}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A row for each source of a version 1 registry. A file that isn't one, or a source that isn't as it must be, is an error."""
    book = spark.read.schema(SCHEMA).json(path, multiLine=True).first()
    if book is None or book.version != 1 or book.default_cadence not in CADENCES or book.sources is None:
        raise ValueError("not a version 1 registry with a default cadence and sources")
    # a registry is a file that people write: its sources are few, and checked here
    known = spark.createDataFrame([], SCHEMA).schema["sources"].dataType.elementType
    entries = F.variant_get(F.parse_json("value"), "$.sources", "array<map<string,variant>>")
    said = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("s")).select(F.map_keys("s").alias("names")).collect()
    if other := sorted({n for r in said for n in r.names} - set(known.names)):
        raise ValueError(f"a source has an unknown field: {other[0]}")
    rows = spark.createDataFrame(book.sources, known).fillna(_DEFAULTS)
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(check), F.lit(False)), F.lit(name)) for name, check in _CHECKS.items()]))
    if bad := rows.select("source_id", wrong.alias("fields")).where("size(fields) > 0").first():
        raise ValueError(f"source {bad.source_id}: {', '.join(bad.fields)}")
    if twice := rows.groupBy("source_id").count().where("count > 1").first():
        raise ValueError(f"source {twice.source_id} is registered twice")
    return rows.withColumn("last_verified", F.to_date("last_verified"))


def active(registry: DataFrame, adapters: tuple[str, ...] = ADAPTERS) -> DataFrame:
    return registry.where(F.col("enabled") & (F.col("status") == "active") & F.col("adapter").isin(*adapters))


def with_context(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """documents with the source's family, role, canonical source, relation to its authority, and what may be kept of it."""
    names = F.create_map(*[F.lit(x) for p in SOURCE_ALIASES.items() for x in p])
    known = registry.select(F.col("source_id").alias("_key"), "source_family", "source_role", "canonical_source", "authority_relationship", *(["snapshot_policy"] if "snapshot_policy" in registry.columns else []))
    return documents.withColumn("_key", F.coalesce(F.try_element_at(names, F.col("source_id")), F.col("source_id"))).join(known, "_key", "left").drop("_key")


def allowed_host(url: Column, suffixes: tuple[str, ...]) -> Column:
    """https on port 443, and a host that is one of the suffixes or below it; addresses that are numbers are not."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:@]+)(:443)?([/?#]|$)", 1))
    own = F.lit(False)
    for s in suffixes:
        own = own | (host == s) | host.endswith("." + s)
    return (host != "") & ~host.rlike(r"^[0-9.]+$") & own


def host_pages(pages: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Pages of a host bridge that come from allowed hosts; links to others are dropped."""
    out = pages.where(allowed_host(F.col("url"), suffixes))
    return out.withColumn("links", F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda x: allowed_host(x, suffixes))) if "links" in pages.columns else out
