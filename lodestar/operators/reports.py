"""Run reports, record quality, divergence of variants, briefs and their rendering."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.changes import TRACKED, long_form
from lodestar.sources.records import MOST_BYTES

DATES = ("publication_date", "opening_date", "deadline", "source_updated_at")
#: Limits of a brief.
MOST_REQUIREMENTS, MOST_ITEMS, MOST_CITATIONS = 30, 20, 12
BRIEF = "struct<title:string,summary:string,requirements:array<struct<text:string,status:string,citations:array<string>>>,deadlines:array<struct<text:string,citations:array<string>>>,risks:array<struct<text:string,citations:array<string>>>>"


#: Classes of network failures, by the kind of error or what its message says, in order.
FAILURES = (
    ("network_tls", r"\bssl|certificate|\btls\b"),
    ("network_dns", r"gaierror|name or service not known|nodename|getaddrinfo|name resolution|unknownhost"),
    ("network_timeout", r"timed? ?out"),
    ("network_connection_reset", r"connection ?reset|reset by peer"),
    ("network_connection_refused", r"connection ?refused"),
)


def error_code(message: Column, http_status: Column | None = None) -> Column:
    """Class of a failed fetch: http_N for an answer of that status, else by the error's kind and message, else by its number."""
    m = F.lower(message)
    number = F.regexp_extract(m, r"\berrno\W{0,2}(\d+)", 1)
    other = F.when(number != "", F.concat(F.lit("network_os_error_"), number)).otherwise("network_request_failed")
    out = F.coalesce(*[F.when(m.rlike(pattern), F.lit(code)) for code, pattern in FAILURES], F.when(message.isNotNull(), other))
    return out if http_status is None else F.when(http_status >= 400, F.concat(F.lit("http_"), http_status.cast("string"))).otherwise(out)


def failures(fetched: DataFrame) -> DataFrame:
    """source_id, error_code, http_status, response_bytes, payload_sha256 of fetches that failed (source_id, http_status, body, error).

    A body beyond what a source may answer has no hash.
    """
    n = F.octet_length("body")
    status = F.col("http_status")
    rows = fetched.where(F.col("error").isNotNull() | (status >= 400))
    return rows.select("source_id", error_code(F.col("error"), status).alias("error_code"), F.when(status >= 400, status).alias("http_status"), F.coalesce(n, F.lit(0)).alias("response_bytes"), F.when((status >= 400) & (n <= MOST_BYTES), F.sha2("body", 256)).alias("payload_sha256"))


def fetch_totals(results: DataFrame) -> DataFrame:
    """Over results of fetches (source_id, received, accepted, rejected, response_bytes, payload_sha256, source_timestamp, ok)."""
    return results.agg(
        F.count("*").alias("sources"), F.sum("received").alias("received"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("response_bytes").alias("bytes"),
        F.array_sort(F.collect_set("payload_sha256")).alias("hashes"), F.when(F.count_distinct("source_timestamp") == 1, F.min("source_timestamp")).alias("timestamp"), F.bool_and("ok").alias("all_succeeded"),
    )


def date_range(records: DataFrame) -> DataFrame:
    """First and last of the records' dates by source, and the last update."""
    low, high = F.least(*[F.col(d) for d in DATES]), F.greatest(*[F.col(d) for d in DATES])
    return records.groupBy("source_id").agg(F.min(low).alias("first_date"), F.max(high).alias("last_date"), F.max("source_updated_at").alias("last_update"))


def provenance_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(F.coalesce("provenance_status", F.lit("unknown")).alias("provenance_status")).agg(F.count("*").alias("n"))


def source_quality(records: DataFrame) -> DataFrame:
    """For each source: how many records name a call or topic, link to one, and their types."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    url = F.lower(F.coalesce("canonical_url", F.lit("")))
    kinds = records.groupBy("source_id", "opportunity_type").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("opportunity_type", "n")))).alias("types"))
    out = records.groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(has("call_id")).alias("call_ids"), F.count_if(has("topic_id")).alias("topic_ids"), F.count_if(has("call_id") | has("topic_id")).alias("either"), F.count_if(F.contains(url, F.lit("/topic-details/"))).alias("topic_urls"), F.count_if(F.contains(url, F.lit("/tender-details/"))).alias("tender_urls"))
    return out.join(kinds, "source_id")


def divergence(canonical: DataFrame, variants: DataFrame, fields: tuple[str, ...] = tuple(f for f in TRACKED if f != "canonical_url")) -> DataFrame:
    """Fields in which a variant (with duplicate_of) differs from its canonical record."""
    own = long_form(canonical, fields).withColumnsRenamed({"id": "canonical_id", "value": "canonical_value"})
    ids = variants.select(F.col("id").alias("variant_id"), F.col("duplicate_of").alias("canonical_id"))
    other = long_form(variants, fields).withColumnsRenamed({"id": "variant_id", "value": "variant_value"}).join(ids, "variant_id")
    return own.join(other, ["canonical_id", "field"]).where(~F.col("canonical_value").eqNullSafe(F.col("variant_value"))).select("canonical_id", "variant_id", "field", "canonical_value", "variant_value")


def assessment_report(calls: DataFrame, assessments: DataFrame, findings: DataFrame, divergences: DataFrame) -> DataFrame:
    """organisation_id, opportunity_id, text: a Markdown report of each assessment of the calls.

    findings: organisation_id, opportunity_id, rule_id, state, cited; divergences: canonical_id, variant_id, field and
    both values. Rules are named by their reasons; what isn't known says so.
    """
    said = lambda c, other="unknown": F.coalesce(c.cast("string"), F.lit(other))
    listed = lambda items, other: F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, "\n")).otherwise(other)
    c = calls.select(F.col("id").alias("opportunity_id"), F.coalesce("title", "id").alias("name"), "programme", "authority", "status", "opportunity_type", "deadline", "budget_total", "funding_max", "canonical_url", F.transform("eligibility_rules", lambda r: F.struct(r["rule_id"].alias("id"), r["reason"].alias("reason"))).alias("rules"))
    f = findings.groupBy("organisation_id", "opportunity_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "state", "cited"))).alias("found"))
    d = divergences.groupBy(F.col("canonical_id").alias("opportunity_id")).agg(F.array_sort(F.collect_list(F.struct("variant_id", "field", "canonical_value", "variant_value"))).alias("variants"))
    rows = assessments.join(c, "opportunity_id").join(f, ["organisation_id", "opportunity_id"], "left").join(d, "opportunity_id", "left")
    reason = lambda x: F.coalesce(F.try_element_at(F.filter("rules", lambda r: r["id"] == x["rule_id"]), F.lit(1))["reason"], x["rule_id"])
    finding = lambda x: F.concat(F.lit("- "), x["state"], F.lit(": "), reason(x), F.when(F.size(x["cited"]) > 0, F.concat(F.lit(" ["), F.array_join(x["cited"], ", "), F.lit("]"))).otherwise(" (no evidence)"))
    part = lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), said(x["score"], "no data"), F.lit(" (weight "), x["weight"].cast("string"), F.lit(")"))
    differs = lambda x: F.concat(F.lit("- "), x["field"], F.lit(": "), said(x["canonical_value"]), F.lit(" here, "), said(x["variant_value"]), F.lit(" in "), x["variant_id"])
    facts = F.array(*[F.concat(F.lit(f"- {label}: "), said(F.col(n))) for n, label in (("programme", "Programme"), ("authority", "Authority"), ("status", "Status"), ("opportunity_type", "Type"), ("deadline", "Deadline"), ("budget_total", "Budget"), ("funding_max", "Most funding"), ("canonical_url", "Official page"))])
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.col("name")),
        F.array_join(facts, "\n"),
        F.concat(F.lit("## Eligibility: "), F.col("state")),
        listed(F.transform("found", finding), "No rules were published."),
        F.concat(F.lit("## Fit: "), F.coalesce(F.concat(F.col("overall").cast("string"), F.lit("/100")), F.lit("not scored"))),
        listed(F.transform("components", part), "Nothing was scored."),
        F.lit("## What variants of the call say differently"),
        listed(F.transform("variants", differs), "Nothing, or there are no variants."),
    )
    return rows.select("organisation_id", "opportunity_id", F.concat(text, F.lit("\n")).alias("text"))


def check_briefs(briefs: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, brief, reject_reason of model answers (id, payload JSON): shape, limits, and that each citation is known.

    evidence: id, evidence_id that the answer may cite.
    """
    rows = briefs.withColumn("brief", F.from_json("payload", BRIEF))
    parts = F.concat(*[F.flatten(F.transform(F.coalesce(F.col(f"brief.{p}.citations"), F.array().cast("array<array<string>>")), lambda c: F.coalesce(c, F.array().cast("array<string>")))) for p in ("requirements", "deadlines", "risks")])
    counts = F.concat(*[F.transform(F.coalesce(F.col(f"brief.{p}"), F.array().cast(f"array<struct<{kind}>>")), lambda x: F.coalesce(F.size(F.array_distinct(x["citations"])), F.lit(0)) * F.when(F.size(F.array_distinct(x["citations"])) == F.size(x["citations"]), 1).otherwise(100)) for p, kind in (("requirements", "text:string,status:string,citations:array<string>"), ("deadlines", "text:string,citations:array<string>"), ("risks", "text:string,citations:array<string>"))])
    known = evidence.groupBy("id").agg(F.collect_set("evidence_id").alias("known"))
    rows = rows.join(known, "id", "left")
    outside = F.size(F.array_except(parts, F.coalesce("known", F.array().cast("array<string>")))) > 0
    reason = (
        F.when(F.col("brief").isNull() | F.col("brief.title").isNull(), "not_a_brief")
        .when((F.size("brief.requirements") > MOST_REQUIREMENTS) | (F.size("brief.deadlines") > MOST_ITEMS) | (F.size("brief.risks") > MOST_ITEMS), "too_long")
        .when(F.exists(counts, lambda n: (n < 1) | (n > MOST_CITATIONS)), "bad_citations")
        .when(outside, "unknown_evidence")
    )
    return rows.select("id", "brief", reason.alias("reject_reason"))


def brief_markdown(brief: Column) -> Column:
    """A brief as Markdown, an expression."""
    cited = lambda x: F.concat(F.lit("- "), x["text"], F.lit(" ["), F.array_join(x["citations"], ", "), F.lit("]"))
    section = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {name}\n\n"), F.array_join(F.transform(items, cited), "\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("# "), brief["title"], F.lit("\n\n"), F.coalesce(brief["summary"], F.lit("")), section("Requirements", brief["requirements"]), section("Deadlines", brief["deadlines"]), section("Risks", brief["risks"]))


def markdown_to_html(text: str) -> str:
    """Headings, lists, paragraphs and https links; everything else is escaped. One report, on the driver."""
    link = lambda m: f'<a href="{html.escape(m[2], quote=True)}">{m[1]}</a>' if m[2].startswith("https://") else m[1]
    line = lambda s: re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", link, html.escape(s, quote=False))
    out, listed = [], False
    for raw in text.splitlines():
        item, head = re.match(r"[-*] (.*)", raw), re.match(r"(#{1,6}) (.*)", raw)
        if listed and not item:
            out.append("</ul>")
            listed = False
        if item:
            out += [] if listed else ["<ul>"]
            listed = True
            out.append(f"<li>{line(item[1])}</li>")
        elif head:
            out.append(f"<h{len(head[1])}>{line(head[2])}</h{len(head[1])}>")
        elif raw.strip():
            out.append(f"<p>{line(raw)}</p>")
    return "\n".join(out + ["</ul>"] * listed)
