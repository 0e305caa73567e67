"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

The tables hold no funding calls, so each operator is bound to columns of like shape; nulls are derived where
an operator's point is what it does with them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import parse
from lodestar.functions import text as T
from lodestar import sinks
from lodestar.operators import changes, constraints, eligibility, filters, matching, metrics, reports, retrieval, state
from lodestar.sources import enrichment, evidence, fetch, registry
from lodestar.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: DuckDB expressions that several queries share.
_FOLD = "strip_accents(replace(lower({0}), 'ß', 'ss'))"
_TOKENS = "regexp_extract_all(" + _FOLD + ", '[\\p{{L}}\\p{{N}}_]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that has fewer splits than there are cores is dealt over all of them."""
    table, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in ("documents", "pages") and table.rdd.getNumPartitions() < cores else table


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(table: str, ident: str, text: str, terms: list[str], raw: list[str], section: str | None = None, limit: int = 10, order: str = "") -> str:
    """SQL of one search: tf and idf for each term, bonus for the section, coverage of the raw terms."""
    values = ", ".join(f"('{t}')" for t in terms)
    raws = ", ".join(f"('{t}', '{u}')" for t in raw for u in (t, *retrieval.SYNONYMS.get(t, ())))
    sect = _TOKENS.format(section) if section else "CAST([] AS VARCHAR[])"
    return f"""
        WITH p AS (SELECT {ident}, {_TOKENS.format(text)} AS body, {sect} AS sect FROM {table}),
             terms(t) AS (VALUES {values}), raws(r, u) AS (VALUES {raws}),
             n AS (SELECT greatest(1, count(*)) AS total FROM p),
             hit AS (SELECT p.*, t, CAST(len(list_filter(body, lambda x: x = t)) AS DOUBLE) AS f, list_contains(sect, t) AS s FROM p, terms
                     WHERE list_contains(body, t) OR list_contains(sect, t)),
             df AS (SELECT t, count(*) AS df FROM hit GROUP BY t),
             idf AS (SELECT t, ln(1 + (total - df + 0.5) / (df + 0.5)) AS w FROM df, n),
             sc AS (SELECT {ident}, round(sum(w * f * 2.2 / (f + 1.2) + CASE WHEN s THEN 0.75 * w ELSE 0 END), 6) AS score FROM hit JOIN idf USING (t) WHERE f > 0 GROUP BY ALL),
             cov AS (SELECT {ident}, count(DISTINCT r) / {float(len(raw))} AS coverage FROM p, raws WHERE list_contains(body, u) OR list_contains(sect, u) GROUP BY ALL)
        SELECT {ident}, score, round(coverage, 6) AS coverage FROM sc JOIN cov USING ({ident}) ORDER BY score DESC, {order or ident} LIMIT {limit}"""


SEARCH = "Theth reer of the heing, thand SME hention onea ender"
_RAW, _TERMS = retrieval.query_terms(SEARCH)


@query(_bm25_sql("documents", "doc_id", "text", _TERMS, _RAW))
def r3_bm25_topk(spark, sf_dir):
    hits = retrieval.search(_table(spark, sf_dir, "documents"), SEARCH, 10, order=(F.col("doc_id"),))
    return hits.select("doc_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query(_bm25_sql("conversations", "conv_id, turn", "text", *reversed(retrieval.query_terms("the user asks about reer and ther")), section="role", limit=12))
def r3_bm25_sections(spark, sf_dir):
    hits = retrieval.search(_table(spark, sf_dir, "conversations"), "the user asks about reer and ther", 12, order=(F.col("conv_id"), F.col("turn")), section="role")
    return hits.select("conv_id", "turn", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


_WORD = "[\\p{L}\\p{N}_]+"
_EXCERPT_TERMS = ", ".join(f"'{t}'" for t in retrieval.query_terms(SEARCH)[1])


@query(f"""
    WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, string_split_regex(text, '{_WORD}') AS gaps FROM documents
               WHERE len(list_filter({_TOKENS.format("text")}, lambda w: w IN ({_EXCERPT_TERMS}))) > 0),
         p AS (SELECT doc_id, text, list_position(list_transform(words, lambda w: {_FOLD.format("w")} IN ({_EXCERPT_TERMS})), true) AS n, words, gaps FROM d),
         s AS (SELECT doc_id, text, CASE WHEN length(text) <= 1200 THEN 0 ELSE least(greatest(0, length(array_to_string(gaps[1:n], '')) + length(array_to_string(words[1:n - 1], '')) - 400), length(text) - 1200) END AS f FROM p)
    SELECT doc_id, CAST(f AS INTEGER) AS start, CAST(least(f + 1200, length(text)) AS INTEGER) AS "end", 'line ' || (1 + length(text[1:f]) - length(replace(text[1:f], chr(10), ''))) AS location,
           'ev-' || left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || chr(0) || text[f + 1:f + 1200]), 12) AS evidence_id FROM s""")
def r5_snippets(spark, sf_dir):
    """Every document with a word of the search as one passage."""
    hits = retrieval.scored(_table(spark, sf_dir, "documents"), SEARCH).select("doc_id", F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("line"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("section"), "text")
    return retrieval.snippets(hits, SEARCH).select("doc_id", "start", "end", "location", "evidence_id")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
    SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(length(trim(line)) > 0 AS BOOLEAN) AS filled, CAST(length(line) AS INTEGER) AS chars FROM l WHERE length(trim(line)) > 0""")
def r1_passages(spark, sf_dir):
    """Lines as passages: a blank line after each makes the splitter part them."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = retrieval.passages(docs)
    return out.select(F.col("source").cast("long").alias("doc_id"), ((F.col("line") + 1) / 2).cast("int").alias("line"), (F.length(F.trim("text")) > 0).alias("filled"), F.length("text").alias("chars"))


_ASKED = ["Theth reer of the heing", "zzqqxx vvkkww", "and the funding deadline", "hention onea ender thand"]


def _decision_sql() -> str:
    parts = []
    for i, q in enumerate(_ASKED):
        raw, terms = retrieval.query_terms(q)
        parts.append(f"SELECT {i} AS query_id, * FROM ({_bm25_sql('documents', 'doc_id', 'text', terms, raw, limit=1)})")
    asked = ", ".join(f"({i})" for i in range(len(_ASKED)))
    return f"""
        WITH best AS ({" UNION ALL ".join(parts)}), q(query_id) AS (VALUES {asked}),
             c AS (SELECT query_id, doc_id, round(coalesce(0.7 * coverage + 0.3 * score / (score + 2.0), 0), 6) AS confidence FROM q LEFT JOIN best USING (query_id))
        SELECT query_id, doc_id, confidence, CASE WHEN doc_id IS NOT NULL AND confidence >= 0.290165 THEN 'supported' ELSE 'no_supported_result' END AS status FROM c"""


@query(_decision_sql())
def r7_decision(spark, sf_dir):
    best = retrieval.best_of(_table(spark, sf_dir, "documents"), _ASKED, "doc_id")
    asked = spark.range(len(_ASKED)).select(F.col("id").cast("int").alias("query_id"))
    out = retrieval.decisions(asked.join(best, "query_id", "left"))
    return out.select("query_id", "doc_id", F.round("confidence", 6).alias("confidence"), "status")


_STOP = ", ".join(f"'{w}'" for w in sorted(retrieval.STOP_WORDS))


@query(f"""
    WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark),
         qs AS (SELECT DISTINCT query_id, term FROM q WHERE term NOT IN ({_STOP})),
         tf AS (SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS f FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents) SEMI JOIN qs USING (term) GROUP BY ALL),
         df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS total FROM documents),
         s AS (SELECT query_id, doc_id, round(sum(round(ln(1 + (total - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2), 9)), 6) AS score FROM tf JOIN df USING (term) JOIN qs USING (term), n GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def r8_legacy_rank(spark, sf_dir):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.rank_many(_table(spark, sf_dir, "documents"), queries)


@query("""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q']) AS m FROM pages),
         k AS (SELECT page_id, m, list_filter(string_split(substr(m.q, 2), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('gclid', 'fbclid', 'ref')) AS kept FROM p)
    SELECT page_id, lower(m.s) || lower(m.h) || CASE WHEN regexp_replace(m.p, '/+$', '') = '' THEN '/' ELSE regexp_replace(m.p, '/+$', '') END
           || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END AS url FROM k""")
def n21_url_norm(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3, 4, 5) THEN CAST(d AS VARCHAR) END AS day, k = 5 AS timed FROM o""")
def n6_date_chain(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    month = F.element_at(F.array(*[F.lit(m.title()) for m in parse.MONTHS]), F.month("d"))
    written = (
        F.when(F.col("k") == 0, F.date_format("d", "yyyy-MM-dd"))
        .when(F.col("k") == 1, F.date_format("d", "yyyyMMdd"))
        .when(F.col("k") == 2, F.date_format("d", "d/M/yyyy"))
        .when(F.col("k") == 3, F.concat_ws(" ", F.dayofmonth("d"), month, F.year("d")))
        .when(F.col("k") == 4, F.concat(F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".5")))
        .when(F.col("k") == 5, F.date_format("d", "yyyy-MM-dd'T'17:00:00'Z'"))
        .when(F.col("k") == 6, F.date_format("d", "yyyy-MM-dd'T'17:00:00"))
        .otherwise(F.lit("soon"))
    )
    at = parse.when(written)
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return o.select("o_orderkey", F.date_format(utc, "yyyy-MM-dd").alias("day"), F.coalesce(F.hour(utc) == 17, F.lit(False)).alias("timed"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN CAST(c AS DOUBLE) / 100 WHEN 1 THEN CAST(c AS DOUBLE) / 100 WHEN 2 THEN CAST(c // 100 AS DOUBLE) WHEN 3 THEN CAST(c // 100 AS DOUBLE) END AS amount FROM o""")
def n8_decimal_parse(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    whole, cents = F.expr("c div 100"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    dots = F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ".")
    written = F.when(F.col("k") == 0, F.concat(whole.cast("string"), F.lit("."), cents)).when(F.col("k") == 1, F.concat(F.lit("€ "), dots, F.lit(","), cents)).when(F.col("k") == 2, F.concat(F.regexp_replace(dots, r"\.", " "), F.lit(" €"))).when(F.col("k") == 3, dots).otherwise(F.lit("-5"))
    value = parse.decimal(written)
    # up to three digits and one point are read as thousands, as are 1.500 and the like; whole amounts have no point
    return o.select("o_orderkey", value.cast("double").alias("amount"))


@query("""
    SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_type || ' ; ' || p_brand || '||' || chr(10), '[|;' || chr(10) || ']+'), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts FROM part""")
def n10_split_list(spark, sf_dir):
    joined = F.concat("p_type", F.lit(" ; "), "p_brand", F.lit("||\n"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.strings(joined), "/").alias("parts"))


def _token_counts(spark, sf_dir, tokens) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


_COUNTS_SQL = """
    WITH t AS (SELECT doc_id, unnest({0}) AS term FROM documents)
    SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, CAST(sum(length(term)) AS BIGINT) AS chars FROM t GROUP BY doc_id"""


@query(_COUNTS_SQL.format(_TOKENS.format("text")))
def n19_search_tokens(spark, sf_dir):
    """The documents hold none of the phrases that a search spells alike."""
    return _token_counts(spark, sf_dir, T.search_tokens)


@query(_COUNTS_SQL.format("regexp_extract_all(" + _FOLD.format("text") + ", '[a-z0-9]+')"))
def n20_plain_words(spark, sf_dir):
    return _token_counts(spark, sf_dir, T.plain_words)


@query("""
    SELECT n_nationkey, CASE WHEN lower(n_name) IN ('open', 'ongoing') THEN 'open' ELSE 'unknown' END AS status, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k,
           CASE n_nationkey % 4 WHEN 0 THEN 'grant' WHEN 1 THEN 'repayable_incentive' WHEN 2 THEN 'open' ELSE 'unknown' END AS kind FROM nation""")
def n12_codes(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    m = F.col("n_nationkey") % 4
    kind = F.when(m == 0, parse.opportunity_type(F.lit("Grants"))).when(m == 1, parse.opportunity_type(F.lit("Reimbursable  Advance"))).when(m == 2, parse.status(F.lit(" Open  for Submission"))).otherwise(parse.opportunity_type(F.lit("lottery")))
    return n.select("n_nationkey", parse.status(F.col("n_name")).alias("status"), T.key(F.col("n_name")).alias("k"), kind.alias("kind"))


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'loan' WHEN p_partkey % 3 = 1 THEN 'grant' ELSE 'unknown' END AS kind,
                      CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE [upper(p_brand), 'x'] END AS regions, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS funding,
                      CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 60 AS INTEGER) END AS days FROM part),
         c AS (SELECT p_partkey, kind IS NULL OR kind = 'unknown' AS u1, coalesce(kind = 'loan', false) AS m1,
                      regions IS NULL AS u2, regions IS NOT NULL AND lower(regions[1]) NOT IN ('brand#11', 'brand#22', 'brand#33', 'brand#44') AS m2,
                      funding IS NULL AS u3, coalesce(funding < 1200, false) AS m3, days IS NULL AS u4, coalesce(days > 30, false) AS m4 FROM p)
    SELECT p_partkey, CASE WHEN m1 OR m2 OR m3 OR m4 THEN 'excluded' WHEN u1 OR u2 OR u3 OR u4 THEN 'needs_review' ELSE 'included' END AS state,
           CAST(CAST(u1 OR m1 AS INT) + CAST(u2 OR m2 AS INT) + CAST(u3 OR m3 AS INT) + CAST(u4 OR m4 AS INT) AS INTEGER) AS n_reasons,
           concat_ws(',', CASE WHEN u1 THEN 'type_unknown' WHEN m1 THEN 'type_mismatch' END, CASE WHEN u2 THEN 'region_unknown' WHEN m2 THEN 'region_mismatch' END,
                     CASE WHEN u3 THEN 'funding_unknown' WHEN m3 THEN 'funding_below_minimum' END, CASE WHEN u4 THEN 'deadline_unknown' WHEN m4 THEN 'deadline_outside_window' END) AS reasons FROM c""")
def f1_three_state(spark, sf_dir):
    k, now = F.col("p_partkey"), F.lit("2026-10-06").cast("timestamp")
    calls = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 11 == 0, None).when(k % 3 == 0, "loan").when(k % 3 == 1, "grant").otherwise("unknown").alias("opportunity_type"),
        F.when(k % 7 != 0, F.array(F.upper("p_brand"), F.lit("x"))).alias("eligible_regions"),
        F.when(k % 13 != 0, F.col("p_retailprice")).alias("funding_max"),
        F.when(k % 17 != 0, now + F.make_interval(days=(k % 60).cast("int"))).alias("deadline"),
    )
    wanted = filters.Criteria(opportunity_types=("grant",), regions=("Brand#11", "brand#22 ", "BRAND#33", "brand#44"), minimum_funding=1200, deadline_window_days=30)
    return filters.filter_opportunities(calls, wanted, now).select("p_partkey", "state", F.size("reasons").alias("n_reasons"), F.array_join("reasons", ",").alias("reasons"))


@query("""
    WITH p AS (SELECT p_partkey AS k, lower(p_brand) AS b, lower(p_type) AS t FROM part),
         r AS (SELECT k, list_filter([CASE WHEN k % 9 = 0 THEN 'type_maybe_excluded' WHEN k % 3 = 1 THEN 'type_excluded' END,
                   CASE WHEN k % 7 = 0 THEN 'geography_unknown' WHEN k % 2 = 1 THEN 'geography_mismatch' END,
                   CASE WHEN k % 5 = 0 THEN 'sector_unknown' WHEN b NOT IN ('brand#11', 'brand#22', 'brand#33') THEN 'sector_mismatch' END,
                   CASE WHEN k % 4 = 0 THEN 'applicant_mismatch' END], lambda x: x IS NOT NULL) AS codes FROM p)
    SELECT k AS p_partkey, CASE WHEN len(list_filter(codes, lambda c: c LIKE '%mismatch' OR c = 'type_excluded')) > 0 THEN 'excluded' WHEN len(codes) > 0 THEN 'needs_review' ELSE 'included' END AS state,
           array_to_string(codes, ',') AS reasons FROM r""")
def f1_more_filters(spark, sf_dir):
    """Excluded types (given and of the profile), geographies, sectors of the profile, and applicant types."""
    k = F.col("p_partkey")
    calls = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 9 == 0, "unknown").when(k % 3 == 1, F.when(k % 2 == 0, "loan").otherwise("prize")).otherwise("grant").alias("opportunity_type"),
        F.when(k % 7 != 0, F.array(F.when(k % 2 == 0, " PORTUGAL").otherwise("Spain"))).alias("geography"),
        F.when(k % 5 != 0, F.array("p_brand")).alias("eligible_sectors"),
        F.array(F.when(k % 4 == 0, "ngo").otherwise("SME")).alias("eligible_applicant_types"),
    )
    wanted = filters.Criteria(excluded_types=("loan",), geographies=("portugal",), applicant_types=("sme",), profile={"sectors": ["brand#11", "BRAND#22", "Brand#33"], "excluded_opportunity_types": ["prize"]})
    return filters.filter_opportunities(calls, wanted, F.current_timestamp()).select("p_partkey", "state", F.array_join("reasons", ",").alias("reasons"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'missing_evidence' END AS reject_reason FROM customer
    WHERE c_nationkey % 4 = 1 AND c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0""")
def f4_tenant_evidence(spark, sf_dir):
    """Canonical records of one tenant, and which of them lack a title or evidence."""
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 4).cast("string").alias("workspace_id"), F.col("c_mktsegment").alias("organisation_id"), F.when(k % 2 == 1, "x").alias("duplicate_of"), F.when(k % 5 != 0, F.col("c_name")).alias("title"), F.when(k % 3 != 0, F.array(F.lit("ev"))).alias("evidence"))
    return filters.check_evidence(filters.canonical_only(filters.of_tenant(rows, "1", "BUILDING"))).select("c_custkey", "reject_reason")


@query("""
    SELECT event_id, event_type FROM events WHERE (user_id % 3 = 0) OR (user_id % 3 = 1 AND user_id % 5 = 2)""")
def f5_visibility(spark, sf_dir):
    u = F.col("user_id")
    e = _table(spark, sf_dir, "events").withColumns({"workspace_id": F.when(u % 3 != 0, F.concat(F.lit("w"), (u % 3).cast("string"))), "organisation_id": F.when(u % 3 != 0, F.concat(F.lit("o"), (u % 5).cast("string")))})
    return filters.visible_to(e, "w1", "o2").select("event_id", "event_type")


_RULES = [("r1", 0, "country", "in", True, None), ("r2", 1, "turnover", "minimum", False, "raise turnover"), ("r3", 2, "sectors", "intersects", True, None), ("r4", 3, "company_size", "equals", True, None), ("r5", 0, "balance_sheet", "maximum", False, None), ("r6", 2, "certifications", "present", True, None)]


@query("""
    WITH prof AS (SELECT c_custkey AS o, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS country, c_acctbal AS turnover, lower(c_mktsegment) AS seg FROM customer),
         f AS (
            SELECT o, 0 AS call, CASE WHEN country IS NULL THEN 2 WHEN country IN ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10') THEN 0 ELSE 3 END AS sev FROM prof
            UNION ALL SELECT o, 1, CASE WHEN turnover >= 1000 THEN 0 ELSE 1 END FROM prof
            UNION ALL SELECT o, 2, CASE WHEN seg IN ('building', 'machinery') THEN 0 ELSE 3 END FROM prof
            UNION ALL SELECT o, 3, 2 FROM prof
            UNION ALL SELECT o, 0, CASE WHEN turnover <= 9000 THEN 0 ELSE 2 END FROM prof
            UNION ALL SELECT o, 2, 2 FROM prof
            UNION ALL SELECT o, 4, 2 FROM prof)
    SELECT o AS organisation_id, CAST(call AS INTEGER) AS opportunity_id, CASE max(sev) WHEN 3 THEN 'ineligible' WHEN 2 THEN 'uncertain' WHEN 1 THEN 'remediable' ELSE 'eligible' END AS state, count(*) AS n_findings FROM f GROUP BY ALL""")
def e4_eligibility(spark, sf_dir):
    """Customers against five calls; rules cite evidence, but for r4, whose evidence is missing."""
    V = eligibility.value
    cust = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("organisation_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey").cast("string")).alias("country"), "c_acctbal", "c_mktsegment")
    entry = lambda name, v: F.struct(F.lit(name).alias("profile_field"), v.alias("actual"))
    values = cust.select("organisation_id", F.inline(F.array(entry("country", V("str", string=F.col("country"))), entry("turnover", V("num", number=F.col("c_acctbal"))), entry("balance_sheet", V("num", number=F.col("c_acctbal"))), entry("sectors", V("arr", array=F.array(F.initcap("c_mktsegment")))), entry("company_size", V("str", string=F.lit("small"))))))
    rules = spark.createDataFrame(_RULES, "rule_id string, opportunity_id int, profile_field string, operator string, hard_gate boolean, remediation string")
    expected = F.when(F.col("rule_id") == "r1", V("arr", array=F.array(*[F.lit(str(i)) for i in range(1, 11)]))).when(F.col("rule_id") == "r2", V("num", number=F.lit(1000))).when(F.col("rule_id") == "r3", V("arr", array=F.array(F.lit(" building"), F.lit("MACHINERY")))).when(F.col("rule_id") == "r4", V("str", string=F.lit("small"))).when(F.col("rule_id") == "r5", V("str", string=F.lit("9000")))
    rules = rules.withColumns({"expected": expected, "evidence_ids": F.array(F.when(F.col("rule_id") == "r4", "gone").otherwise("ev"))})
    calls = spark.range(5).select(F.col("id").cast("int").alias("opportunity_id"), F.array(F.lit("ev")).alias("opp_evidence_ids"))
    pairs = cust.select("organisation_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("opportunity_id")).join(F.broadcast(calls), "opportunity_id")  # five rows
    return eligibility.assess(eligibility.findings(pairs, rules, values))


@query("""
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'remediable' WHEN 2 THEN 'uncertain' ELSE 'ineligible' END AS state,
                      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 101 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 7) % 101 END AS b FROM orders),
         t AS (SELECT *, CASE state WHEN 'eligible' THEN 100 WHEN 'remediable' THEN 55 ELSE 35 END AS e FROM s)
    SELECT o_orderkey, CASE WHEN state = 'ineligible' OR (a IS NULL AND b IS NULL) THEN NULL
           ELSE CAST(floor((e * 0.16::DOUBLE + coalesce(a * 0.17::DOUBLE, 0) + coalesce(b * 0.1::DOUBLE, 0)) / (0.16::DOUBLE + CASE WHEN a IS NULL THEN 0 ELSE 0.17::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.1::DOUBLE END) + 0.5) AS INTEGER) END AS overall FROM t""")
def e6_fit(spark, sf_dir):
    k = F.col("o_orderkey")
    st = F.element_at(F.array(*map(F.lit, ("eligible", "remediable", "uncertain", "ineligible"))), (k % 4 + 1).cast("int"))
    a, b = F.when(k % 5 != 0, k % 101), F.when(k % 3 != 0, (k * 7) % 101)
    return _table(spark, sf_dir, "orders").select("o_orderkey", eligibility.fit_score(st, {"strategic_fit": a, "company_capabilities": b}).alias("overall"))


_NO_FIELDS = {n: "string" for n in ("canonical_url", "topic_id", "call_id", "programme", "title", "authority", "source_family", "canonical_source")} | {"deadline": "timestamp", "opening_date": "timestamp"}


def _records(df: DataFrame, ident: str, **fields) -> DataFrame:
    """Rows as records for matching, with an id of ten digits; fields not given are null."""
    given = {"source_id": F.lit("s")} | {n: F.lit(None).cast(t) for n, t in _NO_FIELDS.items()} | fields
    return df.select(F.lpad(F.col(ident).cast("string"), 10, "0").alias("id"), *[c.alias(n) for n, c in given.items()])


@query("""
    WITH p AS (SELECT page_id AS i, CASE WHEN page_id % 5 > 0 THEN page_id % 17 END AS u, CASE WHEN page_id % 3 > 0 THEN page_id % 13 END AS t, CASE WHEN page_id % 4 > 0 THEN page_id % 2 END AS c, page_id % 17 % 4 = 0 AS topic_page FROM pages),
         m AS (SELECT a.i AS candidate, b.i AS existing, coalesce(a.u = b.u, false) AS bu, coalesce(a.t = b.t, false) AS bt FROM p a JOIN p b ON a.i % 7 < 4 AND b.i % 7 >= 4 AND (coalesce(a.u = b.u, false) OR coalesce(a.t = b.t, false))
               WHERE NOT coalesce(a.t <> b.t, false) AND NOT (a.u IS NOT NULL AND b.u IS NOT NULL AND a.topic_page AND b.topic_page AND a.u <> b.u) AND (coalesce(a.t = b.t, false) OR NOT coalesce(a.c <> b.c, false))),
         f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY existing) = 1)
    SELECT i AS candidate, CASE WHEN existing IS NULL THEN 'none' ELSE 'exact' END AS kind, existing AS canonical_id,
           concat_ws(',', CASE WHEN bu THEN 'canonical_url' END, CASE WHEN bt THEN 'topic_id' END) AS matched_by
    FROM p LEFT JOIN f ON candidate = i WHERE i % 7 < 4""")
def d2_exact_dups(spark, sf_dir):
    """Pages as calls with addresses (of topics, some of them), topics and call ids, any of which may be missing."""
    k = F.col("page_id")
    address = F.concat(F.lit("https://x.eu"), F.when(k % 17 % 4 == 0, "/topic-details/").otherwise("/"), (k % 17).cast("string"), F.lit("/?utm_source=a"))
    calls = _records(_table(spark, sf_dir, "pages"), "page_id", canonical_url=F.when(k % 5 > 0, address), topic_id=F.when(k % 3 > 0, F.concat(F.lit("T "), (k % 13).cast("string"))), call_id=F.when(k % 4 > 0, F.concat(F.lit("c-"), (k % 2).cast("string"))))
    side = F.col("id").cast("long") % 7 < 4
    out = matching.find_duplicates(calls.where(side), calls.where(~side))
    return out.select(F.col("candidate").cast("long").alias("candidate"), "kind", F.col("canonical_id").cast("long").alias("canonical_id"), F.array_join("matched_by", ",").alias("matched_by"))


@query("""
    WITH c AS (SELECT c_custkey AS i, c_mktsegment AS p, c_custkey % 40 AS t, CASE WHEN c_custkey % 4 > 0 THEN 'f' END AS f, c_custkey % 3 AS s, c_custkey % 5 AS o, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey % 2 END AS au, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 2 END AS d FROM customer),
         m AS (SELECT a.i AS candidate, b.i AS existing, coalesce(a.f = b.f AND (a.o = b.s OR b.o = a.s), false) AS rel, a.d IS NOT NULL AND b.d IS NOT NULL AS dates FROM c a JOIN c b ON a.i % 11 < 3 AND b.i % 11 >= 3 AND a.p = b.p AND a.t = b.t
               WHERE NOT coalesce(a.d <> b.d, false) AND (coalesce(a.f = b.f AND (a.o = b.s OR b.o = a.s), false) OR coalesce(a.au = b.au, false))),
         f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY rel DESC, existing) = 1)
    SELECT i AS candidate, CASE WHEN existing IS NULL THEN 'none' WHEN rel THEN 'probable' ELSE 'possible' END AS kind,
           CASE WHEN existing IS NULL THEN '' ELSE concat_ws(',', 'programme', 'normalized_title_context', CASE WHEN dates THEN 'deadline' END, CASE WHEN rel THEN 'known_source_relationship' END) END AS matched_by
    FROM c LEFT JOIN f ON candidate = i WHERE i % 11 < 3""")
def d3_review(spark, sf_dir):
    """Customers as calls whose titles differ in one of five words, by segment as programme."""
    k = F.col("c_custkey")
    title = F.concat(F.lit("Água limpa para os rios "), (k % 40).cast("string"))
    calls = _records(
        _table(spark, sf_dir, "customer"), "c_custkey", programme=F.col("c_mktsegment"), title=title, source_family=F.when(k % 4 > 0, "f"), source_id=(k % 3).cast("string"), canonical_source=(k % 5).cast("string"),
        authority=F.when(k % 6 > 0, (F.col("c_nationkey") % 2).cast("string")), deadline=F.when(k % 7 > 0, F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=(k % 2).cast("int"))),
    )
    side = F.col("id").cast("long") % 11 < 3
    out = matching.find_duplicates(calls.where(side), calls.where(~side))
    return out.select(F.col("candidate").cast("long").alias("candidate"), "kind", F.array_join("matched_by", ",").alias("matched_by"))


@query("""
    WITH c AS (SELECT c_custkey AS i, c_mktsegment AS p, c_custkey % 30 AS t, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 23 END AS u, c_custkey % 23 % 3 > 0 AS topic_page, CASE WHEN c_custkey % 7 > 4 THEN c_custkey % 4 END AS l,
                      CASE WHEN c_custkey % 4 > 0 THEN 'f' END AS f, c_custkey % 3 AS s, c_custkey % 5 AS o, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey % 2 END AS au, CASE WHEN c_custkey % 9 > 6 THEN c_custkey % 2 END AS d FROM customer),
         m AS (SELECT a.i AS candidate, b.i AS existing, coalesce(a.u = b.u, false) AND NOT coalesce(a.l <> b.l, false) AS exact, coalesce(a.f = b.f AND (a.o = b.s OR b.o = a.s), false) AS rel, a.d IS NOT NULL AND b.d IS NOT NULL AS dates,
                      NOT coalesce(a.l <> b.l, false) AND NOT coalesce(a.d <> b.d, false) AND a.p = b.p AND a.t = b.t AND (coalesce(a.f = b.f AND (a.o = b.s OR b.o = a.s), false) OR coalesce(a.au = b.au, false)) AS review
               FROM c a JOIN c b ON a.i % 11 < 3 AND b.i % 11 >= 3 WHERE NOT coalesce(a.u <> b.u AND a.topic_page AND b.topic_page, false)),
         f AS (SELECT * FROM m WHERE exact OR review QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY exact DESC, rel AND NOT exact DESC, existing) = 1)
    SELECT i AS candidate, CASE WHEN existing IS NULL THEN 'none' WHEN exact THEN 'exact' WHEN rel THEN 'probable' ELSE 'possible' END AS kind, CASE WHEN exact THEN existing END AS canonical_id,
           CASE WHEN existing IS NULL THEN '' WHEN exact THEN 'canonical_url' ELSE concat_ws(',', 'programme', 'normalized_title_context', CASE WHEN dates THEN 'deadline' END, CASE WHEN rel THEN 'known_source_relationship' END) END AS matched_by
    FROM c LEFT JOIN f ON candidate = i WHERE i % 11 < 3""")
def d3_addresses(spark, sf_dir):
    """Customers as calls with addresses, of topics' pages for most, so that exact matches, vetoes and reviews mix."""
    k = F.col("c_custkey")
    address = F.concat(F.lit("https://x.eu"), F.when(k % 23 % 3 > 0, "/topic-details/").otherwise("/"), (k % 23).cast("string"))
    calls = _records(
        _table(spark, sf_dir, "customer"), "c_custkey", canonical_url=F.when(k % 5 > 0, address), call_id=F.when(k % 7 > 4, F.concat(F.lit("c "), (k % 4).cast("string"))), programme=F.col("c_mktsegment"), title=F.concat(F.lit("Água limpa para os rios "), (k % 30).cast("string")),
        source_family=F.when(k % 4 > 0, "f"), source_id=(k % 3).cast("string"), canonical_source=(k % 5).cast("string"), authority=F.when(k % 6 > 0, (F.col("c_nationkey") % 2).cast("string")), deadline=F.when(k % 9 > 6, F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=(k % 2).cast("int"))),
    )
    side = F.col("id").cast("long") % 11 < 3
    out = matching.find_duplicates(calls.where(side), calls.where(~side))
    return out.select(F.col("candidate").cast("long").alias("candidate"), "kind", F.col("canonical_id").cast("long").alias("canonical_id"), F.array_join("matched_by", ",").alias("matched_by"))


_TITLE_STOP = ", ".join(f"'{w}'" for w in matching.TITLE_STOP_WORDS)


@query(f"""
    WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang, regexp_extract(url, '^https?://[^/]*?([a-z]+\\.(?:com|net|org))', 1) AS auth,
                      list_distinct(list_filter(regexp_extract_all({_FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '[a-z0-9]+'), lambda w: w NOT IN ({_TITLE_STOP}))) AS w FROM pages),
         m AS (SELECT a.page_id AS candidate, min(b.page_id) AS first FROM p a JOIN p b ON a.lang = b.lang AND a.page_id <> b.page_id AND a.auth = b.auth AND len(a.w) > 0 AND len(b.w) > 0
                      AND len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w))) GROUP BY 1)
    SELECT p.page_id AS candidate, CASE WHEN first IS NULL THEN 'none' ELSE 'possible' END AS kind FROM p LEFT JOIN m ON m.candidate = p.page_id""")
def d3_title_jaccard(spark, sf_dir):
    none = F.lit(None).cast("string")
    p = _table(spark, sf_dir, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("id"), F.lit("pages").alias("source_id"), none.alias("canonical_url"), none.alias("topic_id"), none.alias("call_id"),
        F.regexp_extract("url", "/([a-z]{2})/", 1).alias("programme"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", r"^https?://[^/]*?([a-z]+\.(?:com|net|org))", 1).alias("authority"), F.lit(None).cast("timestamp").alias("deadline"), F.lit(None).cast("timestamp").alias("opening_date"), none.alias("source_family"), none.alias("canonical_source"),
    )
    return matching.find_duplicates(p, p).select(F.col("candidate").cast("long").alias("candidate"), "kind")


@query("""
    WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents)
    SELECT doc_id, CASE WHEN first < doc_id THEN first END AS canonical_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM d)""")
def d5_incremental(spark, sf_dir):
    """Arrival in the order of doc_id; equal texts match. Copies of one text meet its first arrival only."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("id"), F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("id").alias("a"))
    edges = d.join(first, "h").where("a < id").select("a", F.col("id").alias("b"))
    out = matching.incremental(edges, d.select("id"))
    return out.select(F.col("id").cast("long").alias("doc_id"), F.col("canonical_id").cast("long").alias("canonical_id"))


@query("""
    WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 10 = 3 AS known FROM documents), g AS (SELECT h, min(CASE WHEN known THEN doc_id END) AS k, min(CASE WHEN NOT known THEN doc_id END) AS b FROM d GROUP BY h)
    SELECT doc_id, CASE WHEN k IS NOT NULL OR b < doc_id THEN 'exact' ELSE 'none' END AS kind, CASE WHEN k IS NOT NULL THEN k WHEN b < doc_id THEN b END AS canonical_id FROM d JOIN g USING (h) WHERE NOT known""")
def d5_discover(spark, sf_dir):
    """Equal texts as one topic: a batch sees known documents, and those of its own that came before and are canonical."""
    calls = _records(_table(spark, sf_dir, "documents"), "doc_id", topic_id=F.sha2("text", 256))
    known = F.col("id").cast("long") % 10 == 3
    out = matching.discover_duplicates(calls.where(~known), calls.where(known))
    return out.select(F.col("candidate").cast("long").alias("doc_id"), "kind", F.col("canonical_id").cast("long").alias("canonical_id"))


@query("""
    WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0 FROM events)
    SELECT 'chg-' || left(sha256(CAST(event_id AS VARCHAR) || chr(0) || 'title' || chr(0) || '"' || t0 || '"' || chr(0) || '"' || event_type || '"' || chr(0) || '2026-10-06T00:00:00+00:00'), 24) AS change_id,
           event_id, '"' || t0 || '"' AS old_value, '"' || event_type || '"' AS new_value FROM w WHERE t0 <> event_type""")
def c2_change_ids(spark, sf_dir):
    """Ids of the changes of a user's consecutive events, as titles of a record."""
    w = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).where("before IS NOT NULL")
    at = F.to_timestamp(F.lit("2026-10-06T00:00:00Z"))
    found = changes.detect_changes(w.select("id", F.col("before").alias("title")), w.select("id", "title"), at)
    return found.select("change_id", F.col("opportunity_id").alias("event_id"), "old_value", "new_value")


@query("""
    WITH o AS (SELECT o_orderkey AS k FROM orders),
         s AS (SELECT k FROM o WHERE k % 5 <> 0), b AS (SELECT k, k % 3 = 0 AS opened, k % 4 = 0 AS titled FROM o WHERE k % 2 = 0),
         m AS (SELECT b.* FROM b JOIN s USING (k))
    SELECT 'opportunities' AS what, count(*) AS n FROM o WHERE k % 5 <> 0 OR k % 2 = 0
    UNION ALL SELECT 'snapshots', (SELECT count(*) FROM m WHERE opened OR titled) + (SELECT count(*) FROM b ANTI JOIN s USING (k))
    UNION ALL SELECT 'changes', sum(opened::INT + titled::INT) FROM m
    UNION ALL SELECT 'notifications', (SELECT sum(2 * opened::INT + titled::INT) FROM m) + (SELECT count(*) FROM b ANTI JOIN s USING (k))""")
def p2_save_opportunities(spark, sf_dir):
    """A batch of even orders over a state without every fifth: what each table of the store gets."""
    k = F.col("o_orderkey")
    held = _table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.lit("upcoming").alias("status"), F.lit("a").alias("title"), F.lit(0).alias("last_checked_at"), k.alias("k"))
    batch = held.where("k % 2 = 0").withColumns({"status": F.when(F.col("k") % 3 == 0, "open").otherwise(F.col("status")), "title": F.when(F.col("k") % 4 == 0, "b").otherwise(F.col("title")), "last_checked_at": F.lit(1)})
    out = state.save_opportunities(held.where("k % 5 <> 0").drop("k"), batch.drop("k"), F.lit("2026-10-06").cast("timestamp"))
    counts = [df.agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n, df in out.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def _customer_store(spark, sf_dir) -> Store:
    """A store of customers as calls, in three batches: all, every third one opened, and the second batch again."""
    store, k = Store(spark, sinks.shared_folder(spark, "store"), 16), F.col("c_custkey")
    every = _table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("s").alias("source_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("programme"), F.lit("upcoming").alias("status"))
    opened = every.where("k % 3 = 0").withColumns({"status": F.lit("open"), "title": F.when(F.col("k") % 2 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))})
    for day, batch in enumerate((every, opened, opened), 1):
        store.save_opportunities(batch.drop("k"), F.lit(f"2026-10-0{day}").cast("timestamp"))
    return store


@query("""
    SELECT 'c' || c_custkey AS id, c_name || CASE WHEN c_custkey % 6 = 0 THEN '!' ELSE '' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'upcoming,open' ELSE 'upcoming' END AS statuses,
           CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS snapshots, CASE WHEN c_custkey % 6 = 0 THEN 'status,title' WHEN c_custkey % 3 = 0 THEN 'status' ELSE '' END AS changed FROM customer""")
def k1_store(spark, sf_dir):
    """What the store says of each record after three batches: its state, the states it had, and what changed."""
    now = _customer_store(spark, sf_dir).snapshot()
    past = now.read("opportunity_snapshots").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("captured_at", F.get_json_object("payload_json", "$.status").alias("s")))), lambda x: x["s"]), ",").alias("statuses"), F.count("*").cast("int").alias("snapshots"))
    found = now.read("changes").groupBy(F.col("opportunity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("changed"))
    return now.read("opportunities").select("id", "title").join(past.hint("merge"), "id").join(found.hint("merge"), "id", "left").fillna("", ["changed"])


@query("""
    SELECT 'c' || c_custkey AS opportunity_id, field, CASE field WHEN 'status' THEN '"upcoming"' ELSE '"' || c_name || '"' END AS old_value,
           CASE field WHEN 'status' THEN '"open"' ELSE '"' || c_name || '!"' END AS new_value, 'changed' AS kind
    FROM customer, (VALUES ('status'), ('title')) AS f(field) WHERE c_custkey % 3 = 0 AND (field = 'status' OR c_custkey % 6 = 0)""")
def w2_change_feed(spark, sf_dir):
    """What changed between the store's first and last version."""
    store = _customer_store(spark, sf_dir)
    return store.change_feed(1, 3, F.lit("2026-10-04").cast("timestamp")).select("opportunity_id", "field", "old_value", "new_value", "kind")


@query("""
    WITH p AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages), t AS (SELECT count(*) AS total FROM p)
    SELECT CAST(n // 100 + 1 AS INTEGER) AS request, 'N' || page_id AS record_id, url AS title, CAST(total AS VARCHAR) AS total,
           CASE WHEN total > least(100, total - n // 100 * 100) THEN 'more_available' ELSE 'complete' END AS state FROM p, t""")
def s3_fetch(spark, sf_dir):
    """All pages as notices of a procurement search, recorded 100 to an answer, and read by the source of that name."""
    rows = _table(spark, sf_dir, "pages").select(F.concat(F.lit("N"), F.col("page_id").cast("string")).alias("publication-number"), F.col("url").alias("notice-title"), "page_id")
    total, path = rows.count(), sinks.shared_folder(spark, "recorded")
    # ranks by shards of ids in order: a count for each, then ranks within
    shard = F.floor(F.col("page_id") / 1000)
    before = rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("page_id")) + F.col("before") - 1
    numbered = rows.withColumn("shard", shard).join(before.select("shard", "before"), "shard").withColumn("request", F.floor(rank / 100).cast("int") + 1)
    answers = numbered.groupBy("request").agg(F.to_json(F.struct(F.lit(total).alias("totalNoticeCount"), F.collect_list(F.struct("publication-number", "notice-title")).alias("notices"))).alias("value"))
    answers.repartition("request").write.partitionBy("request").text(path)
    found = fetch.load(spark, evidence.NOTICES, limit=100, pages=-(-total // 100), recorded=path)
    docs = fetch.documents(found.withColumn("url", F.col("request").cast("string")), evidence.NOTICES, limit=100)
    meta = lambda k: F.col("metadata")[k]
    return docs.join(found.select(F.col("payload_sha256"), "request"), "payload_sha256").select("request", meta("record_id").alias("record_id"), "title", meta("source_total_results").alias("total"), meta("source_pagination_state").alias("state"))


class Register:
    """A provider that knows of a VAT number what its digits say."""

    provider_id = "register"

    def enrich(self, vat_number: str) -> list[dict]:
        n, at = int(vat_number[2:]), datetime(2026, 10, 6, tzinfo=UTC)
        said = {"country": "PT" if n % 2 else "ES", "employees": n * 10} | ({"regions": ["Norte", f"R{n % 3}"]} if n % 5 else {})
        return [{"profile_field": f, "value": v, "retrieved_at": at, "evidence_id": f"ev-{f}-{n}"} for f, v in said.items()]


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'FR' WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey % 2 = 1 THEN 'PT' ELSE 'ES' END AS country, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_nationkey * 10 AS INTEGER) END AS employees,
           CASE WHEN c_custkey % 7 > 0 AND c_nationkey % 5 > 0 THEN 'Norte,R' || (c_nationkey % 3) END AS regions,
           CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END + CASE WHEN c_nationkey % 5 > 0 THEN 1 ELSE 0 END END AS proofs FROM customer""")
def x3_enrichment(spark, sf_dir):
    """Customers as organisations, each nation's number asked once; some have no number, some know their country."""
    k = F.col("c_custkey")
    own = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 > 0, F.concat(F.lit("PT"), F.col("c_nationkey").cast("string"))).alias("vat_number"), F.when(k % 3 == 0, "FR").alias("country"), F.lit(None).cast("int").alias("employees"), F.lit(None).cast("array<string>").alias("regions"))
    out = enrichment.apply(own, enrichment.facts(own, "lodestar.plans.workload:Register"))
    return out.select("c_custkey", "country", "employees", F.array_join("regions", ",").alias("regions"), F.size("enrichment").alias("proofs"))


@query("""
    SELECT n_nationkey, r_name AS source_family, CASE WHEN r_regionkey % 2 = 0 THEN 'official' END AS source_role FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4""")
def j1_context(spark, sf_dir):
    """Nations as documents, regions as sources; one region isn't registered."""
    registered = _table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("source_id"), F.col("r_name").alias("source_family"), F.when(F.col("r_regionkey") % 2 == 0, "official").alias("source_role"), F.lit(None).cast("string").alias("canonical_source"), F.lit(None).cast("string").alias("authority_relationship"))
    documents = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("source_id"))
    return registry.with_context(documents, registered).select("n_nationkey", "source_family", F.when(F.col("source_family").isNotNull(), F.col("source_role")).alias("source_role"))


@query("""
    SELECT count(*) AS sources, CAST(sum(o_orderkey % 9) AS BIGINT) AS received, CAST(sum(o_orderkey % 5) AS BIGINT) AS accepted, count(DISTINCT o_orderpriority) AS hashes, bool_and(o_orderkey >= 0) AS all_succeeded FROM orders""")
def a3_fetch_totals(spark, sf_dir):
    k = F.col("o_orderkey")
    r = _table(spark, sf_dir, "orders").select((k % 9).alias("received"), (k % 5).alias("accepted"), (k % 2).alias("rejected"), k.alias("response_bytes"), F.col("o_orderpriority").alias("payload_sha256"), F.col("o_orderdate").alias("source_timestamp"), (k >= 0).alias("ok"))
    return reports.fetch_totals(r).select("sources", "received", "accepted", F.size("hashes").cast("long").alias("hashes"), "all_succeeded")


@query("""
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'http_' || (400 + event_id % 200) WHEN event_id % 6 = 0 THEN 'network_tls' WHEN event_id % 6 = 1 THEN 'network_dns' WHEN event_id % 6 = 2 THEN 'network_timeout'
           WHEN event_id % 6 = 3 THEN 'network_connection_reset' WHEN event_id % 6 = 4 THEN 'network_os_error_' || (event_id % 100) END AS error_code FROM events""")
def s8_error_codes(spark, sf_dir):
    """Messages made from event ids; some fetches were answered with an error status."""
    k = F.col("event_id")
    said = F.element_at(F.array(*map(F.lit, ("<urlopen error [SSL: WRONG_VERSION] x>", "gaierror: Name or service not known", "The read operation timed out", "ConnectionResetError: [Errno 104]"))), (k % 6 + 1).cast("int"))
    message = F.when(k % 6 < 4, said).when(k % 6 == 4, F.concat(F.lit("OSError: [Errno "), (k % 100).cast("string"), F.lit("] No route")))
    return _table(spark, sf_dir, "events").select("event_id", reports.error_code(message, F.when(k % 7 == 0, 400 + k % 200)).alias("error_code"))


@query("""
    SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(json_object('id', CAST(n_nationkey AS VARCHAR), 'name', n_name, 'region', n_regionkey, 'unknown', NULL) AS VARCHAR) AS payload FROM nation""")
def k5_payloads(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.lit(None).cast("string").alias("unknown"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("id"))
    return sinks.payloads(n)


@query("""
    SELECT CASE WHEN merge THEN 'merge' ELSE 'candidate' END AS kind, count(*) FILTER (k % 2 = 0 AND (NOT merge OR k % 4 = 0)) AS predicted, count(*) FILTER (k % 2 = 0 AND (NOT merge OR k % 4 = 0) AND k % 3 = 0) AS correct,
           count(*) FILTER (k % 2 = 0 AND (NOT merge OR k % 4 = 0) AND k % 3 <> 0) AS false_positives, count(*) FILTER (k % 3 = 0) AS expected FROM (SELECT c_custkey AS k FROM customer), (VALUES (true), (false)) t(merge) GROUP BY merge""")
def m12_duplicate_report(spark, sf_dir):
    k = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    labels = k.select(F.col("k").alias("a"), (-F.col("k") - 1).alias("b"), (F.col("k") % 3 == 0).alias("same"))
    found = k.where("k % 2 = 0").select((-F.col("k") - 1).alias("a"), F.col("k").alias("b"), F.when(F.col("k") % 4 == 0, "exact").otherwise("possible").alias("kind"))
    return metrics.duplicate_report(labels, found).select("kind", "predicted", "correct", "false_positives", "expected")


@query("""
    SELECT count(*) AS spans, count(*) FILTER (doc_id % 5 > 0 OR text[4:4] = text[5:5] AND text[5:5] = text[6:6] AND text[6:6] = text[7:7]) AS valid FROM documents WHERE length(text) > 20""")
def m13_span_validity(spark, sf_dir):
    """Three characters of each text as evidence; those of every fifth are cited a place too far."""
    d = _table(spark, sf_dir, "documents").where(F.length("text") > 20)
    shift = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    e = d.select("text", F.lit(3).alias("start"), F.lit(6).alias("end"), F.substring(F.col("text"), F.lit(4) + shift, F.lit(3)).alias("excerpt"))
    return metrics.span_validity(e).select("spans", "valid")


@query("""
    WITH w AS (SELECT user_id, event_id, event_type, value, props, lag(event_type) OVER o AS t0, lag(value) OVER o AS v0, lag(props) OVER o AS p0, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
         u AS (SELECT event_id, 'event_type' AS field FROM w WHERE n > 1 AND event_type IS DISTINCT FROM t0 UNION ALL SELECT event_id, 'value' FROM w WHERE n > 1 AND value IS DISTINCT FROM v0 UNION ALL SELECT event_id, 'props' FROM w WHERE n > 1 AND props IS DISTINCT FROM p0)
    SELECT field, count(*) AS n_changes, CAST(sum(event_id) AS BIGINT) AS id_sum FROM u GROUP BY field""")
def c1_field_diff(spark, sf_dir):
    """Consecutive events of a user as versions of a record."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    names = ("event_type", "value", "props")
    w = _table(spark, sf_dir, "events").select("event_id", *names, *[F.lag(c).over(o).alias(f"{c}_0") for c in names], F.row_number().over(o).alias("n")).where("n > 1")
    after = w.select(F.col("event_id").alias("id"), *names)
    before = w.select(F.col("event_id").alias("id"), *[F.col(f"{c}_0").alias(c) for c in names])
    found = changes.detect_changes(before, after, F.lit("2026-10-06").cast("timestamp"), names)
    return found.groupBy("field").agg(F.count("*").alias("n_changes"), F.sum("opportunity_id").alias("id_sum"))


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS deadline FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-01-31'""")
def c4_deadline(spark, sf_dir):
    calls = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("deadline"))
    found = changes.deadline_approaching(calls, F.lit("1995-01-01").cast("timestamp"), 30)
    return found.select(F.col("opportunity_id").cast("long").alias("o_orderkey"), F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"))


@query("SELECT lang AS source_id, sha256(text) AS content_hash, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY ALL")
def p1_snapshots(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("lang").alias("source_id"), "text", F.col("source").alias("source_url"), F.lit(None).cast("string").alias("etag"), F.col("doc_id").alias("retrieved_at"))
    return state.document_snapshots(d).select("source_id", "content_hash", "first_seen", "last_seen")


@query("""
    WITH e AS (SELECT DISTINCT 'evt-' || left(sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type), 24) AS event_id, user_id, event_type FROM events)
    SELECT * FROM e WHERE user_id % 2 = 1""")
def p3_event_ids(spark, sf_dir):
    """Ids repeat on replay: a batch of all events adds only those of odd users to a state that holds the others."""
    e = _table(spark, sf_dir, "events").select(parse.hash_id("evt-", 24, F.col("user_id"), F.col("event_type")).alias("event_id"), "user_id", "event_type")
    held = e.where(F.col("user_id") % 2 == 0).dropDuplicates(["event_id"])
    return state.insert_new(held, e, "event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w1_latest(spark, sf_dir):
    return state.latest(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
    WITH e AS (SELECT user_id, event_id, value FROM events), s AS (SELECT *, 0 AS side FROM e WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_id, -value, 1 FROM e WHERE event_id % 3 = 0)
    SELECT user_id, event_id, value FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, side DESC) = 1""")
def p2_upsert(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return state.upsert(e.where(F.col("event_id") % 3 != 0), e.where(F.col("event_id") % 3 == 0).withColumn("value", -F.col("value")), ["user_id"], "event_id")


@query("""
    WITH r AS (SELECT source, lang, CASE WHEN doc_id % 3 > 0 THEN lang END AS c, CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 > 1 THEN 't' END AS t, doc_id % 5 = 0 AS topic, doc_id % 5 = 1 AS tender FROM documents),
         k AS (SELECT source, string_agg(lang || ':' || n, ',' ORDER BY lang) AS types FROM (SELECT source, lang, count(*) AS n FROM r GROUP BY ALL) GROUP BY source)
    SELECT source AS source_id, count(*) AS records, count(c) AS call_ids, count(*) FILTER (t = 't') AS topic_ids, count(*) FILTER (c IS NOT NULL OR t = 't') AS either, count(*) FILTER (topic) AS topic_urls, count(*) FILTER (tender) AS tender_urls, any_value(types) AS types
    FROM r JOIN k USING (source) GROUP BY source""")
def a6_quality(spark, sf_dir):
    k = F.col("doc_id")
    url = F.when(k % 5 == 0, "https://x/TOPIC-details/1").when(k % 5 == 1, "https://x/tender-details/1")
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.when(k % 3 > 0, F.col("lang")).alias("call_id"), F.when(k % 4 == 1, "").when(k % 4 > 1, "t").alias("topic_id"), url.alias("canonical_url"), F.col("lang").alias("opportunity_type"))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return reports.source_quality(d).withColumn("types", types)


@query("""
    WITH r AS (SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang = 'fr' THEN 'unsupported_language' WHEN contains(text, '$$$') THEN 'junk' END AS reason FROM documents)
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def a2_reject_reasons(spark, sf_dir):
    rules = [("too_short", F.col("n_chars") < 100), ("unsupported_language", F.col("lang") == "fr"), ("junk", F.contains("text", F.lit("$$$")))]
    r = constraints.rejected(_table(spark, sf_dir, "documents"), rules)
    return r.where(F.col("reject_reason").isNotNull()).groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@query("""
    WITH k AS (SELECT unnest(json_keys(props)) AS field, props FROM events), t AS (SELECT field, json_type(props, '$."' || field || '"') AS j FROM k)
    SELECT field, CASE j WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS kind, count(*) AS n FROM t GROUP BY ALL""")
def s27_profile(spark, sf_dir):
    from lodestar.sources.records import field_types

    return field_types(_table(spark, sf_dir, "events"), "props").groupBy("field", "kind").agg(F.count("*").alias("n"))


@query()
def s22_visible_text(spark, sf_dir):
    from lodestar.sources.html import visible

    v = visible(_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html"))
    return v.select(F.col("url").cast("long").alias("page_id"), F.length("text").alias("chars"), F.size("anchors").alias("links"))


@query("""
    WITH s AS (SELECT l.doc_id, quality = 1 AS yes, least(1.0, n_chars / 4000.0) AS c FROM labels l JOIN documents d USING (doc_id)),
         t AS (SELECT 0.0 AS t UNION SELECT 1.0 UNION SELECT least(1.0, c + 1e-9) FROM s),
         n AS (SELECT count(*) FILTER (yes) AS ny, count(*) FILTER (NOT yes) AS nn FROM s),
         b AS (SELECT t, 0.5 * (count(*) FILTER (c < t AND NOT yes) / any_value(nn)::DOUBLE + count(*) FILTER (c >= t AND yes) / any_value(ny)::DOUBLE) AS ba FROM t, s, n GROUP BY t)
    SELECT ceil(t * 1000000) / 1000000 AS threshold, round(ba, 9) AS balanced_accuracy FROM b ORDER BY round(ba, 9) DESC, t LIMIT 1""")
def m10_calibrate(spark, sf_dir):
    l, d = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    s = l.join(d, "doc_id").select((F.col("quality") == 1).alias("answerable"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("confidence"))
    out = metrics.calibrate(s)
    return out.select("threshold", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


_HITS_SQL = """
    WITH want AS (SELECT DISTINCT lang AS query_id, doc_id AS item_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
         got AS (SELECT lang AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"""


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    want = d.join(toxic, "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"))
    got = metrics.ranked(d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), "n_chars"), ["query_id"], F.desc("n_chars"), "item_id")
    return want, got


@query(_HITS_SQL + "SELECT query_id, count(*) AS relevant, count(g.item_id) AS retrieved, round(count(g.item_id) / count(*)::DOUBLE, 6) AS score FROM want LEFT JOIN (SELECT * FROM got WHERE rank <= 50) g USING (query_id, item_id) GROUP BY query_id")
def m2_recall(spark, sf_dir):
    return metrics.recall_at_k(*_hits(spark, sf_dir), k=50).withColumn("score", F.round("score", 6))


@query(_HITS_SQL + "SELECT query_id, round(coalesce(1.0 / min(rank), 0), 6) AS rr FROM want LEFT JOIN got USING (query_id, item_id) GROUP BY query_id")
def m9_mrr(spark, sf_dir):
    want, _ = _hits(spark, sf_dir)
    scores = _table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("n_chars").alias("score"))
    return metrics.reciprocal_rank_of_scores(want, scores).withColumn("rr", F.round("rr", 6))


@query("""
    WITH c AS (SELECT c_custkey AS k FROM customer), e AS (SELECT k AS a, k + 1 AS b FROM c WHERE k % 3 = 0), p AS (SELECT least(k + 1, k) AS a, greatest(k + 1, k) AS b FROM c WHERE k % 2 = 0)
    SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e JOIN p USING (a, b)) AS correct,
           round((SELECT count(*) FROM e JOIN p USING (a, b)) / (SELECT count(*) FROM p)::DOUBLE, 6) AS precision, round((SELECT count(*) FROM e JOIN p USING (a, b)) / (SELECT count(*) FROM e)::DOUBLE, 6) AS recall""")
def m3_pairs(spark, sf_dir):
    k = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    e = k.where("k % 3 = 0").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    p = k.where("k % 2 = 0").select((F.col("k") + 1).alias("a"), F.col("k").alias("b"))
    return metrics.pair_scores(e, p).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("""
    WITH x AS (SELECT DISTINCT user_id % 7 AS tenant, event_id AS record_id FROM events WHERE user_id % 2 = 0), o AS (SELECT DISTINCT user_id % 7 AS tenant, event_id AS record_id FROM events WHERE user_id % 2 = 0 OR event_id % 100 = 0)
    SELECT count(DISTINCT tenant) AS tenants, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM x)) AS leaks, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM x)) = 0 AS isolated FROM (SELECT * FROM x UNION ALL SELECT * FROM o)""")
def m6_isolation(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("tenant"), F.col("event_id").alias("record_id"), "user_id")
    return metrics.tenant_isolation(e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 0 OR record_id % 100 = 0").drop("user_id"))


@query("""
    WITH f AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, v) AS segment FROM customer LEFT JOIN f ON k = c_custkey""")
def n24_enrich(spark, sf_dir):
    p = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    facts = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("segment").alias("profile_field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord"))
    return state.enrich(p, facts, ["segment"]).select(F.col("id").alias("c_custkey"), "segment")


@query("SELECT o_orderstatus AS field, count(*) AS available, count(*) FILTER (o_orderkey % 4 = 0) AS correct, count(*) FILTER (o_orderkey % 4 IN (1, 2)) AS wrong, count(*) FILTER (o_orderkey % 4 = 3) AS unknown, round(count(*) FILTER (o_orderkey % 4 = 0) / count(*)::DOUBLE, 6) AS score FROM orders GROUP BY 1")
def m13_field_report(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("field"), (F.col("o_orderkey") % 4).alias("k"), "o_orderpriority")
    e = o.select("id", "field", F.col("o_orderpriority").alias("value"))
    seen = o.select("id", "field", F.when(F.col("k") == 0, F.upper("o_orderpriority")).when(F.col("k") < 3, F.lit("other")).alias("value"))
    return metrics.field_report(e, seen).withColumn("score", F.round("score", 6))


@query("SELECT event_type AS source_id, sha256(props) AS content_hash, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events GROUP BY ALL")
def stream_snapshots(spark, sf_dir):
    from lodestar.streaming.snapshots import run_snapshots

    rows = run_snapshots(spark, f"{sf_dir}/events.parquet", lambda e: e.select(F.col("event_type").alias("source_id"), F.col("props").alias("text"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("etag"), F.col("event_id").alias("retrieved_at")))
    return rows.select("source_id", "content_hash", "first_seen", "last_seen")


@query("SELECT DISTINCT 'evt-' || left(sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type), 24) AS event_id, user_id, event_type FROM events")
def stream_events(spark, sf_dir):
    from lodestar.streaming.snapshots import run_events

    return run_events(spark, f"{sf_dir}/events.parquet", lambda e: e.select(parse.hash_id("evt-", 24, F.col("user_id"), F.col("event_type")).alias("event_id"), "user_id", "event_type"))


@query("""
    WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS b FROM orders)
    SELECT 'opp-' || left(sha256('calls' || chr(0) || k), 24) AS id, p AS title, CASE s WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status, CAST(d AS VARCHAR) AS deadline,
           CAST(b AS DOUBLE) AS budget_total, CASE WHEN o_orderkey % 2 = 0 THEN 'grant' ELSE 'unknown' END AS opportunity_type, CASE WHEN o_orderkey % 3 = 0 THEN p || '/Norte' END AS regions,
           CAST(5 + CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT) AS INTEGER) AS n_evidence, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_rules FROM o""")
def n18_normalize(spark, sf_dir):
    """Orders as source records in JSON; each value must be proven by its span."""
    from lodestar.sources import evidence

    k = F.col("o_orderkey")
    record = F.to_json(F.struct(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "d/M/yyyy").alias("deadlineDate"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("budgetTotal"),
        F.when(F.col("o_orderstatus") == "O", "Open for submission").when(F.col("o_orderstatus") == "F", "31094503").otherwise("?").alias("status"),
        F.when(k % 2 == 0, "Grants").alias("type"), F.when(k % 3 == 0, F.concat("o_orderpriority", F.lit(" | Norte"))).alias("eligibleRegions"),
    ))
    docs = _table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism).select(F.lit("calls").alias("source_id"), F.lit("https://x/search-api/").alias("source_url"), F.lit("t").alias("title"), record.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), F.array().cast("array<string>").alias("links"), F.lit("2026-10-06").cast("timestamp").alias("retrieved_at"))
    n = evidence.normalize(docs)
    day = F.date_format(F.to_utc_timestamp("deadline", F.current_timezone()), "yyyy-MM-dd")
    return n.select("id", "title", "status", day.alias("deadline"), F.col("budget_total").cast("double").alias("budget_total"), "opportunity_type", F.array_join("eligible_regions", "/").alias("regions"), F.size("evidence").alias("n_evidence"), F.size("eligibility_rules").alias("n_rules"))


@query("""
    WITH r AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'missing_stable_id' WHEN c_custkey % 7 = 0 THEN 'missing_supported_title' WHEN c_custkey % 5 = 0 THEN 'unsupported_opportunity_type' WHEN c_custkey % 3 = 0 THEN 'missing_canonical_details_url' END AS reason FROM customer)
    SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM r GROUP BY ALL""")
def s13_call_scan(spark, sf_dir):
    """Customers as rows of API responses, twenty in each."""
    from lodestar.sources import records

    k = F.col("c_custkey")
    row = F.struct(F.when(k % 11 != 0, k.cast("string")).alias("id"), F.when(k % 7 != 0, F.col("c_name")).alias("title"), F.when(k % 5 == 0, "7").otherwise("1").alias("type"), F.when(k % 3 != 0, F.struct(F.array(F.concat(F.lit("C"), k.cast("string"))).alias("esST_programmes"), F.when(k % 11 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("callIdentifier"))).alias("metadata"))
    pages = _table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 20").alias("page")).agg(F.collect_list(row).alias("results"))
    landed = pages.select(F.concat(F.lit("https://api/"), F.col("page").cast("string")).alias("url"), F.to_json(F.struct("results")).alias("body"), F.lit(None).cast("string").alias("last_modified"))
    out = records.scan(landed, "eu_funding_tenders", records.calls, 50)
    return out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, CASE WHEN n IS NOT NULL AND n > 5 THEN 'more_available' WHEN n IS NULL AND o_orderkey % 2 = 0 THEN 'limit_reached_unknown' ELSE 'complete' END AS state FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 END AS n FROM orders)""")
def s11_pagination(spark, sf_dir):
    from lodestar.sources.records import pagination_state

    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", pagination_state(F.when(k % 3 != 0, k % 10), F.lit(5), F.when(k % 2 == 0, 5).otherwise(9)).alias("state"))


@query("""
    SELECT CASE WHEN NOT regexp_matches(url, '^https://[^/?#@]+([/?#]|$)') THEN 'not_https' WHEN strlen(coalesce(html, '')) > 20000 THEN 'too_long' WHEN length(url) > 60 THEN 'long_url' ELSE 'valid' END AS verdict, count(*) AS n FROM pages GROUP BY ALL""")
def v3_constraints(spark, sf_dir):
    u = F.col("url")
    rules = [("not_https", ~constraints.https_url(u)), ("too_long", F.octet_length(F.coalesce("html", F.lit(""))) > 20000), ("long_url", ~constraints.required_text(u, 60))]
    out = constraints.rejected(_table(spark, sf_dir, "pages"), rules)
    return out.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_custkey % 4 <> 0) AS available, count(*) FILTER (c_custkey % 4 IN (1, 2)) AS correct, round(count(*) FILTER (c_custkey % 4 IN (1, 2)) / count(*) FILTER (c_custkey % 4 <> 0)::DOUBLE, 6) AS score FROM customer")
def m1_normalization(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("field"), "c_mktsegment")
    seen = c.select("id", "field", F.when(F.col("id") % 4 == 0, F.lit("")).when(F.col("id") % 4 == 3, F.lit("x")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("value"))
    return metrics.normalization_score(c.withColumnRenamed("c_mktsegment", "value"), seen).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS available, count(*) FILTER (quality = CAST(n_chars > 300 AS INT)) AS correct, round(count(*) FILTER (quality = CAST(n_chars > 300 AS INT)) / count(*)::DOUBLE, 6) AS score FROM labels JOIN documents USING (doc_id)")
def m4_agreement(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("observed"))
    s = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("expected")).join(d, "doc_id")
    return metrics.agreement(s).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS citations, count(p_partkey) AS valid, round(count(p_partkey) / count(*)::DOUBLE, 6) AS score FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 25) ON p_partkey = l_partkey")
def m5_citations(spark, sf_dir):
    known = _table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("evidence_id"))
    return metrics.citation_validity(_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("evidence_id")), known).withColumn("score", F.round("score", 6))


@query("""
    WITH e AS (SELECT DISTINCT o_custkey, o_orderstatus, lower(o_orderpriority) AS v FROM orders), d AS (SELECT DISTINCT o_custkey, o_orderstatus, lower(o_orderpriority) AS v FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT count(*) AS changes, count(*) FILTER (hit) AS detected, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS score FROM (SELECT e.*, EXISTS (SELECT 1 FROM d WHERE d.o_custkey = e.o_custkey AND d.o_orderstatus = e.o_orderstatus AND d.v = e.v) AS hit FROM e)""")
def m8_change_recall(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("call_id"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("new_value"))
    return metrics.change_recall(o, o.where("o_orderkey % 3 <> 0").withColumn("new_value", F.upper("new_value"))).withColumn("score", F.round("score", 6))


@query("""
    WITH s AS (SELECT quality = 1 AS a, n_chars < 600 AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (NOT a) AS no_answer, count(*) FILTER (a) AS ans, count(*) FILTER (b) AS predicted, count(*) FILTER (b AND NOT a) AS tp, count(*) FILTER (b AND a) AS wrong FROM s)
    SELECT no_answer, predicted, tp AS true_positives, round(tp / predicted::DOUBLE, 6) AS precision, round(tp / no_answer::DOUBLE, 6) AS recall, round((no_answer - tp) / no_answer::DOUBLE, 6) AS miss_rate, round(wrong / ans::DOUBLE, 6) AS answerable_abstention_rate FROM c""")
def m11_abstention(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 600).alias("abstained"))
    out = metrics.abstention(_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("answerable")).join(d, "doc_id"))
    return out.select("no_answer", "predicted", "true_positives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "miss_rate", "answerable_abstention_rate")])


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0) AS exact, count(*) FILTER (o_orderkey % 4 = 1) AS possible, count(*) FILTER (o_orderkey % 4 = 2) AS probable, count(*) FILTER (o_orderkey % 4 IN (1, 2)) AS review, count(*) FILTER (o_orderkey % 5 = 0) AS new_snapshots FROM orders")
def a1_discovery(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("exact", "possible", "probable", "none"))), (k % 4 + 1).cast("int"))
    return matching.discovery_counts(_table(spark, sf_dir, "orders").select(kind.alias("kind"), (k % 5 == 0).alias("new_snapshot")))


@query("""
    WITH o AS (SELECT o_orderstatus AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS a, o_orderdate + INTERVAL 10 DAY AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS c FROM orders)
    SELECT source_id, CAST(CAST(min(least(a, b, c)) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(greatest(a, b, c)) AS DATE) AS VARCHAR) AS last_date, CAST(CAST(max(c) AS DATE) AS VARCHAR) AS last_update FROM o GROUP BY 1""")
def a4_date_range(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    later = lambda n: d + F.make_interval(days=F.lit(n))
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source_id"), F.when(k % 2 == 0, d).alias("publication_date"), later(10).alias("opening_date"), F.lit(None).cast("timestamp_ntz").alias("deadline"), F.when(k % 5 == 0, later(40)).alias("source_updated_at"))
    out = reports.date_range(o)
    return out.select("source_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_date", "last_date", "last_update")])


@query("SELECT coalesce(CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END, 'unknown') AS provenance_status, count(*) AS n FROM events GROUP BY 1")
def a5_provenance(spark, sf_dir):
    return reports.provenance_counts(_table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("provenance_status")))


@query("""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 101 END AS a FROM orders)
    SELECT o_orderkey, CASE WHEN a >= 70 THEN 'eligibility/strategic_fit' ELSE 'eligibility' END AS positive, CASE WHEN a < 50 THEN 'strategic_fit' ELSE '' END AS negative FROM o""")
def e8_strengths(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = eligibility.components(F.lit("eligible"), {"strategic_fit": F.when(k % 5 != 0, k % 101)})
    return _table(spark, sf_dir, "orders").select("o_orderkey", eligibility.strengths(parts).alias("s")).select("o_orderkey", F.array_join("s.positive", "/").alias("positive"), F.array_join("s.negative", "/").alias("negative"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, c_name FROM customer")
def n25_merge(spark, sf_dir):
    p = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), "c_name")
    given = p.select("id", F.when(F.col("id") % 3 == 0, F.lit("new")).alias("segment"), F.lit(None).cast("string").alias("c_name"))
    return state.merge_given(p, given).withColumnRenamed("id", "c_custkey")


@query("SELECT count(*) AS dangling, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey % 2 = 0) USING (o_custkey)")
def j13_dangling(spark, sf_dir):
    parents = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    out = state.dangling(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, ["o_custkey"])
    return out.agg(F.count("*").alias("dangling"), F.sum("o_orderkey").alias("keys"))


@query("SELECT event_id, CASE WHEN event_id = 77 AND event_id % 2 = 1 THEN 'now' WHEN event_id % 2 = 0 THEN 'before' END AS delivered_at FROM events")
def p7_delivered(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit("before")).alias("delivered_at"))
    return filters.mark_delivered(filters.mark_delivered(e, 77, F.lit("now")), 78, F.lit("now"))


@query("""
    SELECT e.event_type, c.change_type, count(*) AS n FROM events e, LATERAL (SELECT unnest(CASE WHEN event_type = 'click' THEN ['call_opened', 'important_call_change'] ELSE ['important_call_change'] END) AS change_type) c GROUP BY ALL""")
def c3_notifications(spark, sf_dir):
    """Clicks as calls that open."""
    e = _table(spark, sf_dir, "events").select("event_type", F.explode(changes.notification_types(F.lit("status"), F.when(F.col("event_type") == "click", F.lit('"open"')).otherwise(F.lit('"x"')))).alias("change_type"))
    return e.groupBy("event_type", "change_type").agg(F.count("*").alias("n"))
