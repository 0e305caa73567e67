import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import changes, constraints, eligibility, filters, matching, metrics, retrieval, state

NOW = datetime(2026, 10, 6)


def call(spark, **change):
    row = {"opportunity_type": "grant", "geography": ["Portugal"], "eligible_regions": ["Norte"], "eligible_applicant_types": ["SME"], "eligible_sectors": ["Manufacturing"], "funding_max": 500000.0, "deadline": NOW + timedelta(days=20)} | change
    return spark.createDataFrame([tuple(row.values())], "opportunity_type string, geography array<string>, eligible_regions array<string>, eligible_applicant_types array<string>, eligible_sectors array<string>, funding_max double, deadline timestamp")


@pytest.mark.parametrize(
    ("change", "criteria", "state_", "reasons"),
    [
        ({}, {"opportunity_types": ("grant",), "regions": (" NORTE ",), "minimum_funding": 1000, "deadline_window_days": 30}, "included", []),
        ({"eligible_regions": None, "deadline": None}, {"regions": ("Norte",), "deadline_window_days": 30}, "needs_review", ["region_unknown", "deadline_unknown"]),
        ({"eligible_regions": []}, {"regions": ("Norte",)}, "excluded", ["region_mismatch"]),
        ({"opportunity_type": "loan"}, {"opportunity_types": ("grant",), "excluded_types": ("loan",)}, "excluded", ["type_mismatch", "type_excluded"]),
        ({"opportunity_type": "unknown"}, {"excluded_types": ("loan",)}, "needs_review", ["type_maybe_excluded"]),
        ({}, {"deadline_window_days": 10}, "excluded", ["deadline_outside_window"]),
        ({}, {"profile": {"sectors": ("Energy",)}}, "excluded", ["sector_mismatch"]),
    ],
)
def test_filter(spark, change, criteria, state_, reasons):
    r = filters.filter_opportunities(call(spark, **change), filters.Criteria(**criteria), F.lit(NOW)).first()
    assert (r.state, r.reasons) == (state_, reasons)


def verdict(spark, operator, actual, expected):
    return spark.range(1).select(eligibility.matches(F.lit(operator), actual, expected)).first()[0]


def test_rules(spark):
    V, s = eligibility.value, lambda x: eligibility.value("str", string=F.lit(x))
    n, a = lambda x: V("num", number=F.lit(x)), lambda *x: V("arr", array=F.array(*map(F.lit, x)))
    none = V()
    assert verdict(spark, "in", s("pt"), a("PT", "ES")) is True and verdict(spark, "in", s("fr"), a("PT")) is False and verdict(spark, "in", none, a("PT")) is None
    assert verdict(spark, "in", n(1), a("1")) is None and verdict(spark, "equals", a("x"), s("x")) is None
    assert verdict(spark, "minimum", n(0.15), n(0.2)) is False and verdict(spark, "maximum", n(1), s("2")) is True and verdict(spark, "minimum", n(1), s("x")) is None
    assert verdict(spark, "present", n(0), none) is True and verdict(spark, "present", s(""), none) is False and verdict(spark, "present", none, none) is None


def test_fit(spark):
    score = lambda st, sig, w=None: spark.range(1).select(eligibility.fit_score(F.lit(st), {k: F.lit(v) for k, v in sig.items()}, w)).first()[0]
    assert score("eligible", {"strategic_fit": 80, "evidence_completeness": 50}, {"eligibility": 0.25, "strategic_fit": 0.5, "evidence_completeness": 0.0}) == 87
    assert score("eligible", {}) is None and score("ineligible", {"maturity": 90}) is None
    assert score("eligible", {"maturity": 90}, {"maturity": 0.0}) is None
    with pytest.raises(ValueError):
        eligibility.check_weights({"maturity": 2})


def records(spark, *rows):
    names = matching.COLUMNS
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {'timestamp' if n in ('deadline', 'opening_date') else 'string'}" for n in names))


URL = "https://ec.europa.eu/portal/topic-details/"


@pytest.mark.parametrize(
    ("a", "b", "kind"),
    [
        ({"topic_id": "LIFE-1"}, {"topic_id": "life 1"}, "exact"),
        ({"call_id": "C1", "canonical_url": URL + "a"}, {"call_id": "C1", "canonical_url": URL + "b"}, "none"),
        ({"topic_id": "T", "canonical_url": URL + "a"}, {"topic_id": "T", "canonical_url": URL + "b"}, "none"),
        ({"canonical_url": "https://x.org/a/?utm_source=1"}, {"canonical_url": "https://X.org/a"}, "exact"),
        ({"programme": "LIFE", "title": "Clean water for all regions", "authority": "A"}, {"programme": "Life", "title": "Clean water for regions all", "authority": "a"}, "possible"),
        ({"programme": "L", "title": "t w", "authority": "A", "call_id": "1"}, {"programme": "L", "title": "t w", "authority": "A", "call_id": "2"}, "none"),
        ({"call_id": "1", "canonical_url": "https://x.org/a"}, {"call_id": "2", "canonical_url": "https://x.org/a"}, "none"),
        ({"programme": "L", "title": "t w", "source_family": "f", "source_id": "s1", "canonical_source": "s2"}, {"programme": "L", "title": "t w", "source_family": "f", "source_id": "s2"}, "probable"),
        ({"programme": "L", "title": "t w", "authority": "A", "deadline": NOW}, {"programme": "L", "title": "t w", "authority": "A", "deadline": NOW + timedelta(days=365)}, "none"),
    ],
)
def test_duplicates(spark, a, b, kind):
    r = matching.find_duplicates(records(spark, {"id": "new"} | a), records(spark, {"id": "old"} | b)).first()
    assert r.kind == kind and r.canonical_id == ("old" if kind == "exact" else None)


def test_incremental_vetoes_are_not_transitive(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    # b is a duplicate of a, so c, which matches b only, is canonical
    assert dict(map(tuple, matching.incremental(edges, nodes).collect())) == {"a": None, "b": "a", "c": None}


def test_changes(spark):
    kind = "id string, status string, deadline timestamp, documents array<string>, budget_total double, source_retrieved_at timestamp"
    old = spark.createDataFrame([("x", "open", NOW, ["a"], None, NOW)], kind)
    new = spark.createDataFrame([("x", "closed", NOW + timedelta(days=10), ["a", "b"], None, NOW + timedelta(days=1))], kind)
    found = changes.detect_changes(old, new, F.lit(NOW))
    assert {r.field for r in found.collect()} == {"status", "deadline", "documents"}
    assert {r.event_type for r in changes.notifications(found).collect()} == {"call_closed", "important_call_change"}
    assert changes.detect_changes(old, old.withColumn("source_retrieved_at", F.lit(NOW + timedelta(days=1))), F.lit(NOW)).count() == 0
    near = new.withColumn("status", F.lit("open")).withColumn("deadline", F.lit(NOW + timedelta(days=2)))
    assert changes.deadline_approaching(near, F.lit(NOW), 7).count() == 1 and changes.deadline_approaching(near, F.lit(NOW), 1).count() == 0


def test_state_is_idempotent(spark):
    doc = spark.createDataFrame([("s", "t", "u1", None, 1), ("s", "t", "u2", "e", 2), ("s", "t2", "u", None, 3)], "source_id string, text string, source_url string, etag string, retrieved_at long")
    once, twice = state.document_snapshots(doc), state.document_snapshots(doc.union(doc))
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 2
    kind = "id string, status string, source_retrieved_at timestamp"
    base, batch = spark.createDataFrame([("a", "open", NOW)], kind), spark.createDataFrame([("a", "closed", NOW), ("b", "open", NOW)], kind)
    out = state.save_opportunities(base, batch, F.lit(NOW))
    assert out["opportunities"].count() == 2 and out["snapshots"].count() == 2 and out["changes"].count() == 1 and out["notifications"].count() == 3
    again = state.save_opportunities(out["opportunities"], batch, F.lit(NOW))
    assert again["changes"].count() == 0 and again["snapshots"].count() == 0


def test_enrichment_fills_only_unknown(spark):
    p = spark.createDataFrame([("a", None, "PT"), ("b", "B", None)], "id string, legal_name string, country string")
    f = spark.createDataFrame([("a", "legal_name", "New", 1), ("a", "legal_name", "Later", 2), ("b", "legal_name", "X", 1)], "id string, profile_field string, value string, ord int")
    assert sorted(map(tuple, state.enrich(p, f, ["legal_name", "country"]).collect())) == [("a", "New", "PT"), ("b", "B", None)]


DOCUMENTS = {
    "pt_sme_rd": "Financiamento para pequenas e médias empresas em investigação e desenvolvimento experimental.",
    "pt_sme_innovation": "## Pequenas e médias empresas\n\nApoio à inovação para entidades com projetos de valorização tecnológica.",
    "pt_sme_research": "São apoiadas PME com projetos de investigação e desenvolvimento colaborativo.",
    "pt_large_research": "Financiamento para grandes empresas em investigação industrial.",
    "pt_training": "Formação profissional para pequenas e médias empresas.",
    "en_university": "Research funding for universities and public research organisations.",
    "pt_energy": "Incentivos à eficiência energética em edifícios públicos.",
    "pt_tender": "Concurso público para aquisição de equipamento informático.",
}
ASKED = [("SME research funding", "pt_sme_rd"), ("PME inovação", "pt_sme_innovation"), ("small and medium enterprises R&D grants", "pt_sme_research")]


def test_retrieval_recall(spark):
    docs = spark.createDataFrame([(k, v) for k, v in DOCUMENTS.items()], "source string, text string")
    rows = retrieval.passages(docs).cache()
    assert rows.where("source = 'pt_sme_innovation'").first().section == "Pequenas e médias empresas"
    hits = {q: [r.source for r in retrieval.search(rows, q, 5, section="section", stem="stem").collect()] for q, _ in ASKED}
    assert all(want in hits[q] for q, want in ASKED)
    best = retrieval.snippets(retrieval.search(rows, "funding", 1, section="section"), "funding").first()
    assert best.excerpt == DOCUMENTS[best.source][best.start : best.end] and best.evidence_id.startswith("ev-")
    with pytest.raises(ValueError):
        retrieval.search(rows, "the of", 3).collect()


def test_plain_ranker_recall(spark):
    """Without synonyms and spellings only one of the three queries finds its document."""
    docs = spark.createDataFrame(list(DOCUMENTS.items()), "doc_id string, text string")
    queries = spark.createDataFrame([(str(i), q) for i, (q, _) in enumerate(ASKED)], "query_id string, text string")
    want = spark.createDataFrame([(str(i), d) for i, (_, d) in enumerate(ASKED)], "query_id string, item_id string")
    got = retrieval.rank_many(docs, queries).withColumnRenamed("doc_id", "item_id")
    scores = [r.score for r in metrics.recall_at_k(want, got).collect()]
    assert round(sum(scores) / 3, 4) == 0.3333


def test_passages_and_decision(spark):
    assert retrieval.split_passages("# H\n\nfoo\nbar\n\nx") == [(1, 0, 12, "H"), (6, 14, 15, "H")]
    best = spark.createDataFrame([(0, 4.0, 1.0), (1, None, None), (2, 0.1, 0.1)], "q int, score double, coverage double")
    out = {r.q: (r.status, round(r.confidence, 4)) for r in retrieval.decisions(best).collect()}
    assert out[0] == ("supported", 0.9) and out[1] == ("no_supported_result", 0.0) and out[2][0] == "no_supported_result"


def test_metrics_on_nothing(spark):
    empty = spark.createDataFrame([], "a string, b string")
    r = metrics.pair_scores(empty, empty).first()
    assert r.precision is None and r.recall is None
    some = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    assert metrics.pair_scores(some, some).first().correct == 1
    labels = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.85, False)], "confidence double, answerable boolean")
    r = metrics.calibrate(labels).first()
    assert r.balanced_accuracy == 0.75 and abs(r.threshold - 0.100001) < 1e-9


def test_constraints(spark):
    df = spark.createDataFrame([("https://a.org/x", 5), ("http://a.org", -1), ("https://u@a.org", None), (None, 3)], "url string, n int")
    out = [(r.u, r.n) for r in df.select(constraints.https_url(F.col("url")).alias("u"), constraints.not_negative(F.col("n"), 4).alias("n")).collect()]
    assert out == [(True, False), (False, False), (False, True), (False, True)]
    with pytest.raises(ValueError):
        constraints.query_args("x", True)


RECORD = "id string, source_id string, canonical_url string, topic_id string, call_id string, programme string, title string, authority string, deadline timestamp, opening_date timestamp, source_family string, canonical_source string"


def some_records(n, seed):
    """Records of few values each, so that vetoes, nulls and ties are common; a third share a title and an address."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None])
    out = []
    for i in rng.sample(range(1000), n):
        common = rng.random() < 0.33
        url = "https://a.eu/x?utm_a=1" if common else pick("https://a.eu/x", "https://a.eu/topic-details/T1", "https://A.eu/topic-details/t2/", "https://b.eu/y")
        title = "One two three four five" if common else pick("One two three four five", "one two three four six", "Two one, three four five six", "other words", "")
        out.append((f"r{i:04}", rng.choice(["s1", "s2"]), url, pick("T-1", "t 1", "T2", ""), pick("c1", "C-1", "c2"), pick("P", "p", "q"), title, pick("A", "a", "B"), pick(datetime(2026, 1, 1), datetime(2026, 1, 2)), pick(datetime(2025, 1, 1)), pick("f"), pick("s1", "s2")))
    return [dict(zip([f.split()[0] for f in RECORD.split(", ")], r)) for r in out]


def plain_match(a, b):
    """What a pair is by the rules, one after another: kind and reasons."""
    text = lambda x: " ".join(re.findall("[a-z0-9]+", x.lower()))
    site = lambda x: x and "/".join([x.split("/")[2].lower(), *x.split("/")[3:]]).split("?")[0].rstrip("/")
    ua, ub = site(a["canonical_url"]), site(b["canonical_url"])
    both = lambda n: bool(a[n]) and bool(b[n])
    topic = lambda u: u is not None and "/topic-details/" in u.lower()
    if topic(a["canonical_url"]) and topic(b["canonical_url"]) and ua != ub or both("topic_id") and text(a["topic_id"]) != text(b["topic_id"]):
        return None
    same = both("topic_id")
    calls = both("call_id") and text(a["call_id"]) != text(b["call_id"])
    if same or not calls:
        by = ["canonical_url"] * (ua is not None and ua == ub) + ["topic_id"] * same
        if by:
            return "exact", by
    if calls or any(a[n] is None or b[n] is None for n in ("programme", "title")) or text(a["programme"]) != text(b["programme"]):
        return None
    if any(both(n) and a[n] != b[n] for n in ("deadline", "opening_date")):
        return None
    x, y = ({w for w in text(r["title"]).split()} for r in (a, b))
    if not x or not y or len(x & y) / len(x | y) < 0.8:
        return None
    related = a["source_family"] is not None and a["source_family"] == b["source_family"] and (a["canonical_source"] == b["source_id"] or b["canonical_source"] == a["source_id"])
    if not related and not (a["authority"] is not None and b["authority"] is not None and text(a["authority"]) == text(b["authority"])):
        return None
    by = ["programme", "normalized_title_context"] + [n for n in ("deadline", "opening_date") if both(n)]
    return ("probable", [*by, "known_source_relationship"]) if related else ("possible", by)


def plain_best(a, known):
    found = sorted((("exact", "probable", "possible").index(m[0]), b["id"], m) for b in known if b["id"] != a["id"] and (m := plain_match(a, b)))
    return ("none", None, []) if not found else (found[0][2][0], found[0][1] if found[0][0] == 0 else None, found[0][2][1])


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_match_plain_pairs(spark, seed):
    new, known = some_records(60, seed), some_records(60, seed + 50)
    df = lambda x: spark.createDataFrame([tuple(r.values()) for r in x], RECORD)
    got = {r.candidate: (r.kind, r.canonical_id, r.matched_by) for r in matching.find_duplicates(df(new), df(known)).collect()}
    assert got == {r["id"]: plain_best(r, known) for r in new}
    # a batch sees its own earlier canonical records, too
    seen, want = list(known), {}
    for r in sorted(new, key=lambda r: r["id"]):
        want[r["id"]] = plain_best(r, seen)
        if want[r["id"]][0] != "exact":
            seen.append(r)
    got = {r.candidate: (r.kind, r.canonical_id, r.matched_by) for r in matching.discover_duplicates(df(new), df(known)).collect()}
    assert got == want
    assert {k for k, _, _ in want.values()} >= {"exact", "none"}


def test_incremental_settles_chains(spark):
    """A chain: each record matches the one before; every other one is canonical."""
    nodes = spark.range(12).select(F.col("id").cast("string").alias("id"))
    edges = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(10)] + [("00", "09")], "a string, b string")
    out = {r.id: r.canonical_id for r in matching.incremental(edges, spark.createDataFrame([(f"{i:02}",) for i in range(12)], "id string")).collect()}
    assert out == {f"{i:02}": f"{i - 1:02}" if i % 2 and i < 11 else None for i in range(12)} | {"09": "00"} and nodes.count() == 12
