import json
from datetime import datetime

from pyspark.sql import functions as F

from lodestar import api
from lodestar.operators import reports
from lodestar.operators.filters import Criteria
from lodestar.sources import landing, records

NOW = datetime(2026, 10, 6)
KIND = "source_id string, source_url string, title string, text string, metadata map<string,string>, links array<string>, retrieved_at timestamp"


def documents(spark, *rows):
    return spark.createDataFrame([(s, "https://x/1", "t", json.dumps(r, indent=2), {"source_family": "eu"}, [], NOW) for s, r in rows], KIND)


def test_discover_and_assess(spark):
    a, b = {"id": "1", "topicCode": "LIFE-1", "title": "Call", "status": "open", "deadline": "2026-11-01", "regions": "Norte"}, {"id": "2", "topicCode": "life 1", "title": "Other"}
    empty = api.evidence.normalize(documents(spark, ("s1", a))).limit(0)
    out = api.discover(documents(spark, ("s1", a), ("s2", b)), empty, F.lit(NOW))
    got = out["opportunities"].collect()
    assert len(got) == 2 and sum(r.duplicate_of is None for r in got) == 1 and {r.duplicate_of for r in got} - {None} <= {r.id for r in got}
    assert out["counts"].first().new_snapshots == 2 and out["notifications"].count() == 2
    state = spark.createDataFrame(got, out["opportunities"].schema)
    again = api.discover(documents(spark, ("s1", a | {"deadline": "2026-12-01"})), state, F.lit(NOW))
    assert [r.field for r in again["changes"].collect() if r.field != "duplicate_of"] == ["deadline"]
    assert api.opportunity_list(state, Criteria(), F.lit(NOW)).count() == 1

    profiles = spark.createDataFrame([("o", "w", "PT", ["norte"])], "id string, workspace_id string, country string, regions array<string>")
    call = next(r.id for r in got if r.source_id == "s1")
    pair = spark.createDataFrame([("o", call, 90)], "organisation_id string, opportunity_id string, strategic_fit int")
    res = api.assess(state, profiles, pair, F.lit(NOW))
    row = res["assessments"].first()
    assert (row.state, row.overall) == ("eligible", 95) and res["events"].count() == 1 and row.strengths.positive == ["eligibility", "strategic_fit"]


def test_source_check(spark):
    body = {"total": 2, "results": [{"id": "1", "topicCode": "A-1", "title": "T", "type": "1", "metadata": {"topicCode": "A-1"}}, {"title": "x"}]}
    scanned = records.scan(spark.createDataFrame([("https://api", json.dumps(body), None)], "url string, body string, last_modified string"), "eu_funding_tenders", records.calls)
    out = api.source_check(scanned)
    assert out["report"].first().rejected == 1 and out["quality"].first().topic_ids == 1 and out["rejected"].count() == 0


def test_organisation_add(spark):
    kind = "id string, workspace_id string, country string"
    p = spark.createDataFrame([("a", "w", "PT")], kind)
    out = api.organisation_add(p, spark.createDataFrame([("a", None, "ES"), ("b", "w", None)], kind))
    assert sorted(map(tuple, out.collect())) == [("a", "w", "ES"), ("b", "w", None)] and api.organisation_show(out, "x", "a").count() == 0


def test_briefs(spark):
    good = {"title": "T", "summary": "S", "requirements": [{"text": "r", "status": "met", "citations": ["ev-1"]}], "deadlines": [], "risks": []}
    rows = [("1", json.dumps(good)), ("2", json.dumps(good | {"risks": [{"text": "x", "citations": ["ev-9"]}]})), ("3", json.dumps(good | {"risks": [{"text": "x", "citations": []}]})), ("4", "no")]
    known = spark.createDataFrame([(i, "ev-1") for i in "1234"], "id string, evidence_id string")
    out = {r.id: r for r in reports.check_briefs(spark.createDataFrame(rows, "id string, payload string"), known).withColumn("md", reports.brief_markdown(F.col("brief"))).collect()}
    assert [out[i].reject_reason for i in "1234"] == [None, "unknown_evidence", "bad_citations", "not_a_brief"]
    page = reports.markdown_to_html(out["1"].md + "\n<script> [a](https://x) [b](http://y)")
    assert "<h1>T</h1>" in page and "<li>r [ev-1]</li>" in page and "&lt;script&gt;" in page and 'href="https://x"' in page and "http://y" not in page


def test_divergence_and_totals(spark):
    kind = "id string, duplicate_of string, deadline timestamp, eligibility_rules array<struct<rule_id:string,evidence_ids:array<string>>>"
    c = spark.createDataFrame([("a", None, NOW, [("r", ["e1"])])], kind)
    v = spark.createDataFrame([("b", "a", None, [("r", ["e2"])])], kind)
    assert [r.field for r in reports.divergence(c, v).collect()] == ["deadline"]
    fetched = spark.createDataFrame([("a", 2, 1, 1, 10, "h", "t", True), ("b", 3, 3, 0, 5, "h", "t", False)], "source_id string, received int, accepted int, rejected int, response_bytes int, payload_sha256 string, source_timestamp string, ok boolean")
    t = reports.fetch_totals(fetched).first()
    assert (t.received, t.bytes, t.hashes, t.timestamp, t.all_succeeded) == (5, 15, ["h"], "t", False)
    assert spark.range(1).select(reports.error_code(F.lit("Read timed out"))).first()[0] == "network_timeout"
    said = {"[Errno 104] Connection reset by peer": "network_connection_reset", "[SSL: CERTIFICATE_VERIFY_FAILED]": "network_tls", "gaierror: [Errno -2] Name or service not known": "network_dns", "[Errno 113] No route to host": "network_os_error_113", "odd": "network_request_failed", "[Errno 111] Connection refused": "network_connection_refused"}
    rows = spark.createDataFrame([(k,) for k in said], "m string").select("m", reports.error_code(F.col("m")).alias("c")).collect()
    assert {r.m: r.c for r in rows} == said
    failed = reports.failures(spark.createDataFrame([("a", 503, "down", None), ("b", 200, "x", None), ("c", None, None, "timed out")], "source_id string, http_status int, body string, error string")).collect()
    assert [(r.source_id, r.error_code, r.http_status, r.response_bytes, r.payload_sha256 is None) for r in failed] == [("a", "http_503", 503, 4, False), ("c", "network_timeout", None, 0, True)]


def test_landing(spark, tmp_path):
    (tmp_path / "1.json").write_text("[]")
    (tmp_path / "2.json").write_text('{"results": []}')
    spark.dataSource.register(landing.Landing)
    rows = spark.read.format("landing").option("path", str(tmp_path)).load()
    assert sorted(r.body for r in rows.collect()) == ["[]", '{"results": []}'] == sorted(r.body for r in landing.landed(spark, str(tmp_path)).collect())
    stream = spark.readStream.format("landing").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("landed").count() == 2
