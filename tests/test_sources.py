import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestar.sources import corpus, evidence, html, records, registry, xlsx

DETAIL = "https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/"


def landed(spark, *bodies):
    return spark.createDataFrame([(f"https://api/{i}", b if isinstance(b, str) else json.dumps(b), None) for i, b in enumerate(bodies)], "url string, body string, last_modified string")


def test_calls(spark):
    good = {"id": "1", "topicCode": "LIFE-1", "title": "A", "url": DETAIL + "LIFE-1"}
    body = {"totalResults": 15, "results": [good, {"title": "x"}, {"id": "2"}, {"id": "3", "title": "t", "type": "7"}, {"id": "4", "title": "t", "url": DETAIL + "OTHER"}, {"id": "5", "title": "t"}]}
    rows = records.scan(landed(spark, body, {"results": "x"}, "{"), "calls", records.calls).collect()
    ok = [r for r in rows if r.reject_reason is None]
    assert len(ok) == 1 and ok[0].metadata["record_id"] == "LIFE-1" and ok[0].metadata["source_pagination_state"] == "more_available" and ok[0].links == [DETAIL + "LIFE-1"]
    assert [r.reject_reason for r in rows if r.reject_reason][:5] == ["missing_stable_id", "missing_supported_title", "unsupported_opportunity_type", "details_identifier_mismatch", "missing_canonical_details_url"]
    report = records.report(records.scan(landed(spark, body), "calls", records.calls)).first()
    assert (report.accepted, report.rejected) == (1, 5) and report.reasons["missing_stable_id"] == 1


def test_notices_and_envelopes(spark):
    body = {"totalNoticeCount": "3", "notices": [{"publication-number": "1-2026", "notice-title": {"fra": "F", "eng": "E"}}, {"notice-title": "x"}, {"publication-number": "2"}]}
    rows = records.scan(landed(spark, body), "notices", records.notices).collect()
    assert rows[0].title == "E" and rows[0].metadata["title_field"] == "notice-title.eng"
    assert [r.reject_reason for r in rows[1:]] == ["missing_publication_number", "missing_supported_title"]
    assert records.unwrap([]) == [] and records.unwrap({"data": {"items": [{}]}}) == [{}]
    for bad in ({"results": "x"}, {"x": []}, {"data": {"x": 1}}, 3):
        with pytest.raises(records.SourceError):
            records.unwrap(bad)
    assert records.total({"total": True, "totalElements": "12"}) == 12 and records.pagination(None, 5, 5) == "limit_reached_unknown"
    flat = records.Flat.of({"id": "a", "content": '{"id": "b", "title": "t", "zzz": 1}', "metadata": {"title": ["m"], "links": ["a", "b"]}})
    assert flat == {"id": "a", "title": "t", "metadata.title": "m", "metadata.links": ["a", "b"]}


def test_field_types(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1], "c": "x", "d": null, "e": true}',), ("[1]",), (None,), ("{",)], "j string")
    assert {(r.field, r.kind) for r in records.field_types(df, "j").collect() if r.field} == {("a", "int"), ("b", "list"), ("c", "str"), ("d", "NoneType"), ("e", "bool")}


def test_nested_profile(spark):
    df = spark.createDataFrame([('{"a": {"b c": 1, "d": null}, "e": [{"f": "x"}, {"g": 1}], "h": [1], "i": {}}',), ("[1]",), (None,), ('{"a": 2.5}',)], "j string")
    found = {(r.field, r.kind) for r in records.profile(df, "j").collect()}
    assert found == {("a", "dict"), ("a", "float"), ("a.b_c", "int"), ("a.d", "NoneType"), ("e", "list"), ("e[].f", "str"), ("h", "list"), ("i", "dict")}
    assert [r.field for r in records.field_names(df, "j").collect()] == ["a", "e", "h", "i"]


def test_details_links():
    good = DETAIL + "LIFE-1"
    record = {"metadata.links": [good, good + "/?tab=1", "https://user@ec.europa.eu" + good[20:], "https://ec.europa.eu:444" + good[20:], 5], "url": good.replace("https", "http"), "link": "https://EC.europa.eu:443" + good[20:]}
    assert records.details_urls(record) == [good, good + "/?tab=1", "https://EC.europa.eu:443" + good[20:]]
    assert records.details_identity(good + "%20x/?a=/topic-details/z") == ("topic", "LIFE-1 x") and records.details_identity("https://x/y") is None
    assert records.total({"total": "1" * 19, "totalSize": 3}) == 3 and records.total({"total": -1}) is None and records.total([]) is None


def workbook(rows, bad=None):
    cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)) + (bad or "") + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_annual_plan(spark):
    head = ["ID", "Designacao do Aviso", "Programa", "NUTS II"]
    data = workbook([["Plan 2026"], head, ["P1", "Água limpa", "Norte 2030", "Norte"], ["", "", "", ""], ["P2", "", "X", ""], ["P3", "Outra", "Centro", "Sul"]])
    rows = xlsx.sheets(spark.createDataFrame([("p", bytearray(data))], "path string, content binary"))
    out = xlsx.annual_plan(rows).orderBy("row").collect()
    assert [(r.reject_reason, json.loads(r.record)["ID"] if r.record else None) for r in out] == [(None, "P1"), ("missing_supported_title", None), (None, "P3")]
    assert [json.loads(r.record)["ID"] for r in xlsx.annual_plan(rows, "agua NORTE").collect()] == ["P1"]
    for broken in (b"x", workbook([], '<row><c r="XFE1"><v>1</v></c></row>'), workbook([], '<row><c r="IW1"><v>1</v></c></row>'), workbook([], '<row><c r="A1" t="s"><v>-1</v></c></row>'), workbook([])):
        with pytest.raises(xlsx.WorkbookError):
            xlsx.rows_of(broken)
    assert xlsx.rows_of(workbook([], '<row><c r="A1" t="s"/><c r="?"><v>9</v></c><c r="B1"><v>1</v></c></row>')) == [["", "1"]]


def test_first_sheet_is_the_one_the_workbook_names_first():
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet(1),
        "xl/worksheets/sheet2.xml": sheet(2),
    }

    def book(**change):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in (parts | change).items():
                z.writestr(name, text)
        return out.getvalue()

    assert xlsx.rows_of(book()) == [["2"]]
    hidden = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE x [<!ENTITY e "5">]>' + sheet("&e;")
    for wrong in (hidden.encode("utf-16"), hidden.replace("UTF-16", "UTF-8")):
        with pytest.raises(xlsx.WorkbookError):
            xlsx.rows_of(book(**{"xl/worksheets/sheet2.xml": wrong}))
    with pytest.raises(xlsx.WorkbookError):
        xlsx.rows_of(book(**{"xl/_rels/workbook.xml.rels": parts["xl/_rels/workbook.xml.rels"].replace("worksheets/sheet2", "../other/sheet2")}))


def test_broken_workbooks_are_rows(spark):
    good = workbook([["Número do Aviso", "Designação", "Programa", "Fundo", "Nota"], ["1", "T", "P", "F", "n"]])
    files = [("a", good), ("b", b"x"), ("c", workbook([["ID", "Nome"], ["1", "2"]])), ("d", workbook([["ID", "Designação", "Programa", "id"], ["1", "2", "3", "4"]]))]
    out = xlsx.annual_plan(xlsx.sheets(spark.createDataFrame([(p, bytearray(d)) for p, d in files], "path string, content binary")))
    rows = {r.path: r for r in out.collect()}
    assert json.loads(rows["a"].record) == {"Número do Aviso": "1", "Designação": "T", "Programa": "P", "Fundo": "F"}
    assert {p: r.reject_reason for p, r in rows.items()} == {"a": None, "b": "error: not a workbook", "c": "missing_required_header", "d": "duplicate_headers"}


def test_html(spark):
    page = '<h1>T &amp; x</h1><p>Hello<br>there</p><a href="/d1">Standard Action Projects (SAPs) A</a> Deadline date: 5 October 2026 <a href="https://bad.org/">Standard Action Projects (SAPs) B</a> Deadline date: 6 October 2026 <a href="/d3">Standard Action Projects (SAPs) C</a>'
    listings = spark.createDataFrame([("https://cinea.ec.europa.eu/l", page)], "url string, html string")
    seen = html.visible(listings).first()
    assert seen.text.startswith("T & x\nHello\nthere\n") and seen.headings[0].text == "T & x" and seen.text[seen.anchors[0].start : seen.anchors[0].end] == seen.anchors[0].text
    body = "<h1>Name</h1>" + "".join(f"<p>{k}</p><p>{v}</p>" for k, v in {"Reference": "LIFE-2026-A", "Funding programme": "Programme (LIFE) (2021/2027)", "Status": "Open", "Opening date": "1 May 2026", "Deadline date": "5 October 2026 17:00 (CEST)"}.items()) + '<a href="https://ec.europa.eu/x/opportunities/topic-details/LIFE-2026-A">t</a>'
    details = spark.createDataFrame([("https://cinea.ec.europa.eu/d1", body)], "url string, html string")
    rows = html.listing_documents(listings, details).orderBy("place").collect()
    assert [r.reject_reason for r in rows] == [None, "invalid_detail_url", "missing_listing_deadline"]
    record = json.loads(rows[0].record)
    assert record["deadlineDate"] == "2026-10-05T17:00:00+02:00" and record["programme"] == "LIFE" and record["identifierConflict"] is False
    assert html.official_link("https://cinea.ec.europa.eu/", "https://x.safelinks.protection.outlook.com/?url=https%3A%2F%2Fec.europa.eu%2Fa") == "https://ec.europa.eu/a"
    assert html.official_link("https://cinea.ec.europa.eu/", "http://ec.europa.eu/a") is None


def test_normalize(spark):
    text = json.dumps({"id": "9", "topicCode": "LIFE-2026-X", "title": "Call é", "status": "31094502", "deadlineDate": "2026-12-01", "type": "1", "trlMin": 3, "aidIntensity": "1,5", "eligibleRegions": "Norte | Centro", "url": "u", "eligibilityRules": [{"ruleId": "a", "profileField": "country", "operator": "in", "expected": ["PT"], "reason": "r"}, {"bad": 1}]}, ensure_ascii=False, indent=2)
    kind = "source_id string, source_url string, title string, text string, metadata map<string,string>, links array<string>, retrieved_at timestamp"
    docs = spark.createDataFrame([("eu_funding_tenders", DETAIL + "LIFE-2026-X", "doc", text, {"source_family": "eu"}, [], datetime(2026, 10, 6)), ("other", "https://x", "doc", "plain", {"title": "plain", "programme": "gone"}, [], datetime(2026, 10, 6))], kind)
    out = {r.source_id: r for r in evidence.normalize(docs).collect()}
    a, b = out["eu_funding_tenders"], out["other"]
    assert (a.call_id, a.topic_id, a.status, a.opportunity_type, a.trl_min, a.aid_intensity, a.eligible_regions) == ("LIFE-2026-X", "LIFE-2026-X", "open", "grant", 3, None, ["Norte", "Centro"])
    assert [r.profile_field for r in a.eligibility_rules] == ["country", "__unsupported__", "regions"] and a.source_family == "eu"
    assert b.title == "plain" and b.programme is None and b.canonical_url is None
    spans = evidence.evidence_of(evidence.located(docs)).collect()
    assert {s.evidence_id for s in spans if s.source_id == 'eu_funding_tenders'} == set(a.evidence)
    assert spans and all(text[s.start : s.end] == s.excerpt for s in spans if s.source_id == "eu_funding_tenders")


SOURCE = {
    "source_id": "cinea", "name": "Agency", "status": "active", "authority": "A", "jurisdiction": "direct_eu", "official": True, "base_url": "https://cinea.ec.europa.eu/x", "discovery_method": "html", "content_types": ["text/html"],
    "opportunity_types": ["grant"], "check_cadence": "weekly", "enabled": True, "priority": 1, "legal_notes": "n", "last_verified": "2026-01-02", "adapter": "cinea_life_html", "source_family": "eu", "source_role": "publisher", "snapshot_policy": "bounded_normalized",
}


def test_registry(spark, tmp_path):
    path = tmp_path / "r.json"
    write = lambda *sources, **more: path.write_text(json.dumps({"version": 1, "default_cadence": "weekly", "sources": list(sources)} | more))
    write(SOURCE, SOURCE | {"source_id": "x", "enabled": False, "last_verified": None, "status": "pending_policy"})
    reg = registry.load(spark, str(path))
    assert registry.active(reg).count() == 1 and {r.legal_status for r in reg.collect()} == {"policy_unverified"}
    docs = spark.createDataFrame([("cinea_life",), ("none",)], "source_id string")
    assert {r.source_id: (r.source_family, r.snapshot_policy) for r in registry.with_context(docs, reg).collect()} == {"cinea_life": ("eu", "bounded_normalized"), "none": (None, None)}
    kept = spark.createDataFrame([("a", "bounded_normalized"), ("a" * 16385, "bounded_normalized"), ("a", "hash_and_excerpt"), ("a", None)], "t string, p string")
    assert [r.s is not None for r in kept.select(records.snapshot(F.col("t"), F.col("p")).alias("s")).collect()] == [True, False, False, False]
    for change in ({"last_verified": "2026-13-01"}, {"surprise": 1}, {"priority": 6}, {"base_url": "http://x"}, {"last_verified": None}, {"source_role": "agency"}, {"content_types": [""]}, {"commercial_redistribution": True}):
        write(SOURCE | change)
        with pytest.raises(ValueError):
            registry.load(spark, str(path))
    for more in ({"sources": [SOURCE, SOURCE]}, {"version": 2}, {"default_cadence": "hourly"}, {"sources": None}):
        write(**more)
        with pytest.raises(ValueError):
            registry.load(spark, str(path))


def test_notice_request():
    assert records.notice_request(" ", 5, date(2026, 10, 6))["query"] == "publication-date >= 20251006"
    assert records.notice_request("x = 1", 5, date(2026, 10, 6))["query"] == "x = 1"
    with pytest.raises(ValueError):
        records.notice_request("x" * 501, 5, date(2026, 10, 6))


def test_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\n\nBody é")
    (tmp_path / ".git" / "y.md").write_text("no")
    (tmp_path / "z.csv").write_text("no")
    rows = corpus.load(spark, str(tmp_path)).collect()
    assert [(r.source, r.text) for r in rows] == [("a/x.md", "# T\n\nBody é")]


def test_corpus_raises_beyond_its_bounds(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name}.md").write_text("x" * 10)
    assert corpus.load(spark, str(tmp_path)).count() == 3
    with pytest.raises(corpus.CorpusError, match="files"):
        corpus.load(spark, str(tmp_path), most_files=2)
    for bound, word in (("MOST_BYTES", "bytes"), ("MOST_CHARACTERS", "characters")):
        with monkeypatch.context() as m:
            m.setattr(corpus, bound, 9)
            with pytest.raises(corpus.CorpusError, match=word):
                corpus.load(spark, str(tmp_path))


def test_corpus_reads_pdf_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.md").write_text("B")
    monkeypatch.setattr(corpus, "pdf_text", lambda files: files.selectExpr("path AS source", "'A' AS text"))
    assert [(r.source, r.text) for r in corpus.load(spark, str(tmp_path)).collect()] == [("a.pdf", "A"), ("b.md", "B")]
