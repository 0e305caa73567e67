"""The data sources against a server of the standard library."""

import hashlib
import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlparse

import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.operators import reports
from lodestar.sources import evidence, fetch
from tests.test_sources import DETAIL, workbook

LISTING = "https://cinea.ec.europa.eu/life-calls-proposals-2026_en"
DETAIL_PAGE = "<h1>Name</h1>" + "".join(f"<p>{k}</p><p>{v}</p>" for k, v in {"Reference": "LIFE-2026-A", "Funding programme": "Programme (LIFE) (2021/2027)", "Status": "Open", "Opening date": "1 May 2026", "Deadline date": "5 October 2026 17:00 (CEST)"}.items()) + '<a href="https://ec.europa.eu/x/opportunities/topic-details/LIFE-2026-A">t</a>'
LIST_PAGE = '<a href="/d1">Standard Action Projects (SAPs) A</a> Deadline date: 5 October 2026 <a href="https://bad.org/">Standard Action Projects (SAPs) B</a> Deadline date: 6 October 2026'
BOOK = workbook([["Plan"], ["ID", "Designação", "Programa"], ["P1", "Água limpa", "Norte 2030"], ["P2", "", "X"], ["P3", "Outra", "Centro"]])


class Server(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, body, kind="application/json", **headers):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        try:
            self.wfile.write(body)
        except ConnectionError:
            pass

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        at = urlparse(self.path)
        Server.seen.append((at.path, parse_qs(at.query), self.headers["Content-Type"], body))
        if at.path == "/notices":
            page, limit = (json.loads(body)[k] for k in ("page", "limit"))
            rows = [{"publication-number": f"{n}-2026", "notice-title": f"Notice {n}"} for n in range((page - 1) * limit, min(page * limit, 7))]
            self.answer(200, json.dumps({"totalNoticeCount": 7, "notices": rows}).encode(), Last_Modified="Mon, 05 Oct 2026 10:00:00 GMT")
        elif at.path == "/calls":
            self.answer(200, json.dumps({"results": [{"id": "1", "topicCode": "LIFE-1", "title": "A", "url": DETAIL + "LIFE-1"}, {"title": "x"}]}).encode())
        elif at.path == "/gone":
            self.answer(404, b"not here")
        elif at.path == "/broken":
            self.answer(200, b"{")
        elif at.path == "/large":
            self.answer(200, b" " * (fetch.MOST_BYTES + 10))

    def do_GET(self):
        if self.path == "/away":
            self.answer(302, b"", Location="http://localhost:1/elsewhere")
        elif self.path == "/near":
            self.answer(302, b"", Location="/list")
        elif self.path == "/book":
            self.answer(200, BOOK, fetch.WORKBOOK)
        else:
            self.answer(200, b"{}" if self.path == "/json" else LIST_PAGE.encode(), "application/json" if self.path == "/json" else "text/html; charset=utf-8")


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_pages_of_an_api_are_partitions(spark, server):
    rows = fetch.load(spark, evidence.NOTICES, "water", 3, pages=3, endpoint=f"{server}/notices", plain=True)
    assert rows.rdd.getNumPartitions() == 3
    got = sorted(rows.collect(), key=lambda r: r.request)
    assert [(r.request, r.http_status, r.error, r.last_modified, r.provenance) for r in got] == [(n, 200, None, "Mon, 05 Oct 2026 10:00:00 GMT", fetch.LIVE) for n in (1, 2, 3)]
    assert all(r.payload_sha256 == hashlib.sha256(bytes(r.body)).hexdigest() and r.response_bytes == len(r.body) for r in got)
    docs = fetch.documents(rows, evidence.NOTICES, 3).collect()
    assert sorted(d.metadata["record_id"] for d in docs) == [f"{n}-2026" for n in range(7)] and {d.metadata["source_total_results"] for d in docs} == {"7"}
    said = [json.loads(b) for p, _, _, b in Server.seen if p == "/notices"]
    assert {s["query"] for s in said} == {"water"} and all(s["limit"] == 3 and s["fields"] for s in said)


def test_calls_post_a_form(spark, server):
    rows = fetch.load(spark, evidence.CALLS, "", 5, api_key="k1", endpoint=f"{server}/calls", plain=True)
    docs = fetch.documents(rows, evidence.CALLS, 5).collect()
    assert sorted((d.reject_reason or "", d.title or "") for d in docs) == [("", "A"), ("missing_stable_id", "")]
    _, asked, kind, body = [s for s in Server.seen if s[0] == "/calls"][-1]
    assert asked == {"apiKey": ["k1"], "text": ["***"], "pageSize": ["5"], "pageNumber": ["1"], "language": ["en"]}
    boundary = kind.split("boundary=")[1]
    parts = body.split(f"--{boundary}".encode())
    assert len(parts) == 3 and parts[2].strip() == b"--" and b'name="query"' in parts[1]
    assert json.loads(parts[1].split(b"\r\n\r\n", 1)[1])["bool"]["must"][0] == {"terms": {"type": ["0", "1", "2", "8"]}}


@pytest.mark.parametrize(("source", "path", "error"), [(evidence.NOTICES, "/gone", "status 404"), (evidence.NOTICES, "/large", "response_too_large"), (evidence.AGENCY, "/json", "unexpected_content_type"), (evidence.AGENCY, "/away", "outside the source's own host")])
def test_failures_are_rows(spark, server, source, path, error):
    rows = fetch.load(spark, source, endpoint=server + path, plain=True)
    r = rows.first()
    assert error in r.error and r.body is None and fetch.documents(rows, source).first().reject_reason.startswith("error: ")
    if path == "/gone":
        assert (r.http_status, r.payload_sha256, r.response_bytes) == (404, hashlib.sha256(b"not here").hexdigest(), 8)
        assert reports.failures(rows).first().error_code == "http_404"
    if path == "/large":
        assert r.response_bytes == fetch.MOST_BYTES + 1 and r.payload_sha256 is None
    with pytest.raises(Exception, match=error.split()[-1]):
        fetch.load(spark, source, endpoint=server + path, plain=True, strict=True).collect()


def test_refused_and_broken(spark, server):
    refused = fetch.load(spark, evidence.NOTICES, endpoint="http://127.0.0.1:9/x", plain=True)
    assert reports.failures(refused).first().error_code == "network_connection_refused"
    broken = fetch.load(spark, evidence.NOTICES, endpoint=f"{server}/broken", plain=True)
    assert fetch.documents(broken, evidence.NOTICES).first().reject_reason == "error: invalid_json"


def test_own_host_only(spark, server):
    near = fetch.load(spark, evidence.AGENCY, endpoint=f"{server}/near", plain=True).first()
    assert near.error is None and near.url.endswith("/list")
    request = fetch.Request(1, "", host="portugal2030.pt")
    for bad in ("http://portugal2030.pt/x", "https://portugal2030.pt:8443/x", "https://u@portugal2030.pt/x", "https://portugal2030.pt.evil.org/x"):
        with pytest.raises(fetch.FetchError):
            fetch.check_host(bad, request)
    fetch.check_host("https://portugal2030.pt:443/x", request)
    # without plain, the server's own address is refused before anything is sent
    assert "own host" in fetch.load(spark, evidence.AGENCY, endpoint=f"{server}/list").first().error


@pytest.mark.parametrize("options", [{"limit": 0}, {"limit": 101}, {"timeout": 0}, {"timeout": 121}, {"pages": 0}, {"api_key": "x" * 101}, {"query": "x" * 501}])
def test_arguments(spark, options):
    with pytest.raises(Exception, match="must"):
        fetch.load(spark, evidence.CALLS, **options).collect()


def test_workbook(spark, server):
    rows = fetch.load(spark, evidence.PLAN, endpoint=f"{server}/book", plain=True)
    docs = sorted(fetch.documents(rows, evidence.PLAN).collect(), key=lambda d: d.title or "")
    assert [(d.reject_reason, d.title, (d.metadata or {}).get("record_id")) for d in docs] == [("missing_supported_title", None, None), (None, "Outra", "P3"), (None, "Água limpa", "P1")]
    assert [d.title for d in fetch.documents(rows, evidence.PLAN, query="agua norte").collect()] == ["Água limpa"]


def answers(request):
    """A transport of a user's own."""
    page = DETAIL_PAGE if request.url.endswith("/d1") else LIST_PAGE
    return fetch.Answer(200, page.encode(), "text/html", url=request.url, provenance=fetch.CAPTURED)


def test_listing_and_details_by_a_transport_of_ones_own(spark):
    docs = fetch.scan(spark, evidence.AGENCY, transport="tests.test_fetch:answers").collect()
    assert sorted((d.reject_reason or "", d.source_url) for d in docs) == [("", "https://cinea.ec.europa.eu/d1"), ("invalid_detail_url", LISTING)]
    good = next(d for d in docs if d.reject_reason is None)
    assert json.loads(good.text)["deadlineDate"] == "2026-10-05T17:00:00+02:00" and good.metadata["record_id"] == "LIFE-2026-A"
    assert fetch.scan(spark, evidence.AGENCY, "nothing like it", transport="tests.test_fetch:answers").where("reject_reason IS NULL").count() == 0


class Pages:
    def search(self, query, limit):
        return [{"url": u, "title": query, "text": "t", "links": ["https://x.ec.europa.eu/a", "https://evil.org/"]} for u in ("https://evil.org/1", "https://10.0.0.1/2", "https://x.ec.europa.eu/3", "https://ec.europa.eu:444/4", "https://ec.europa.eu/5", "https://ec.europa.eu/6")]


def test_host_bridge(spark):
    got = fetch.bridged(spark, "tests.test_fetch:Pages", ("ec.europa.eu",), "water", 2).collect()
    assert [r.url for r in got] == ["https://x.ec.europa.eu/3", "https://ec.europa.eu/5"] and got[0].links == ["https://x.ec.europa.eu/a"]


def test_all_are_registered(spark):
    fetch.register(spark)
    sources = spark.createDataFrame([("a", True, "active", "ted_search"), ("b", True, "active", "cinea_life_html"), ("c", False, "active", "funding_tenders"), ("d", True, "active", None)], "source_id string, enabled boolean, status string, adapter string")
    assert fetch.active(spark, sources) == ["cinea_life_html", "ted_search"] and fetch.active_sources(sources) == [evidence.AGENCY, evidence.NOTICES]
    assert spark.read.format("ted_search").option("transport", "tests.test_fetch:answers").option("today", date(2026, 10, 6).isoformat()).load().first().error == "unexpected_content_type"


def test_command_line_reads_landed_files_of_all_sources(spark, tmp_path, capsys):
    for name, files in {evidence.PLAN: {"plan.xlsx": BOOK}, evidence.AGENCY: {quote(LISTING, safe="") + ".html": LIST_PAGE.encode(), quote("https://cinea.ec.europa.eu/d1", safe=""): DETAIL_PAGE.encode()}}.items():
        (tmp_path / name).mkdir()
        for file, data in files.items():
            (tmp_path / name / file).write_bytes(data)
        assert cli.main(["source", "check", name, "--landed", str(tmp_path / name)], spark) == 0
    assert capsys.readouterr().out == f"{evidence.PLAN}: 2 accepted, 1 rejected\n{evidence.AGENCY}: 1 accepted, 1 rejected\n"
    assert cli.main(["source", "check"], spark) == 2  # neither a source nor all
