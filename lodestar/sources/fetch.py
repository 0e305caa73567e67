"""Sources as Spark data sources: what the network answers, one row for each request.

    fetch.register(spark)
    spark.read.format("ted_search").option("query", "...").option("limit", 50).option("pages", 4).load()

A partition is a request, made on an executor: a page of results of an API, an address of a listing, a workbook. A row
is an answer or its failure, with status, size, digest and time, so one lost page fails no job; ``strict`` makes it
fail. Bodies beyond the cap are read up to the cap and no further. A request goes to its source's own host by https,
and a redirect to any other is not followed. How a request is sent is a transport, which users may replace: any
``module:function`` from :class:`Request` to :class:`Answer`, such as :func:`recorded`, which gives answers that lie
in a folder.

:func:`documents` turns rows of any of the sources into documents and rejects, whether they were fetched or landed.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from functools import partial
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode, urlparse
from urllib.request import HTTPRedirectHandler, build_opener
from urllib.request import Request as HttpRequest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.operators.constraints import query_args
from lodestar.sources import evidence, html, landing, records, registry, xlsx

FETCHED = "source_id string, request int, url string, http_status int, content_type string, charset string, response_bytes long, last_modified string, payload_sha256 string, retrieved_at timestamp, provenance string, body binary, error string"
#: What a row's body is known to be, as evidence says it.
LIVE, CAPTURED = "LIVE_SOURCE_VERIFIED", "CAPTURED_FIXTURE"
MOST_BYTES, MOST_ADDRESSES = records.MOST_BYTES, 500
WORKBOOK = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
#: What a call search asks for.
CALL_STATUSES = ("31094501", "31094502", "31094503")


class FetchError(ValueError):
    """A request that was not or must not be made, or an answer that is not what its source gives."""


@dataclass(frozen=True)
class Request:
    """One request: number, address, body and headers, and what holds for its answer."""

    number: int
    url: str
    body: bytes | None = None
    headers: dict[str, str] = field(default_factory=dict)
    host: str = ""
    accepts: tuple[str, ...] = ()
    timeout: float = 20
    #: For tests: plain http to a host of one's own.
    plain: bool = False
    #: Where recorded answers lie.
    folder: str = ""


@dataclass(frozen=True)
class Answer:
    """One answer; a body of more than ``MOST_BYTES`` bytes is one too long."""

    status: int
    body: bytes
    content_type: str = ""
    charset: str = "utf-8"
    last_modified: str | None = None
    url: str = ""
    provenance: str = LIVE


Transport = Callable[[Request], Answer]


def check_host(url: str, request: Request) -> None:
    """https, the source's own host, its usual port, no user; else an error."""
    parts = urlparse(url)
    own = parts.hostname == request.host and not parts.username and not parts.password
    if not (own and (request.plain or (parts.scheme == "https" and parts.port in (None, 443)))):
        raise FetchError("an address outside the source's own host")


class _OwnHost(HTTPRedirectHandler):
    """Redirects are checked before they are followed."""

    def __init__(self, request: Request):
        self.request = request

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        check_host(newurl, self.request)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def http(request: Request) -> Answer:
    """The network. An answer with an error status is an answer."""
    check_host(request.url, request)
    sent = HttpRequest(request.url, data=request.body, headers=request.headers, method="POST" if request.body is not None else "GET")
    try:
        with build_opener(_OwnHost(request)).open(sent, timeout=request.timeout) as got:
            kind, charset = got.headers.get_content_type(), got.headers.get_content_charset() or "utf-8"
            return Answer(int(got.status), got.read(MOST_BYTES + 1), kind, charset, got.headers.get("Last-Modified"), got.geturl())
    except HTTPError as e:
        return Answer(int(e.code), e.read(MOST_BYTES + 1), e.headers.get_content_type(), "utf-8", e.headers.get("Last-Modified"), request.url)


def recorded(request: Request) -> Answer:
    """An answer that lies in the folder of the option ``recorded``: the one file of request=N below it, on any store that Arrow reads."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(request.folder)
    at = f"{root.rstrip('/')}/request={request.number}"
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
    if not found:
        return Answer(404, b"", provenance=CAPTURED)
    with files.open_input_stream(found[0]) as stream:
        return Answer(200, stream.read(MOST_BYTES + 1), request.accepts[0] if request.accepts else "", url=request.url, provenance=CAPTURED)


def _transport(name: str | None) -> Transport:
    if not name:
        return http
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _row(source_id: str, request: Request, transport: Transport) -> tuple:
    """A row of ``FETCHED``. What an answer must be is checked here, whatever gave it."""
    now = datetime.now(UTC)
    try:
        answer = transport(request)
        if answer.url:
            check_host(answer.url, request)
    except (URLError, OSError, FetchError) as e:
        reason = e.reason if isinstance(e, URLError) and not isinstance(e, HTTPError) else e
        return (source_id, request.number, request.url, None, None, None, 0, None, None, now, None, None, f"{type(reason).__name__}: {reason}")
    size, error = len(answer.body), None
    if answer.status >= 400 or answer.status < 200:
        error = f"the source answered with status {answer.status}"
    elif size > MOST_BYTES:
        error = "response_too_large"
    elif request.accepts and answer.content_type not in request.accepts:
        error = "unexpected_content_type"
    digest = hashlib.sha256(answer.body).hexdigest() if size <= MOST_BYTES else None
    body = answer.body if error is None else None
    return (source_id, request.number, answer.url or request.url, answer.status, answer.content_type, answer.charset, size, answer.last_modified, digest, now, answer.provenance, body, error)


class FetchReader(DataSourceReader):
    def __init__(self, source_id: str, requests: list[Request], transport: str | None, strict: bool):
        self.source_id, self.requests, self.transport, self.strict = source_id, requests, transport, strict

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.requests))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        row = _row(self.source_id, self.requests[partition.value], _transport(self.transport))
        if self.strict and row[-1] is not None:
            raise FetchError(f"{self.source_id}: {row[-1]}")
        yield row


class Adapter(DataSource):
    """Options: query, limit (1 to 100 rows a page), pages, timeout (1 to 120 seconds), endpoint, transport, recorded, strict, plain."""

    source_id, endpoint, accepts = "", "", ()

    def schema(self) -> str:
        return FETCHED

    def option(self, name: str, default: str) -> str:
        return self.options.get(name, default)

    def flag(self, name: str) -> bool:
        return self.option(name, "false").lower() == "true"

    def reader(self, schema) -> FetchReader:  # noqa: ANN001
        limit, pages, timeout = int(self.option("limit", "50")), int(self.option("pages", "1")), float(self.option("timeout", "20"))
        query_args(self.option("query", ""), limit)
        if not 1 <= timeout <= 120 or pages < 1:
            raise FetchError("timeout must be from 1 to 120 seconds, and pages at least 1")
        endpoint = self.option("endpoint", self.endpoint)
        folder = self.option("recorded", "")
        make = partial(Request, host=urlparse(endpoint).hostname or "", accepts=self.accepts, timeout=timeout, plain=self.flag("plain"), folder=folder)
        requests = list(self.requests(make, endpoint, self.option("query", "").strip(), limit, pages))
        transport = self.option("transport", "lodestar.sources.fetch:recorded" if folder else "")
        return FetchReader(self.source_id, requests, transport or None, self.flag("strict"))

    def requests(self, make, endpoint: str, query: str, limit: int, pages: int) -> Iterator[Request]:  # noqa: ANN001
        raise NotImplementedError


def multipart(value: object, boundary: str) -> bytes:
    """A form whose one field, query, is a JSON file."""
    head = 'Content-Disposition: form-data; name="query"; filename="query.json"\r\nContent-Type: application/json; charset=utf-8'
    said = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return f"--{boundary}\r\n{head}\r\n\r\n{said}\r\n--{boundary}--\r\n".encode()


class Calls(Adapter):
    """The call search: a form with a JSON filter, page by page. Option api_key."""

    source_id, endpoint, accepts = evidence.CALLS, "https://api.tech.ec.europa.eu/search-api/prod/rest/search", ("application/json",)

    @classmethod
    def name(cls) -> str:
        return "funding_tenders"

    def requests(self, make, endpoint: str, query: str, limit: int, pages: int) -> Iterator[Request]:  # noqa: ANN001
        key = self.option("api_key", "SEDIA")
        if not 1 <= len(key) <= 100:
            raise FetchError("api_key must have 1 to 100 characters")
        terms = [{"terms": {"type": list(records.CALL_TYPES)}}, {"terms": {"status": list(CALL_STATUSES)}}]
        for page in range(1, pages + 1):
            boundary = f"lodestar-{uuid.uuid4().hex}"
            asked = urlencode({"apiKey": key, "text": query or "***", "pageSize": str(limit), "pageNumber": str(page), "language": "en"})
            headers = {"Accept": "application/json", "Content-Type": f"multipart/form-data; boundary={boundary}"}
            yield make(page, f"{endpoint}?{asked}", multipart({"bool": {"must": terms}}, boundary), headers)


class Notices(Adapter):
    """The procurement search: JSON, page by page; without a query, what was published in the last year."""

    source_id, endpoint, accepts = evidence.NOTICES, "https://api.ted.europa.eu/v3/notices/search", ("application/json",)

    @classmethod
    def name(cls) -> str:
        return "ted_search"

    def requests(self, make, endpoint: str, query: str, limit: int, pages: int) -> Iterator[Request]:  # noqa: ANN001
        today = date.fromisoformat(self.option("today", datetime.now(UTC).date().isoformat()))
        for page in range(1, pages + 1):
            body = json.dumps(records.notice_request(query, limit, today) | {"page": page}, ensure_ascii=False).encode()
            yield make(page, endpoint, body, {"Accept": "application/json", "Content-Type": "application/json"})


class Plan(Adapter):
    """The annual plan: a workbook."""

    source_id, accepts = evidence.PLAN, (WORKBOOK, "application/octet-stream", "application/vnd.ms-excel")
    endpoint = "https://portugal2030.pt/wp-content/uploads/sites/3/2026/09/PlanoAnualAvisos_download_140926-1.xlsx"

    @classmethod
    def name(cls) -> str:
        return "portugal2030_annual_plan_xlsx"

    def requests(self, make, endpoint: str, query: str, limit: int, pages: int) -> Iterator[Request]:  # noqa: ANN001
        yield make(1, endpoint, None, {"Accept": WORKBOOK})


class Agency(Adapter):
    """The agency's listing, or with option addresses (a JSON list) the pages it names."""

    source_id, endpoint, accepts = evidence.AGENCY, "https://cinea.ec.europa.eu/life-calls-proposals-2026_en", ("text/html",)

    @classmethod
    def name(cls) -> str:
        return "cinea_life_html"

    def requests(self, make, endpoint: str, query: str, limit: int, pages: int) -> Iterator[Request]:  # noqa: ANN001
        addresses = json.loads(self.option("addresses", "null"))
        if addresses is not None and len(addresses) > MOST_ADDRESSES:
            raise FetchError(f"more than {MOST_ADDRESSES} addresses")
        for n, url in enumerate([endpoint] if addresses is None else addresses, 1):
            yield make(n, url, None, {"Accept": "text/html"})


ADAPTERS = {a.source_id: a for a in (Calls, Notices, Plan, Agency)}


class BridgeReader(DataSourceReader):
    def __init__(self, factory: str, query: str, limit: int):
        self.factory, self.query, self.limit = factory, query, limit

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.factory.partition(":")
        bridge = getattr(importlib.import_module(module), name)()
        for page in bridge.search(self.query, limit=self.limit):
            yield tuple(page.get(k) for k in ("url", "title", "text")) + (list(page.get("links") or ()),)


class Bridge(DataSource):
    """A host's own search: option factory (module:callable) gives an object whose search(query, limit=n) yields pages."""

    @classmethod
    def name(cls) -> str:
        return "host_bridge"

    def schema(self) -> str:
        return "url string, title string, text string, links array<string>"

    def reader(self, schema) -> BridgeReader:  # noqa: ANN001
        limit = int(self.options.get("limit", "50"))
        query_args(self.options.get("query", ""), limit)
        return BridgeReader(self.options["factory"], self.options.get("query", ""), limit)


def bridged(spark: SparkSession, factory: str, suffixes: tuple[str, ...], query: str = "", limit: int = 50) -> DataFrame:
    """Pages of a host bridge from allowed hosts: the limit counts what is kept, whatever the bridge gives."""
    spark.dataSource.register(Bridge)
    pages = spark.read.format("host_bridge").option("factory", factory).option("query", query).option("limit", limit).load()
    return registry.host_pages(pages, suffixes).limit(limit)


def register(spark: SparkSession) -> None:
    """All sources by the names that a registry gives their adapters, and landed files and the host bridge."""
    for source in (*ADAPTERS.values(), Bridge, landing.Landing):
        spark.dataSource.register(source)


def load(spark: SparkSession, source_id: str, query: str = "", limit: int = 50, **options: object) -> DataFrame:
    """Rows of ``FETCHED`` of a source; options as of :class:`Adapter`."""
    adapter = ADAPTERS[source_id]
    spark.dataSource.register(adapter)
    reader = spark.read.format(adapter.name()).option("query", query).option("limit", limit)
    for name, value in options.items():
        reader = reader.option(name, json.dumps(value) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) else value)
    return reader.load()


def active(spark: SparkSession, sources: DataFrame) -> list[str]:
    """Names of the adapters of a registry's active sources, registered; a registry is a file that people write."""
    known = {a.name(): a for a in ADAPTERS.values()}
    names = sorted(r.adapter for r in registry.active(sources, tuple(known)).select("adapter").distinct().collect())
    for n in names:
        spark.dataSource.register(known[n])
    return names


def active_sources(sources: DataFrame) -> list[str]:
    """Source ids of a registry's active sources that an adapter here reads."""
    known = {a.name(): a.source_id for a in ADAPTERS.values()}
    return sorted(known[r.adapter] for r in registry.active(sources, tuple(known)).select("adapter").distinct().collect())


def landed(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Files of a folder as rows of ``FETCHED``; a file named by its percent-encoded address (and .html) has that address."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.html?$", "")
    name = F.when(name.startswith("https%"), F.try_url_decode(F.try_url_decode(name)))
    files = files.withColumn("path", F.when(name.startswith("https://"), name).otherwise(F.col("path")))
    n = F.octet_length("content").cast("long")
    large = n > MOST_BYTES
    return files.select(
        F.lit(source_id).alias("source_id"), F.lit(None).cast("int").alias("request"), F.col("path").alias("url"), F.lit(200).alias("http_status"), F.lit(ADAPTERS[source_id].accepts[0]).alias("content_type"), F.lit("utf-8").alias("charset"),
        n.alias("response_bytes"), F.col("modificationTime").cast("string").alias("last_modified"), F.when(~large, F.sha2("content", 256)).alias("payload_sha256"), F.col("modificationTime").alias("retrieved_at"), F.lit(CAPTURED).alias("provenance"),
        F.when(~large, F.col("content")).alias("body"), F.when(large, F.lit("response_too_large")).alias("error"),
    )


def _failed(fetched: DataFrame) -> DataFrame:
    """Rows of DOCUMENT for answers that failed."""
    wanted = fetched.sparkSession.createDataFrame([], records.DOCUMENT).schema
    rows = fetched.where(F.col("error").isNotNull()).select("source_id", F.col("url").alias("source_url"), "content_type", "payload_sha256", "last_modified", F.concat(F.lit("error: "), "error").alias("reject_reason"))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def _documents(rows: DataFrame, fetched: DataFrame, source_id: str, kind: str) -> DataFrame:
    """Rows of DOCUMENT from records (from_url, source_url, title, record, record_id, more, links, reject_reason) of answers."""
    of = fetched.select(F.col("url").alias("from_url"), "payload_sha256", "last_modified")
    text = lambda m: F.map_from_entries(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull()))
    return rows.join(of, "from_url").select(
        F.lit(source_id).alias("source_id"), F.coalesce("source_url", "from_url").alias("source_url"), F.lit(kind).alias("content_type"), F.left("title", F.lit(300)).alias("title"), F.col("record").alias("text"),
        F.when(F.col("record").isNotNull(), text(F.create_map(F.lit("record_id"), F.left("record_id", F.lit(200)), F.lit("row"), F.col("row").cast("string")))).alias("metadata"),
        F.when(F.col("record").isNotNull(), F.coalesce("links", F.array().cast("array<string>"))).alias("links"), "payload_sha256", "last_modified", "reject_reason",
    )


def documents(fetched: DataFrame, source_id: str, limit: int = 50, query: str = "", details: DataFrame | None = None) -> DataFrame:
    """DOCUMENT rows of fetched or landed answers of any of the four sources; failed answers are rejected rows.

    details: answers of the pages that an agency's listing names (FETCHED, or url and body of landed ones).
    """
    good = fetched.where(F.col("error").isNull())
    text = F.decode("body", "UTF-8")
    if source_id in (evidence.CALLS, evidence.NOTICES):
        reader = records.calls if source_id == evidence.CALLS else records.notices
        found = records.scan(good.select("url", text.alias("body"), "last_modified"), source_id, reader, limit, query)
    elif source_id == evidence.PLAN:
        rows = xlsx.annual_plan(xlsx.sheets(good.select(F.col("url").alias("path"), F.col("body").alias("content"))), query, limit)
        keys = F.from_json("record", "map<string,string>")
        named = lambda names: F.try_element_at(F.map_values(F.map_filter(keys, lambda k, _: xlsx.key(k).isin(*names))), F.lit(1))
        rows = rows.select(F.col("path").alias("from_url"), F.lit(None).cast("string").alias("source_url"), named(xlsx.TITLE_HEADERS).alias("title"), "record", named(xlsx.ID_HEADERS).alias("record_id"), "row", F.lit(None).cast("array<string>").alias("links"), "reject_reason")
        found = _documents(rows, good, source_id, WORKBOOK)
    else:
        pages = lambda df: df.select("url", F.decode("body", "UTF-8").alias("html"))
        other = details.where(F.col("error").isNull()) if details is not None and "error" in details.columns else details
        rows = html.listing_documents(pages(good), pages(other if other is not None else good), query)
        rows = rows.select(F.col("url").alias("from_url"), F.col("detail_url").alias("source_url"), "title", "record", F.get_json_object("record", "$.topicCode").alias("record_id"), F.col("place").alias("row"), F.array_compact(F.array("detail_url")).alias("links"), "reject_reason")
        found = _documents(rows, good, source_id, "text/html")
        found = found.where("reject_reason IS NOT NULL").unionByName(found.where("reject_reason IS NULL").orderBy("source_url").limit(limit))
    return found.select(*_failed(fetched).columns).unionByName(_failed(fetched))


def scan(spark: SparkSession, source_id: str, query: str = "", limit: int = 20, path: str | None = None, **options: object) -> DataFrame:
    """Documents and rejects of a source: of the files of a folder, or else of what it answers now.

    An agency's listing and its detail pages lie in one folder; live, the listing is fetched first and then the pages
    that it names, which are ``MOST_ADDRESSES`` at most.
    """
    # an API applies its own query; in a listing or workbook it is a filter here
    own = query if source_id in (evidence.PLAN, evidence.AGENCY) else ""
    if path is not None:
        files = landed(spark, path, source_id)
        return documents(files, source_id, limit, own, files if source_id == evidence.AGENCY else None)
    fetched = load(spark, source_id, query, limit, **options)
    details = None
    if source_id == evidence.AGENCY:
        named = html.listing(fetched.where(F.col("error").isNull()).select("url", F.decode("body", "UTF-8").alias("html"))).where(F.col("detail_url").isNotNull()).select("detail_url").distinct().limit(MOST_ADDRESSES)
        details = load(spark, source_id, query, limit, **options | {"addresses": sorted(r[0] for r in named.collect())})
    return documents(fetched, source_id, limit, own, details)
