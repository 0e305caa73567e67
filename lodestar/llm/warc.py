"""Content-addressed WARC archive.

An archive is two tables: ``payloads`` holds the bytes of each distinct payload once, under the SHA-256 of
those bytes; ``headers`` holds each record's exact header block (WARC header and, for responses, the HTTP
header) with the digest of its payload. Reading checks every stored payload against its digest once, joins the
headers to the lengths of what was checked, and checks each record's length; whole records are the join of
both tables. Reading moves no payload.

Of records whose equal payloads have ``LEAST`` bytes or more, that with the smallest page id is a response
and the others are revisits that refer to it; smaller payloads always stay with responses.

Defined results: a null payload counts as empty; rows that share both the smallest id and the payload are
responses all; a null id is never the smallest, unless all are null, and then all are responses; ids are whole
numbers (text that isn't one fails the job); controls, spaces and line separators of an address are written
percent-encoded, so that no address ends its line; an empty table gives an empty archive; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contract: least bytes of a payload that others may revisit.
LEAST = 100
#: Fixed date of archives without a capture time, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Stands for a null page id where rows are matched.
NONE = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, payload_digest string, header string"
PAYLOADS = "payload_digest string, payload binary"


def _rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))


#: What an address must not hold as it is: controls, white space and line separators.
UNSAFE = r"[\x00-\x20\x7F-\xA0\u2028\u2029]"


def safe(url: Column) -> Column:
    """The address with its unsafe characters percent-encoded."""
    encoded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(url.rlike(UNSAFE), F.array_join(encoded, "")).otherwise(url)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the archive of all pages below path.

    Which record of a payload is the response comes from counts that combine before the shuffle, so a group
    that holds a third of all pages is one row for each task. Payloads then move once, keyed by digest and
    page id, one row of each key for each task, and only the row that keeps the payload remains. The digest table is broadcast by size only if
    Spark's own limit allows it.
    """
    rows = _rows(pages, page_id, url, html)
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("n").alias("n"))
    slim = rows.select("page_id", "url", "payload_digest", "n")
    known = first.where(F.col("n") >= LEAST).select("payload_digest", "first")
    records = slim.join(known, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    both = lambda kind, *more: F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), name("page_id"), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), safe(F.col("url")), F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(CRLF), *more)
    response = both("response", F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), (F.octet_length(http) + F.col("n")).cast("string"), F.lit(CRLF * 2), http)
    again = both("revisit", F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name("first"), F.lit(f"{CRLF}Content-Length: 0{CRLF * 2}"))
    records.select("page_id", "payload_digest", F.when(revisit, again).otherwise(response).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    keep = first.select(F.col("payload_digest").alias("d"), F.coalesce("first", F.lit(NONE)).alias("f"))
    held = rows.select("payload_digest", F.coalesce("page_id", F.lit(NONE)).alias("k"), "payload")
    # rows that repeat both keys become one before they move, and the join finds the rest where it is
    held = held.groupBy("payload_digest", "k").agg(F.first("payload").alias("payload"))
    held = held.join(keep, (F.col("payload_digest") == F.col("d")) & (F.col("k") == F.col("f")), "left_semi")
    held.select("payload_digest", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _parsed(headers: DataFrame) -> DataFrame:
    """The fields of each header block, from whole lines of its WARC part."""
    field = lambda n: F.regexp_extract("header", rf"(?d)(?m)^{n}: ([^\r\n]*)", 1)
    # the first Content-Length is that of the record; what follows the first empty line is the HTTP header
    inner = F.octet_length("header") - F.octet_length(F.substring_index("header", CRLF * 2, 1)) - 4
    return headers.select(
        "header",
        "page_id",
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        field("WARC-Type").alias("record_type"),
        F.try_to_number(F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1), F.lit("S9999999999999999999")).cast("long").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("length"),
        inner.alias("inner"),
    )


def _error(what: str, kind: str) -> Column:
    return F.raise_error(F.lit(what)).cast(kind)


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header fields, and payloads with their lengths; a payload that isn't what its digest says fails the job."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    n = F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.octet_length("payload").cast("long")).otherwise(_error("a payload differs from its digest", "long"))
    return _parsed(spark.read.schema(HEADERS).parquet(f"{path}/headers")), stored.withColumn("payload_bytes", n)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url (as written), payload_bytes, payload_digest, record_type, refers_to.

    Everything comes from the stored headers and payloads; a payload that isn't what its digest says, that is
    missing, or that doesn't fill its record's length fails the job.
    """
    rows, stored = _tables(spark, path)
    # the column whose value is checked is the one that is asked for, so no check can be pruned
    there = F.coalesce("payload_bytes", _error("a record's payload is missing", "long"))
    want = F.when(F.col("record_type") == "response", F.col("inner") + there).otherwise(F.col("inner"))
    whole = F.when(F.col("length") == want, there).otherwise(_error("a record's length differs from its parts", "long"))
    lengths = stored.select(F.col("payload_digest"), "payload_bytes")
    return rows.join(lengths, "payload_digest", "left").select("page_id", "url", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and record: the exact bytes of each WARC record, from the join of both tables."""
    rows, stored = _tables(spark, path)
    there = F.when(F.col("payload_bytes").isNotNull(), F.col("payload")).otherwise(_error("a record's payload is missing", "binary"))
    body = F.when(F.col("record_type") == "response", there).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8"))
    whole = F.octet_length("header") - F.col("inner") + F.col("length") + 4 == F.octet_length(record)
    return rows.join(stored, "payload_digest", "left").select("page_id", F.when(whole, record).otherwise(_error("a record's length differs from its parts", "binary")).alias("record"))
