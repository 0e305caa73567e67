"""State for each key of a stream, which leaves when its key is idle.

Snapshots keep for each source and content the first and last time seen and the last address and etag; events keep
that their id was seen. Both are Spark's own keyed state (on disk, in RocksDB), with a time to live: a key that is idle
for longer leaves, so state is bounded by what comes within that time and not by all history. What a key says after it
left and came back again starts anew, so sinks merge by key: tables by first and last (min and max don't mind repeats),
events by insert-or-ignore. A replayed batch changes nothing either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


#: What queries with keyed state run under. Without data there is no batch: state that may leave would ask for one for
#: ever, and a query over what is there would never end; keys leave in the batches that come.
SETTINGS = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state where keyed state can be kept; others are not touched."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _later(a: tuple, b: tuple) -> bool:
    """Whether a comes after b, nulls first."""
    return [(x is not None, x) if x is not None else (False,) for x in a] > [(x is not None, x) if x is not None else (False,) for x in b]


class Snapshots(StatefulProcessor):
    """Key: source_id, content_hash. Rows: retrieved_at, source_url, etag. One row out for each key of a batch."""

    def __init__(self, time: StructField, ttl_ms: int):
        kind = time.dataType
        self.kinds = StructType([StructField("first_seen", kind), StructField("last_seen", kind), StructField("source_url", StringType()), StructField("etag", StringType())])
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", self.kinds, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self.seen.get() if self.seen.exists() else None
        first, last, url, etag = known if known is not None else (None,) * 4
        for r in rows:
            t = r.retrieved_at
            if t is not None and (first is None or t < first):
                first = t
            if _later((t, r.source_url), (last, url)):
                url = r.source_url
            if _later((t, r.etag), (last, etag)):
                etag = r.etag
            if t is not None and (last is None or t > last):
                last = t
        self.seen.update((first, last, url, etag))
        yield Row(source_id=key[0], content_hash=key[1], first_seen=first, last_seen=last, source_url=url, etag=etag, is_new=known is None)

    def close(self) -> None:
        pass


class Once(StatefulProcessor):
    """Key: an id. Of its rows the first comes out, and later ones only after the id was idle for its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self.seen.exists()
        first = None
        for r in rows:
            first = first or r
        self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
        if not known and first is not None:
            yield first

    def close(self) -> None:
        pass


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents of a batch as snapshots of one sighting each."""
    at = F.col("retrieved_at")
    return documents.select("source_id", F.sha2("text", 256).alias("content_hash"), at.alias("first_seen"), at.alias("last_seen"), "source_url", "etag")


def snapshots(documents: DataFrame, ttl_days: float = 30) -> DataFrame:
    """A stream of documents (source_id, text, source_url, etag, retrieved_at) as one of snapshots: a row for each key
    that a batch touches, with all that is known of it, and is_new where nothing was. Texts leave before the shuffle."""
    # state keeps times as microseconds
    timed = isinstance(documents.schema["retrieved_at"].dataType, TimestampType)
    at = F.unix_micros("retrieved_at") if timed else F.col("retrieved_at")
    rows = documents.select("source_id", F.sha2("text", 256).alias("content_hash"), "source_url", "etag", at.alias("retrieved_at"))
    process = Snapshots(rows.schema["retrieved_at"], round(ttl_days * DAY_MS))
    kinds = StructType([StructField("source_id", StringType()), StructField("content_hash", StringType()), *process.kinds.fields, StructField("is_new", BooleanType())])
    out = rows.groupBy("source_id", "content_hash").transformWithState(process, kinds, "Update", "ProcessingTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")}) if timed else out


def once(events: DataFrame, ident: str = "event_id", ttl_days: float = 30) -> DataFrame:
    """A stream of events, each id once."""
    return events.groupBy(ident).transformWithState(Once(round(ttl_days * DAY_MS)), events.schema, "Update", "ProcessingTime")
