"""Snapshots and events from streams, by keyed state that leaves when its keys are idle (see keyed.py).

Each micro-batch passes on the keys it touches with all that is known of them. Sinks merge by key with aggregates that
don't mind order or repeats, so a replayed batch changes nothing: follow_snapshots() merges into the store, whose
buckets of these keys alone are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.sinks import shared_folder
from lodestar.store import Store
from lodestar.streaming import keyed


def merge_snapshots(parts: DataFrame) -> DataFrame:
    """Partial snapshots of the same source and content as one; the order of parts doesn't matter."""
    last = F.struct("last_seen", "source_url", "etag")
    return parts.groupBy("source_id", "content_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("source_url", last).alias("source_url"), F.max_by("etag", last).alias("etag"))


def _source(spark: SparkSession, path: str, files: int, schema: StructType | str | None) -> DataFrame:
    """A stream of the parquet files of a folder (or of one file); a folder without files needs a schema."""
    if schema is None:
        schema = spark.read.parquet(path).schema
    where = path if not path.endswith(".parquet") else path + "*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(where)


def _empty(spark: SparkSession, path: str) -> bool:
    """Whether there is nothing to stream yet."""
    try:
        return spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return True


def run_snapshots(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], files: int = 8, ttl_days: float = 30, schema: StructType | str | None = None) -> DataFrame:
    """Snapshots of what is there, read in micro-batches; each leaves what it touched under its batch id, so replays overwrite."""
    if schema is not None and _empty(spark, path):
        return merge_snapshots(keyed.document_rows(shape(spark.createDataFrame([], schema))))
    out, rows = shared_folder(spark, "stream"), keyed.snapshots(shape(_source(spark, path, files, schema)), ttl_days)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    with keyed.keyed_state(spark):
        stream = rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    return merge_snapshots(spark.read.schema(rows.schema).parquet(f"{out}/parts"))


def follow_snapshots(documents: DataFrame, store: Store, checkpoint: str, ttl_days: float = 30, available_now: bool = False) -> StreamingQuery:
    """Keeps the store's source snapshots up to date with a stream of documents; the running query."""
    rows = keyed.snapshots(documents, ttl_days)

    def batch(df: DataFrame, number: int) -> None:
        store.save_source_snapshots(df.drop("is_new"))

    with keyed.keyed_state(documents.sparkSession):
        writer = rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_events(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], files: int = 8, ttl_days: float = 30, schema: StructType | str | None = None) -> DataFrame:
    """Events of what is there, once for each event_id; an id is known for as long as it isn't idle beyond its time to live."""
    if schema is not None and _empty(spark, path):
        return shape(spark.createDataFrame([], schema))
    out, events = shared_folder(spark, "stream"), shape(_source(spark, path, files, schema))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/events/batch={number}")

    with keyed.keyed_state(spark):
        stream = keyed.once(events, ttl_days=ttl_days).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{out}/events").drop("batch").dropDuplicates(["event_id"])
