"""Shared pieces: scratch tables, batch plumbing and word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.batches import TEXT_BYTES, TEXT_ROWS, pieces  # noqa: F401

_made: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _made[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_made[app])
    return "file://" + _made[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It is removed when the driver's process ends."""
    path = f"{scratch_root(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended before this process
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the needed ones under names of our own, and what gives the columns back.

    So whatever else a table holds, its names can't clash with those an operator adds.
    """
    names = df.columns
    inner = [x if x in needed else f"_extra{i}" for i, x in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


def task_shares(df: DataFrame) -> int:
    """A partition count for a shuffle: the session's setting, which follows the cluster and input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(table: DataFrame) -> DataFrame:
    """A scan that has fewer splits than the cluster has cores, dealt over all of them; larger ones as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_text(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each doc_id with the columns in more: that of its texts whose hash is least. Copies combine before the shuffle."""
    return rows.groupBy("doc_id", *more).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("doc_id", *more, F.col("least.text").alias("text"))


def words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 bytes, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()

