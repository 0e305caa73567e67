"""Where results go: tables, JSON reports and text reports, all through Spark's committers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.changes import canonical_json


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a temporary one only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, force: bool = False, by: list[str] | None = None) -> None:
    """Parquet; an existing table stays unless force."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    """One JSON object a row, nulls kept."""
    df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_report(reports: DataFrame, path: str, force: bool = False) -> None:
    """name and text: a folder for each name holds its text as one file; whole or not there."""
    reports.select("name", F.col("text").alias("value")).write.mode("overwrite" if force else "errorifexists").option("lineSep", "\n").partitionBy("name").text(path)


def payloads(df: DataFrame, ident: str = "id") -> DataFrame:
    """id and payload: each row as canonical JSON, fields in order of their names."""
    return df.select(ident, canonical_json(F.struct(*sorted(df.columns))).alias("payload"))


def typed(spark: SparkSession, rows: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Rows of JSON payloads as typed columns; a payload that doesn't fit fails the job."""
    return rows.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")
