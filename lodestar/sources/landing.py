"""A Python data source of landed responses: files of a folder, one row each, in batch and as a stream.

spark.dataSource.register(Landing); spark.read.format("landing").option("path", folder).load() gives url, body
and last_modified, which scan() takes. Each file is a partition; a path that only the driver sees belongs to
tests and single machines, and clusters read the same shape with spark.read.format("binaryFile").
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "url string, body string, last_modified string"


def _row(path: str) -> tuple[str, str, str]:
    with open(path, encoding="utf-8") as f:
        return "file://" + path, f.read(), datetime.fromtimestamp(os.path.getmtime(path), UTC).isoformat()


def _files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, x) for x in os.listdir(folder) if not x.startswith((".", "_")))


class LandingReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in _files(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _row(partition.value)


class LandingStream(SimpleDataSourceStreamReader):
    """Offsets count files in the order of their names; new files have later names."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = _files(self.folder)[start["files"] :]
        return map(_row, found), {"files": start["files"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return map(_row, _files(self.folder)[start["files"] : end["files"]])


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:  # noqa: ANN001
        return LandingReader(self.options["path"])

    def simpleStreamReader(self, schema) -> LandingStream:  # noqa: ANN001
        return LandingStream(self.options["path"])


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's own file reader, from any store."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").cast("string").alias("last_modified"))
