"""Spreadsheet rows of annual plans, read with the standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import fold, key

#: Limits of a workbook: bytes unpacked in all and of one part, rows and columns of a sheet; rows and columns that
#: the format itself knows.
MOST_BYTES, MOST_XML, MOST_ROWS, MOST_COLUMNS = 40 << 20, 20 << 20, 10_000, 256
FORMAT_ROWS, FORMAT_COLUMNS = 1_048_576, 16_384
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Folded headers that mark the header row, any of each group, and others that a record keeps.
ID_HEADERS = ("id", "idaviso", "iddoaviso", "codigoaviso", "codigodoaviso", "identificador", "numeroaviso", "numerodoaviso")
TITLE_HEADERS, PROGRAMME_HEADERS = ("designacaodoaviso", "designacao", "nomedoaviso"), ("programa", "programafinanciador", "programaoperacional")
KEPT_HEADERS = """tipoentbeneficiaria tipodeentidadebeneficiaria naturezaaviso objetivoespecifico fundo dotacaofundo dotacaodofundo datainicioprevista datadeinicioprevista
datafimprevista datadefimprevista quadrimestre nutsii modalidadeapresentacaocandidatura modalidadedeapresentacaodecandidatura""".split()


class WorkbookError(ValueError):
    """A workbook that is broken or beyond its limits."""


def column_of(reference: str) -> int | None:
    """Zero-based column of an A1 reference; null if it isn't one."""
    found = re.fullmatch(r"([A-Z]+)([1-9][0-9]*)", reference)
    if found is None:
        return None
    n = reduce(lambda n, c: n * 26 + ord(c) - 64, found[1], 0)
    if int(found[2]) > FORMAT_ROWS or n > FORMAT_COLUMNS:
        raise WorkbookError("cell outside the format's limits")
    if n > MOST_COLUMNS:
        raise WorkbookError("too many columns")
    return n - 1


class _Book:
    """Parts of a workbook, each checked before it is parsed."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError) as e:
            raise WorkbookError("not a workbook") from e
        parts = self.zip.infolist()
        self.sizes = {i.filename: i.file_size for i in parts}
        if len(self.sizes) < len(parts) or any(i.flag_bits & 1 for i in parts) or sum(self.sizes.values()) > MOST_BYTES:
            raise WorkbookError("unsafe workbook")

    def xml(self, name: str) -> ElementTree.Element:
        if self.sizes.get(name, MOST_XML + 1) > MOST_XML:
            raise WorkbookError("missing or oversized part")
        try:
            raw = self.zip.read(name)
            # only UTF-8, so that declarations can't hide in another encoding
            if re.search(r"<!\s*(?:DOCTYPE|ENTITY)\b", raw.decode("utf-8-sig"), re.IGNORECASE):
                raise WorkbookError("unsafe part")
            return ElementTree.fromstring(raw)
        except (zipfile.BadZipFile, OSError, RuntimeError, UnicodeDecodeError, ElementTree.ParseError) as e:
            raise WorkbookError("broken part") from e

    def first_sheet(self) -> str:
        """The sheet that the workbook names first; without a workbook part the first sheet file."""
        if "xl/workbook.xml" not in self.sizes:
            found = sorted(n for n in self.sizes if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
            if not found:
                raise WorkbookError("no sheet")
            return found[0]
        sheet = next(self.xml("xl/workbook.xml").iter(f"{_NS}sheet"), None)
        link = sheet.get(_LINK) if sheet is not None else None
        targets = {r.get("Id"): r.get("Target") for r in self.xml("xl/_rels/workbook.xml.rels")} if link else {}
        path = posixpath.normpath(posixpath.join("/xl", targets.get(link) or "")).lstrip("/")
        if not path.startswith("xl/worksheets/") or path not in self.sizes:
            raise WorkbookError("no sheet where the workbook says")
        return path


def _text(e: ElementTree.Element | None) -> str:
    return "" if e is None else "".join(t.text or "" for t in e.iter(f"{_NS}t"))


def rows_of(data: bytes) -> list[list[str]]:
    """Cells of the first sheet as text; missing cells are empty, rows without cells don't count."""
    book = _Book(data)
    shared = [_text(e) for e in book.xml("xl/sharedStrings.xml").findall(f"{_NS}si")] if "xl/sharedStrings.xml" in book.sizes else []
    rows = book.xml(book.first_sheet()).findall(f"{_NS}sheetData/{_NS}row")
    if len(rows) > MOST_ROWS:
        raise WorkbookError("too many rows")

    def value(cell: ElementTree.Element) -> str:
        said = _text(cell.find(f"{_NS}is")) if cell.get("t") == "inlineStr" else cell.findtext(f"{_NS}v") or ""
        if cell.get("t") != "s" or not said:
            return said
        if not re.fullmatch(r"\s*[0-9]+\s*", said) or int(said) >= len(shared):
            raise WorkbookError("shared string out of range")
        return shared[int(said)]

    found = [{at: value(c) for c in row.findall(f"{_NS}c") if (at := column_of(c.get("r", ""))) is not None} for row in rows]
    out = [[cells.get(i, "") for i in range(max(cells) + 1)] for cells in found if cells]
    if not out:
        raise WorkbookError("no rows")
    return out


def sheets(files: DataFrame) -> DataFrame:
    """path, row, cells, error of workbooks (path, content), as spark.read.format("binaryFile") gives them.

    A workbook that can't be read is one row with its error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found, error = rows_of(data), None
                except WorkbookError as e:
                    found, error = [None], f"error: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array([error] * len(found), pa.string())], names=["path", "row", "cells", "error"])

    return files.select("path", "content").mapInArrow(work, "path string, row int, cells array<string>, error string")


def annual_plan(rows: DataFrame, query: str = "", limit: int = 100) -> DataFrame:
    """path, row, record (JSON of header to cell) or reject_reason of each row below the header row.

    The header row is the first that has an id, a title and a programme column. All words of the query must
    stand in a row. Blank rows don't count; the limit applies to accepted rows. A workbook that couldn't be read,
    or without a usable header row, is one rejected row.
    """
    keys = rows.withColumn("keys", F.transform("cells", key))
    has = lambda names: F.arrays_overlap("keys", F.array(*map(F.lit, names)))
    head = has(ID_HEADERS) & has(TITLE_HEADERS) & has(PROGRAMME_HEADERS)
    books = keys.groupBy("path").agg(F.min(F.when(head, F.col("row"))).alias("head"), F.min_by("cells", F.when(head, F.col("row"))).alias("names"), F.min_by("keys", F.when(head, F.col("row"))).alias("head_keys"), F.max("error").alias("error"))
    filled = F.filter("head_keys", lambda k: k != "")
    broken = F.coalesce("error", F.when(F.col("head").isNull(), "missing_required_header").when(F.size(filled) > F.size(F.array_distinct(filled)), "duplicate_headers"))
    books = books.select("path", "head", "names", "head_keys", broken.alias("broken"))
    body = rows.join(books.where("broken IS NULL"), "path").where((F.col("row") > F.col("head")) & F.exists("cells", lambda c: F.trim(c) != ""))
    cell = lambda names: F.nullif(F.trim(F.try_element_at(F.filter(F.arrays_zip("head_keys", "cells"), lambda z: z["head_keys"].isin(*names)), F.lit(1))["cells"]), F.lit(""))
    lacks = F.when(cell(ID_HEADERS).isNull(), "missing_record_id").when(cell(TITLE_HEADERS).isNull(), "missing_supported_title").when(cell(PROGRAMME_HEADERS).isNull(), "missing_programme")
    for word in query.split():
        body = body.where(F.contains(fold(F.array_join("cells", " ")), fold(F.lit(word))))
    # the first id, title and programme columns and the other known headers make the record
    first = lambda names: F.try_element_at(F.filter("head_keys", lambda k: k.isin(*names)), F.lit(1))
    kept = F.array_union(F.array(first(ID_HEADERS), first(TITLE_HEADERS), first(PROGRAMME_HEADERS)), F.array(*map(F.lit, KEPT_HEADERS)))
    named = F.map_from_entries(F.transform(F.filter(F.arrays_zip("names", "head_keys", "cells"), lambda z: F.array_contains(kept, z["head_keys"]) & F.coalesce(F.trim(z["cells"]) != "", F.lit(False))), lambda z: F.struct(z["names"], z["cells"])))
    out = body.withColumn("reject_reason", lacks).withColumn("record", F.when(F.col("reject_reason").isNull(), F.to_json(named)))
    place = F.sum(F.col("reject_reason").isNull().cast("int")).over(Window.partitionBy("path").orderBy("row"))
    out = out.withColumn("place", place).where(F.col("reject_reason").isNotNull() | (F.col("place") <= limit)).select("path", "row", "record", "reject_reason")
    return out.unionByName(books.where("broken IS NOT NULL").select("path", F.col("head").alias("row"), F.lit(None).cast("string").alias("record"), F.col("broken").alias("reject_reason")))
