"""Local text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read, folders that are not; most bytes of a file, most files and most characters of all.
SUFFIXES, IGNORED = ("md", "txt", "pdf"), (".git", ".venv", "venv", "node_modules", "__pycache__")
MOST_BYTES, MOST_FILES, MOST_CHARACTERS = 5 << 20, 250, 2_000_000


class CorpusError(ValueError):
    """The folder holds more than a local corpus may."""


def load(spark: SparkSession, folder: str, most_files: int = MOST_FILES) -> DataFrame:
    """source (path below the folder), text, content_hash of the folder's Markdown, text and PDF files, by folded path.

    Nothing is left out: a folder beyond one of the bounds raises CorpusError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    # paths come with a scheme and maybe a host; what follows the folder's own path is the source
    own = folder.split("://")[-1].strip("/") + "/"
    files = files.withColumn("source", F.substring_index("path", own, -1))
    hidden = F.exists(F.split("source", "/"), lambda p: p.startswith(".") | p.isin(*IGNORED))
    files = files.where(~hidden)
    found = files.select("source", "length").limit(most_files + 1).collect()
    if len(found) > most_files:
        raise CorpusError(f"the corpus has more than {most_files} files")
    if large := files.where(F.col("length") > MOST_BYTES).select("source").head():
        raise CorpusError(f"a file has more than {MOST_BYTES} bytes: {large.source}")
    pdf, digest = F.col("source").endswith(".pdf"), F.sha2("content", 256).alias("content_hash")
    out = files.where(~pdf).select("source", F.decode("content", "UTF-8").alias("text"), digest)
    if any(r.source.endswith(".pdf") for r in found):
        read = pdf_text(files.where(pdf).select(F.col("source").alias("path"), "content"))
        out = out.unionByName(read.join(files.where(pdf).select("source", digest), "source"))
    if (out.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_CHARACTERS:
        raise CorpusError(f"the corpus has more than {MOST_CHARACTERS} characters")
    return out.orderBy(F.lower("source"), "source")


def pdf_text(files: DataFrame) -> DataFrame:
    """source and text of PDF files (path, content), where the optional reader is installed."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e

    @F.udf("string")
    def read(data):  # noqa: ANN001, ANN202
        import io

        import pypdf

        return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)

    return files.select(F.col("path").alias("source"), read("content").alias("text"))
