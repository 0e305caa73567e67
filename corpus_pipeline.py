"""The corpus pipeline: documents pass five stages, each written and read again by whoever runs them.

Stages but the last return the columns of documents; the last returns each remaining row's ids. Each takes
(spark, docs, sf_dir), and works on all rows its predecessor kept. A null text counts as an empty one; repeated
rows stay until near-dedup keeps one of each class; an empty table passes through; other columns stay as they
are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mixing, neardup, quality, sentencepieces, toxicity
from lodestar.llm.common import documents, saved
from lodestar.llm.queries import PIECES, tokenizer_bytes


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from labels of the documents given."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source where there are such columns, n_tokens, ids, and digests of ids and decoded text of every row."""
    keep = tuple(x for x in ("doc_id", "lang", "source") if x in docs.columns)
    return sentencepieces.encode_decode(docs, tokenizer_bytes(PIECES), keep=keep, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", not_toxic), ("quality", good), ("neardup", one_of_each), ("mixing", mixed), ("sentencepiece", encoded)]
#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
