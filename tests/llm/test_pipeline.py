import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodestar.llm import neardup, queries

DATA = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count()
        assert 0 < seen[name] and docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == last.count()


def test_one_of_each_class(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.class_id for r in neardup.class_ids(docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, DATA).collect()} == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    q = con.sql(entry.oracle_sql()[name])
    assert sorted(q.columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in q.columns) for r in df.collect()))) == sorted(map(str, q.fetchall()))


def test_every_query_gives_all_rows(spark):
    counts = {t: spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    tables = {"op4": "pages", "op11": "pages", "op12": "embeddings"}
    for name, query in queries.QUERIES.items():
        # a search gives rows of queries, a trie gives nodes; whitening gives 16 components of each row
        if name not in ("op9_topk", "op13_prefix_trie"):
            table = tables.get(name.split("_")[0], "documents")
            assert query(spark, DATA).count() == counts[table] * (16 if table == "embeddings" else 1), name


def test_digests_are_of_whole_texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").join(queries.op1_sentencepiece(spark, DATA), "doc_id").collect()
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.replace("▁", " ").encode()).hexdigest() for r in rows) and np.median([r.n_tokens for r in rows]) > 50


def test_stages_take_nulls_empty_tables_and_any_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, _node int, key string, label int"
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    texts = [f"word{i} goes on here and there for a while {i * 7} ok." for i in range(40)]
    rows = [(i, t, "en", "s", 1, "x", i, "k", 2) for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None, None), (3, texts[3], "en", "s", 1, "x", 3, "k", 2), (90, "", "en", None, 0, None, 1, "k", 2), (91, "long " * 60_000, "en", "s", 1, "x", 1, "k", 2)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name == "sentencepiece":
                assert len(got) == docs.count() and out.columns[:3] == ["doc_id", "lang", "source"]
            else:
                assert out.schema == docs.schema and set(map(tuple, got)) <= set(map(tuple, table))
                docs = spark.createDataFrame(got, kind)
            assert bool(got) == bool(table)
