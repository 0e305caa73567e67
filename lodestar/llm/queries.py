"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import fingerprints, mixing, mtree, neardup, prefixtrie, quality, sentencepieces, simple8b, suffixtree, toxicity, warc, whitening, wrappers
from lodestar.llm.common import documents, scratch_path

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_bytes(name: str) -> bytes:
    """A public tokenizer's file. Read once on the driver and sent along: 2 MB at most."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(documents(spark, sf_dir), tokenizer_bytes(PIECES))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_ids(documents(spark, sf_dir))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(documents(spark, sf_dir))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, path = tokenizer_bytes(WORDS).decode(), scratch_path(spark, "ids")
    simple8b.write(documents(spark, sf_dir), path, lambda: simple8b.word_encoder(tokenizer).all_ids, end_id=2, many=True)
    return simple8b.read(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_fingerprints, op3_mixing, op4_warc, op5_neardup, op6_suffix_tree, op7_token_file, op8_toxicity, op9_topk, op10_quality, op11_main_text, op12_whitening, op13_prefix_trie)}

ORACLE_SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p),
             r AS (SELECT *, n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM q)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to
        FROM r""",
    "op9_topk": """
        WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(q.v, c.v) AS BIGINT)) AS score
                   FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    # these pages hold their text in an article of headings and paragraphs
    "op11_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS h FROM pages),
             b AS (SELECT page_id, url, list_transform(string_split_regex(replace(h, '<br>', ' '), '<[^>]*>'),
                          lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
                                                        '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS parts FROM a),
             t AS (SELECT page_id, url, coalesce(list_aggregate(list_filter(parts, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    # h is CRC-32 of the id's digits, bit by bit; a node's key is the digests of its turns in a row, 32 characters each
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
                   FROM conversations WHERE conv_id IS NOT NULL),
             l AS (SELECT c, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS s,
                          xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 4 AS h
                   FROM t GROUP BY c),
             r AS (SELECT a.c, list_concat(coalesce(list_slice(b.s, 1, a.h), []), list_slice(a.s, a.h + 1, len(a.s))) AS s
                   FROM l a LEFT JOIN l b ON b.c = a.c - a.c % 20),
             p AS (SELECT c, d, len(s) AS n, list_aggregate(list_transform(list_slice(s, 1, d), lambda x: x.k), 'string_agg', '') AS k, s[d].w AS w
                   FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
             m AS (SELECT d, coalesce(k, '') AS k, min(c) AS conv_id, count(*) AS n_convs, coalesce(max(w), 0) AS w,
                          sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS e
                   FROM p GROUP BY 1, 2),
             x AS (SELECT m.*, coalesce(q.n, 0) AS n_children FROM m LEFT JOIN
                   (SELECT d - 1 AS d, left(k, CAST(32 * d - 32 AS INTEGER)) AS k, count(*) AS n FROM m WHERE d > 0 GROUP BY 1, 2) q ON q.d = m.d AND q.k = m.k),
             s AS (SELECT a AS d, left(k, CAST(32 * a AS INTEGER)) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved
                   FROM x, unnest(range(0, d + 1)) AS u(a) GROUP BY 1, 2)
        SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
               CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.e AS ends_sha256
        FROM x JOIN s ON s.d = x.d AND s.k = x.k LEFT JOIN x y ON y.d = x.d - 1 AND y.k = left(x.k, CAST(32 * x.d - 32 AS INTEGER))""",
}
