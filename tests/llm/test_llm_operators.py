import base64
import hashlib
import math
import random
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lodestar.llm import fingerprints, mixing, mtree, neardup, ordered, quality, sentencepieces, simple8b, suffixtree, toxicity, warc
from lodestar.llm.common import words
from lodestar.llm.queries import PIECES, WORDS, tokenizer_bytes

KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "  ", "a", " a ", "a  b", "a\nb\tc", "x" * 3000, "é É ß 😀 ﬁ①", "▁a ▁", "it's, don't.%% (a)", "<s> <|endoftext|> x", "a\x00b\x1cc", "ΑΣ Σ İ K é", "\r\n 　 \x85y"]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], KIND)


def prose(n, seed=1, size=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ODD + prose(60)


def test_sentencepiece(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    out = sentencepieces.encode_decode(docs(spark, texts), tokenizer_bytes(PIECES), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), table=50)
    for r in out.collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_empty_table(spark):
    assert sentencepieces.encode_decode(docs(spark, []), tokenizer_bytes(PIECES)).count() == 0


def test_word_ids_and_blocks(spark, texts, tmp_path):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS))
    source = tokenizer_bytes(WORDS).decode()
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    df = docs(spark, [texts[i] for i in order], order)
    simple8b.write(df, str(tmp_path / "ids"), lambda: simple8b.WordEncoder(source, 40).ids, end_id=2)
    rows, start = sorted(simple8b.read(spark, str(tmp_path / "ids"), with_ids=True).collect()), 0
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


#: Characters that the normaliser turns into a letter and a mark, or that are marks.
HARD = ["\u0130", *map(chr, range(0x958, 0x960)), *map(chr, range(0x9DC, 0x9E0)), *map(chr, range(0xFB1D, 0xFB4F)), *map(chr, range(0x300, 0x310)), "\u093c", "\u09bc", "\u05c1", "\u2160", "\u2460", "\u00bd", "\u212a", "\u1e9e", "\u03a3", "\u00a0", "\u2028", "\ua7c0", "\U00016e40"]


def test_word_ids_of_hard_strings():
    """50,000 strings of letters, marks, combining marks and white space have the library's ids."""
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS))
    encoder, rng = simple8b.WordEncoder(tokenizer_bytes(WORDS).decode(), 5_000), random.Random(3)
    pool = HARD * 2 + list("abcXYZ019éßИक") * 6 + list(simple8b.TAIL) * 6 + list("'-@(\"<") + [" "] * 25 + ["\n", "'s", "<|endoftext|>"]
    texts = ["\u0130.", "ক\u09df.", "\u0958.", "\ufb2a,", "হ\u09df, না"] + ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(50_000)]
    want = tok.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want) if np.frombuffer(encoder.ids(t), "<u4").tolist() != w.ids]
    assert not wrong, wrong[:5]


def test_word_ids_of_many_texts_at_once():
    """Texts of one call keep their own ids: hard strings, marks at either end, empty texts, a table that is full at once."""
    tok, rng = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS)), random.Random(4)
    encoder = simple8b.WordEncoder(tokenizer_bytes(WORDS).decode(), 300)
    pool = HARD + list("abcXYZ019éßÉ×÷ñИк") * 6 + list(simple8b.TAIL) * 8 + list("'-@(<") + [" "] * 25 + ["\n", "\t", "\r", "<|endoftext|>"]
    texts = ["", ".", "a", ",a", "a,", "é", "é.", "×.", "÷.", "ß!!", " ", "", "a. b.c, .", "É,", "\u00a0.", "x" + "." * 500 + " y"]
    texts += ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(20_000)]
    got, i = [], 0
    while i < len(texts):
        n = rng.choice([1, 2, 16, 300])
        got += encoder.all_ids(texts[i : i + n])
        i += n
    want = tok.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids]
    assert not wrong, wrong[:5]
    assert encoder.all_ids([]) == []


def test_a_full_table_keeps_the_words_in_use(monkeypatch):
    """Words that come in every call are learnt once, however often the table fills, and once with and without marks."""
    encoder, learnt = simple8b.WordEncoder(tokenizer_bytes(WORDS).decode(), 60), Counter()
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new, normal: (learnt.update(new), learn(new, normal)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(26):
        encoder.all_ids([f"common, words come; again common words! come. again q{letters[k]}{x} café, café" for x in letters])
    assert sum(learnt.values()) == 5 + 4 + 26 * 26, learnt.most_common(5)
    assert len(encoder.table) <= 60
    assert simple8b.spaced_words(["ab, ab\tab", "", ",ab é."])[0].to_pylist() == ["ab", ",", "ab", "ab", "", ",ab", "é", "."]


def test_ids_of_many_texts_as_blocks(spark, texts, tmp_path):
    tok, source = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS)), tokenizer_bytes(WORDS).decode()
    simple8b.write(docs(spark, texts), str(tmp_path / "ids"), lambda: simple8b.word_encoder(source).all_ids, end_id=2, many=True)
    rows = sorted(simple8b.read(spark, str(tmp_path / "ids"), with_ids=True).collect())
    want = [[*tok.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert [r.ids for r in rows] == want and [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_an_id_with_many_rows_has_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered.shard_bounds, "__defaults__", (4,))
    texts = [f"w{i} b c d e f g" for i in range(60)] + ["same"] * 20 + ["z y"] * 7
    ids = [5] * 60 + [5] * 20 + [1, 2, 3, 7, 8, 9, None]
    tok, source = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS)), tokenizer_bytes(WORDS).decode()
    df = docs(spark, texts, ids).repartition(3)
    simple8b.write(df, str(tmp_path / "ids"), lambda: simple8b.word_encoder(source).ids, end_id=2)
    assert spark.read.parquet(str(tmp_path / "ids")).select("shard").distinct().count() > 8
    rows = sorted(simple8b.read(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r.start)
    key = lambda t: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    want = sorted(((1 << 63) if i is None else i, key(t)) for i, t in zip(ids, texts))
    assert [((1 << 63) if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows] == want
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    # neighbours of fingerprints in the same table
    order = sorted(zip(ids, texts), key=lambda r: ((1 << 63) if r[0] is None else r[0], hashlib.sha256(r[1].encode()).digest()))
    edits = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edits[i, hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.with_next(df).collect()) == edits


def test_a_long_text(spark, tmp_path):
    """A text of 1.4 MB, longer than a block, next to an empty one."""
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(200_000))
    tok, source = tokenizers.Tokenizer.from_file(public_tokenizers.path(WORDS)), tokenizer_bytes(WORDS).decode()
    df = docs(spark, [long, "", "a b"])
    simple8b.write(df, str(tmp_path / "ids"), lambda: simple8b.word_encoder(source).ids, end_id=2)
    rows = sorted(simple8b.read(spark, str(tmp_path / "ids"), with_ids=True).collect())
    assert rows[0].ids == [*tok.encode(long, add_special_tokens=False).ids, 2] and [r.start for r in rows[1:]] == [rows[0].n_tokens, rows[0].n_tokens + 1]
    assert [r.n_chars for r in sorted(fingerprints.with_next(df).collect())] == [len(long), 0, 3]
    assert sentencepieces.encode_decode(df, tokenizer_bytes(PIECES)).where("doc_id = 0").first().n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES)).encode(long))


def test_ids_null_and_repeated(spark, tmp_path):
    df = docs(spark, ["b", "a", "b", "c"], [None, 1, 1, None])
    source = tokenizer_bytes(WORDS).decode()
    simple8b.write(df, str(tmp_path / "ids"), lambda: simple8b.word_encoder(source).ids, end_id=2)
    rows = simple8b.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 1, None, None] and [r.start for r in rows] == [0, 2, 4, 6]
    simple8b.write(docs(spark, []), str(tmp_path / "none"), lambda: simple8b.word_encoder(source).ids, end_id=2)
    assert simple8b.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 2, 239, 241, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        packed, at, values = simple8b.pack(ids)
        assert (simple8b.unpack(packed, n, at, values) == ids).all()
        assert simple8b.from_block(simple8b.to_block([5, None], [n, 0], ids))[0] == [5, None]
    assert len(simple8b.pack(np.zeros(2400, np.uint64))[0]) == 10


def test_fingerprints(spark, texts):
    order = sorted(range(len(texts)), key=lambda i: (i * 7) % len(texts))
    rows = {r.doc_id: r for r in fingerprints.with_next(docs(spark, [texts[i] for i in order], order)).collect()}
    assert len(rows) == len(texts)
    shingler = fingerprints.Shingler()
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i].fingerprint == fingerprints.to_text(fingerprints.sketch(shingler.hashes(words(t))))
        if new == t:
            assert rows[i].near_edited == 1 and rows[i].edited_fingerprint == rows[i].fingerprint
        assert 0 <= rows[i].near_next <= 1


def test_fingerprints_of_small_texts_are_exact(spark):
    """Below K shingles on both sides a likeness is the share of shared shingles, here from plain sets of words."""
    texts = prose(60, 11, 50) + ["a b c", "a b c d", "", None, "a b c"]
    part = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} - {()}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    rows = {r.doc_id: r for r in fingerprints.with_next(docs(spark, texts).withColumn("k", F.lit(1)).withColumn("shard", F.lit("x"))).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        mine, new = part(t), part(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
        assert max(len(mine | new), len(mine | part(after))) <= fingerprints.K
        assert math.isclose(rows[i].near_edited, like(mine, new)) and math.isclose(rows[i].near_next, like(mine, part(after)))
        assert rows[i].n_shingles == len(mine) and math.isclose(rows[i].in_edited, len(mine & new) / len(mine) if mine else 1, abs_tol=1e-9)


def test_fingerprints_edge_tables(spark):
    assert fingerprints.with_next(docs(spark, [])).count() == 0
    one = fingerprints.with_next(docs(spark, ["a b c d e f g h"])).first()
    assert one.near_next == 1
    same = fingerprints.with_next(docs(spark, ["x y z"] * 4, [1, 1, None, 2])).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same}) == 1


def test_merged_sketches(spark):
    """Merged over parts, a key's sketch is that of the union of its texts' shingles, by plain sets."""
    texts = prose(40, 3) + ["", None, "one two"]
    df = spark.createDataFrame([(["a", "a", "b", None][i % 4], t) for i, t in enumerate(texts)] + [("e", None)], "k string, text string").repartition(5)
    rows = {r.k: r for r in fingerprints.sketches(df, "k").collect()}
    shingler, sets = fingerprints.Shingler(), defaultdict(set)
    for r in df.collect():
        sets[r.k] |= set(shingler.hashes(words(r.text or "")).tolist())
    assert set(rows) == {"a", "b", None, "e"} and rows["e"].n_shingles == 0
    for name, found in sets.items():
        assert fingerprints.from_text(rows[name].sketch).tolist() == sorted(found)[: fingerprints.K]
        assert abs(rows[name].n_shingles - len(found)) <= 0.3 * len(found)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 12_000, dtype=np.uint64)
    a, b = pool[:8000], pool[4000:]
    sa, sb = fingerprints.sketch(a, 512), fingerprints.sketch(b, 512)
    assert abs(fingerprints.resemblance(sa, sb, 512) - 1 / 3) < 0.08 and abs(fingerprints.containment(sa, sb, 512) - 0.5) < 0.12
    assert abs(fingerprints.distinct(sa, 512) / 8000 - 1) < 0.2
    assert (fingerprints.merge(fingerprints.sketch(a[:3000]), fingerprints.sketch(a[3000:])) == fingerprints.sketch(a)).all()
    assert len(base64.b64decode(fingerprints.to_text(sa))) == 8 * 512


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 40))), "en", rng.choice(["a", "b", "é", None, "a", "zz", "C"]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, KIND)
    got = mixing.copies(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    goal, taken = expected_targets(sizes), defaultdict(int)
    assert len(got) == 3000
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9) and 0 <= r.n_copies <= 2 and r.size == len(rows[r.doc_id][1].split())
        taken[r.source] += r.n_copies * r.size
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal)
    again = mixing.copies(df.repartition(7)).collect()
    assert {(r.doc_id, r.n_copies) for r in got} == {(r.doc_id, r.n_copies) for r in again}
    mixed = mixing.mix(df.withColumn("_k0", F.lit(1)).withColumn("key", F.lit("x")))
    assert mixed.columns == [*df.columns, "_k0", "key"] and mixed.count() == sum(r.n_copies for r in got)


def test_mixing_edges(spark):
    assert mixing.copies(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    same = mixing.copies(docs(spark, ["a b"] * 5 + [None, ""], [1] * 5 + [None, None])).collect()
    assert len(same) == 7 and all(r.source_size == 10 and r.target == 15 for r in same) and 14 <= sum(r.n_copies * r.size for r in same) <= 16


def test_mixing_of_equal_rows(spark, monkeypatch):
    """A row that is a third of the table, in any cut of it: as many copies, made in parts; other rows keep theirs."""
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    rows = [(i, "a b c", "en", "s", 5) for i in range(40)] + [(7, "x y", "en", "s", 3)] * 30 + [(8, "x y", "en", "s", n) for n in (1, 2)]
    df = spark.createDataFrame(rows, KIND).withColumn("m", F.create_map(F.lit("a"), F.col("n_chars")))
    per = mixing.copies(df).groupBy("doc_id", "size").agg(F.sum("n_copies").alias("n"), F.count("*").alias("rows"))
    want = {(r.doc_id, r.size): (r.n, r.rows) for r in per.collect()}
    for cut in (1, 5):
        out = Counter((r.doc_id, r.text) for r in mixing.mix(df.repartition(cut)).collect())
        assert want[7, 2][1] == 30 and 30 <= out[7, "x y"] <= 60 and set(out) <= {(r[0], r[1]) for r in rows}
        assert abs(sum(len(t.split()) * n for (_, t), n in out.items()) - 1.5 * (120 + 60 + 4)) <= 3
    first, second = (Counter(map(str, mixing.mix(df.repartition(cut)).collect())) for cut in (2, 9))
    assert first == second


def test_pivot_keeps_mass_and_means():
    rng = random.Random(4)
    sizes, start = [3, 5, 2, 9, 4], [0.2, 0.5, 0.7, 0.4, 0.9]
    total, mean = sum(s * f for s, f in zip(sizes, start)), np.zeros(5)
    for _ in range(4000):
        out, held = mixing.pivot(sizes, start, [rng.random() for _ in sizes])
        assert math.isclose(sum(s * f for s, f in zip(sizes, out)), total) and sum(0 < f < 1 for f in out) == (held >= 0)
        mean += out
    assert np.abs(mean / 4000 - start).max() < 0.04


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 60
    pages = spark.createDataFrame([(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, "tiny"), (10, "u", "tiny"), (11, "u", None), (None, "u", big), (12, "v", "y" * 100)], "page_id long, url string, html string").withColumn("first", F.lit(0))
    path = str(tmp_path / "w")
    warc.write(pages, path)
    rows = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(rows) == 7 and rows[3].record_type == "response" and (rows[5].record_type, rows[5].refers_to) == ("revisit", 3) and rows[None].refers_to == 3
    assert rows[9].record_type == rows[10].record_type == "response" and rows[11].payload_bytes == 0
    assert rows[5].payload_bytes == len(big.encode()) and rows[5].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    raw = {r.page_id: bytes(r.record) for r in warc.records(spark, path).collect()}
    head, _, body = raw[3].partition(b"\r\n\r\n")
    size = int(head.split(b"Content-Length: ")[1])
    assert body[:size].endswith(big.encode()) and body[size:] == b"\r\n\r\n" and b"WARC-Type: revisit" in raw[5]
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_warc_of_hostile_addresses(spark, tmp_path):
    """An address that looks like header lines is one address; nothing is lost, and records part where they say."""
    same = "y" * 150
    urls = ["http://a/WARC-Refers-To: <urn:page:99>", "http://a/\u2028WARC-Payload-Digest: sha256:" + "0" * 64, "http://a/WARC-Type: response", "http://a/\r\nWARC-Type: metadata\r\n\r\n", "http://a/\u0085Content-Length: 7", "http://a/\U0001f600é%20", "", None]
    pages = [(i, u, f"page {i}" if i % 2 else same) for i, u in enumerate(urls)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == len(urls)
    for i, u, html in pages:
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 0) if i % 2 == 0 and i else ("response", None))
        assert r.url is None if not u else urllib.parse.unquote(r.url) == urllib.parse.unquote(u)
    for r in warc.records(spark, str(tmp_path / "w")).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        assert fields["WARC-Type"] == rows[r.page_id].record_type


def test_warc_of_a_wrong_length_fails(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "u", "a" * 200)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/headers").withColumn("header", F.regexp_replace("header", "Content-Length: 2(\\d\\d)", "Content-Length: 9$1")).write.parquet(f"{path}/other")
    (tmp_path / "w" / "headers").rename(tmp_path / "gone")
    (tmp_path / "w" / "other").rename(tmp_path / "w" / "headers")
    for got in (warc.read(spark, path), warc.records(spark, path)):
        with pytest.raises(Exception, match="length differs"):
            got.collect()


def test_warc_without_a_payload_fails(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").where("payload_digest <> sha2(repeat('b', 200), 256)").write.parquet(f"{path}/less")
    (tmp_path / "w" / "payloads").rename(tmp_path / "gone")
    (tmp_path / "w" / "less").rename(tmp_path / "w" / "payloads")
    for got in (warc.read(spark, path), warc.records(spark, path)):
        with pytest.raises(Exception, match="payload is missing"):
            got.collect()


def brute_classes(texts):
    shingler, parent = neardup.Shingler(), list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [neardup.multiset(shingler.hashes(words(t or ""))) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (len(bags[i][0]) and len(bags[j][0]) and neardup.similarity(bags[i], bags[j]) >= 0.8):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def near_texts():
    rng, base = random.Random(5), prose(8, 6, 120)
    out = list(ODD)
    for t in base:
        for _ in range(14):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = "new" + str(rng.random())[2:6]
            out.append(" ".join(w))
    return out + ["the same words over and over again " * 9, "the same words over and over again " * 10, "the same words over and over again " * 30] + [base[0]] * 5


def test_neardup_matches_brute_force(spark):
    texts = near_texts()
    rows = neardup.class_ids(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute_classes(texts)))
    assert all(r.class_size == sum(x.class_id == r.class_id for x in rows) for r in rows)


def test_neardup_blocks(spark, monkeypatch):
    """Members in many blocks give the same classes."""
    texts = near_texts()
    monkeypatch.setattr(neardup, "PART", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {r.doc_id: r.class_id for r in neardup.class_ids(docs(spark, texts)).collect()} == dict(enumerate(brute_classes(texts)))


def test_keep_one(spark):
    df = docs(spark, ["a b c d e f"] * 3 + ["other words are here now ok"] + [None, ""], [7, 3, 3, None, None, 9]).withColumn("label", F.lit(1)).withColumn("_node", F.lit(2))
    out = neardup.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 3, 9]
    assert neardup.class_ids(docs(spark, [])).count() == 0


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    u.sort()
    a, b = rng.integers(1, 12, 200), rng.integers(1, 12, 200)
    sig = neardup.signatures([(u, a), (u[50:], b[50:])], 4000)
    want = neardup.similarity((u, a), (u[50:], b[50:]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_suffix_tree(spark, texts):
    ids = [None if i == 3 else i for i in range(len(texts))]
    rows = suffixtree.score(docs(spark, texts, ids)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*words(t or ""), None] for t in texts]
    c = Counter(w for i, t in zip(ids, tokens) if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in rows}
    for i, t in zip(ids, tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9) and r.score < 0
    assert suffixtree.score(docs(spark, [])).count() == 0


def test_suffix_tree_beats_base_on_held_out(spark):
    rows = suffixtree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows) and sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_tree_is_a_distribution():
    data = np.frombuffer(b"".join(suffixtree.sequence(words(t)) for t in prose(200)), np.uint8)
    rows = []
    for k in range(suffixtree.DEPTH + 1):
        codes, n = np.unique(suffixtree.runs(data) & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        rows.append((codes >> np.uint64(8), (codes & np.uint64(255)).astype(int), n))
    tree = suffixtree.Tree(rows)
    assert np.allclose((10.0 ** tree.log.astype(float)).sum(1), 1, atol=1e-4) and len(tree.log) > 1


def test_score_matches_a_plain_walk_of_the_tree(spark, texts):
    """Every token by hand: known ones by their share and the bytes the tree gives, unknown ones by the share of single words."""
    texts = texts + prose(40, 21)
    rows = suffixtree.score(docs(spark, texts).withColumn("held_out", F.lit("x")).withColumn("key", F.lit(1))).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    learn = [words(t or "") for i, t in enumerate(texts) if not held(i)]
    known = Counter(w for t in learn for w in [*t, b"\n"])
    total, single = sum(known.values()), sum(n == 1 for n in known.values())
    new = (single + 1) / (total + 2)
    follows = [defaultdict(Counter) for _ in range(suffixtree.DEPTH + 1)]  # by length of context
    data = lambda t: b"\n" * suffixtree.DEPTH + b"".join(w + b" " for w in t) + b"\n"
    for t in map(data, learn):
        for i in range(suffixtree.DEPTH, len(t)):
            for k in range(suffixtree.DEPTH + 1):
                follows[k][t[i - k : i]][t[i]] += 1
    cache = {}

    def spread(context):
        """Distribution of the byte after a context."""
        if context not in cache:
            shorter = spread(context[1:]) if context else np.full(256, 1 / 256)
            n = np.zeros(256)
            for byte, c in follows[len(context)].get(context, {}).items():
                n[byte] = c
            some, kinds = n > 0, max(1, (n > 0).sum())
            far = (n[some] / n.sum() * np.log(n[some] / n.sum() / shorter[some])).sum() if n.sum() else 0
            state = not context or (n.sum() >= suffixtree.LEAST and far >= suffixtree.DIVERGENCE)
            cache[context] = (n + kinds * shorter) / (n.sum() + kinds) if state else shorter
        return cache[context]

    for r in rows:
        t, at, want = words(texts[r.doc_id] or ""), suffixtree.DEPTH, 0.0
        for w in [*t, None]:
            spelt = b"\n" if w is None else w + b" "
            logs = sum(math.log10(spread(data(t)[i - suffixtree.DEPTH : i])[data(t)[i]]) for i in range(at, at + len(spelt)))
            at += len(spelt)
            c = known[b"\n" if w is None else w]
            want += math.log10((1 - new) * ((1 - suffixtree.TREE) * c / total + suffixtree.TREE * 10**logs)) if c else math.log10(new)
        assert math.isclose(r.score, want, rel_tol=2e-5, abs_tol=2e-4), (r.doc_id, r.score, want)


def test_rare_words_meet_their_counts(spark, texts, monkeypatch):
    whole = {r.doc_id: (r.n_known, round(r.score, 4), round(r.base_score, 4)) for r in suffixtree.score(docs(spark, texts)).collect()}
    monkeypatch.setattr(suffixtree, "HOT", 3)
    monkeypatch.setattr(suffixtree.frequent, "__defaults__", (3,))
    assert whole == {r.doc_id: (r.n_known, round(r.score, 4), round(r.base_score, 4)) for r in suffixtree.score(docs(spark, texts)).collect()}


def test_tree_keeps_contexts_that_are_a_small_share(spark):
    """Contexts seen 20 times among 4 million bytes still tell the next byte."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learn = [i for i in range(2000) if i not in held]
    rows = suffixtree.score(docs(spark, ["ab " * 20_000] * 70 + ["zxqkv " * 20] * 2, [*learn[:71], held[0]])).where("held_out").collect()
    assert len(rows) == 1 and rows[0].score / rows[0].n_tokens > -1.2


def test_tree_keeps_contexts_of_all_byte_values(spark):
    """100 CJK words in a fixed order behind 63 more frequent byte values: each is told by the one before."""
    rare = " ".join(chr(0x4E00 + 211 * i) for i in range(100))
    common = " ".join(chr(c) for c in range(33, 127) if not chr(c).isupper())
    rows = suffixtree.score(docs(spark, [rare + " " + rare] * 20 + [common] * 400)).where("held_out and n_tokens > 150").collect()
    assert rows and all(r.score / r.n_tokens > -0.6 for r in rows)


def test_grown_table_equals_the_tree_in_memory(spark, texts):
    rows = docs(spark, [t or "" for t in texts]).select("text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    runs = [suffixtree.runs(np.frombuffer(suffixtree.sequence(words(t or "")), np.uint8)) for i, t in enumerate(texts) if i % 5]
    levels = []
    for k in range(suffixtree.DEPTH + 1):
        codes, n = np.unique(np.concatenate(runs) & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        levels.append((codes >> np.uint64(8), (codes & np.uint64(255)).astype(int), n))
    tree = suffixtree.Tree(levels)
    got = suffixtree.grow(suffixtree._runs(rows)).collect()
    assert len(got) > len(levels[-1][0])  # also runs of documents that are held out
    assert all(abs(r.log - tree.log[tree.at(suffixtree.DEPTH, r.run >> 8), r.run & 255]) < 1e-4 for r in got)


def test_rare_runs_meet_their_logs(spark, texts, monkeypatch):
    near = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, r.score, r.base_score) for r in df.collect())
    whole = near(suffixtree.score(docs(spark, texts)))
    for most in (0, 40):
        monkeypatch.setattr(suffixtree, "HOT_RUNS", most)
        again = near(suffixtree.score(docs(spark, texts)))
        assert [x[:2] for x in again] == [x[:2] for x in whole] and np.allclose([x[2:] for x in again], [x[2:] for x in whole], rtol=1e-5)


def toxic_corpus():
    rng, out, labels = random.Random(7), prose(400, 8, 50), []
    for i in range(400):
        bad = i % 4 == 0
        if bad:
            w = out[i].split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "blarg" + rng.choice(["", "ed", "ing"]))
            out[i] = " ".join(w)
        labels.append((i, 1, int(bad)))
    return out, labels


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(spark, [*texts, "you bl4rg!", "", None], [*range(400), 9001, 9002, None]).withColumn("score", F.lit("x"))
    rows = {r.doc_id: r for r in toxicity.scored(df, known).collect()}
    held = [r for i, r in rows.items() if i is not None and i < 400 and r.held_out]
    assert len(held) > 80 and sum(r.predicted == labels[r.doc_id][2] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values()) and rows[9001].score > rows[9002].score
    kept = toxicity.keep_clean(df, known)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())


def test_toxicity_learns_beside_an_id_of_many_rows(spark):
    texts, labels = toxic_corpus()
    hot = next(i for i in range(-1, -9, -1) if zlib.crc32(str(i).encode()) % 3 != 1)
    known = spark.createDataFrame([*labels, (hot, 1, 1)], "doc_id long, quality int, toxic int")
    once = toxicity.fit(docs(spark, [*texts, texts[0]], [*range(400), hot]), known, sample=100)
    many = toxicity.fit(docs(spark, [*texts, *[texts[0]] * 500], [*range(400), *[hot] * 500]), known, sample=100)
    assert many.trees is not None and many.scores(texts).tolist() == once.scores(texts).tolist()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs(spark, ["a", None]), none).collect()} == {0.0}
    ones = spark.createDataFrame([(0, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.scored(docs(spark, ["a", "b"]), ones).collect()} == {0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float)
    out = toxicity.Isotonic(x, y, np.ones(500))(np.sort(x))
    assert (np.diff(out) >= 0).all() and abs(out.mean() - y.mean()) < 0.05


def test_quality(spark):
    good = [". ".join(t.capitalize() for t in prose(6, i, 14)) + "." for i in range(150)]
    junk = [" ".join(w + "$$$" for w in t.split()) for t in good[:12]] + [t.upper() + "!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!" for t in good[12:24]] + [" | ".join(t.split()) for t in good[24:36]] + ["again " * 80]
    df = docs(spark, good + junk + [None, "", "Short."]).withColumn("votes", F.lit(1))
    rows = {r.doc_id: r for r in quality.scored(df).collect()}
    assert len(rows) == df.count() and all(rows[i].keep for i in range(len(good)))
    assert sum(not rows[len(good) + i].keep for i in range(len(junk))) >= len(junk) - 1
    assert rows[len(good) + len(junk) + 2].keep
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in rows.values())
    assert quality.scored(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0


def test_quality_learns_beside_an_id_of_many_rows(spark):
    good = prose(120, 9, 30)
    junk = [" ".join(w + "$$$" for w in t.split()) for t in prose(40, 10, 30)]
    many = docs(spark, [*[good[0]] * 500, *good, *junk], [*[0] * 500, *range(1, 161)])
    w = [quality.fit(many.repartition(n), sample=80).scorer.w for n in (1, 7)]
    assert (w[0] == w[1]).all()
    model = quality.fit(many.orderBy("doc_id").coalesce(1), sample=80)
    assert (model.rows(junk)[2] < 0.5).mean() > 0.9 and (model.rows(good)[2] >= 0.5).mean() > 0.9


def test_short_texts_get_no_vote_of_one_kind_of_junk():
    at = [quality.LABELLERS.index(x) for x in quality.SHARP]
    for short in ("OK!!", "C++ & C#", "a | b", "$5 @home"):
        assert [quality.votes(short)[i] for i in at] == [0] * len(at)
    assert quality.votes("WE SHOUT THIS OUT LOUD!!!!!")[quality.LABELLERS.index("shouting")] == 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    n, bad = 20_000, rng.random(20_000) < 0.15
    v = np.full((n, len(quality.LABELLERS)), 2)
    for j, name in enumerate(quality.LABELLERS):
        hit = np.where(bad, rng.random(n) < 0.4, rng.random(n) < (0.0 if name in quality.SHARP else 0.03))
        v[hit, j] = 1
        v[rng.random(n) < 0.2, j] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = quality.LabelModel(patterns, counts)
    assert abs(1 - m.prior - bad.mean()) < 0.03 and ((m.posterior(v) < 0.5) == bad).mean() > 0.95 and abs(m.rate[0, 0] - 0.4) < 0.05


def brute_top(vectors, every, k):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    return {(q, r + 1, i, s) for q in ok if q % every == 0 for r, (s, i) in enumerate([(-s, i) for s, i in sorted((-score(ok[q], ok[i]), i) for i in ok if i != q)[:k]])}


@pytest.mark.parametrize("shard", [40, 4096])
def test_mtree_matches_brute_force(spark, shard):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(600 + i, [0.5] * 8) for i in range(120)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (1100, []), (1150, [0.5] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = {tuple(r) for r in mtree.top_k(df, every=10, shard_rows=shard).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(vectors, 10, 5)


def test_mtree_ids_with_several_vectors(spark):
    """An id's score is the best of its vectors'; it is one candidate, in any shard."""
    rng = np.random.default_rng(8)
    vectors = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in rng.integers(0, 60, 400)] + [(7, [1.0] * 6)] * 3
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    quantised, best = [(i, np.floor(256 * np.array(v, float))) for i, v in vectors], defaultdict(dict)
    for q, x in quantised:
        for c, y in quantised:
            if q % 10 == 0 and c != q:
                best[q][c] = max(best[q].get(c, -(10**12)), int(x @ y))
    want = {(q, n + 1, c, s) for q, found in best.items() for n, (c, s) in enumerate(sorted(found.items(), key=lambda r: (-r[1], r[0]))[:5])}
    for shard in (20, 1000):
        assert {tuple(r) for r in mtree.top_k(df, every=10, shard_rows=shard).collect()} == want


def test_mtree_of_one_large_group(spark):
    """Half of all vectors lie close together; the pivot's second pivots part them, and trees go where they are asked for."""
    rng = np.random.default_rng(9)
    vectors = [(i, (rng.normal(size=6) * (0.01 if i % 2 else 1) + (5 if i % 2 else 0)).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in mtree.top_k(df, every=10, shard_rows=40).collect()} == brute_top(vectors, 10, 5)


def test_mtree_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], kind)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(50, [1.0])], kind)).count() == 0
    assert sorted(map(tuple, mtree.top_k(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (3, [0.5])], kind)).select("query_id", "rank", "vec_id", "score").collect())) == [(50, 1, 3, 256 * 128)]


def test_repeated_rows_do_not_move_apart(spark, tmp_path):
    """A table of which a third is one row: writers aggregate before the shuffle, and results are as for one of them."""
    text = "the same page again and again " * 9
    rows = [(1, "u", text)] * 300 + [(i, "u", f"{text} {i % 50}") for i in range(2, 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    warc.write(pages, str(tmp_path / "w"))
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 51
    kinds = Counter((r.record_type, r.payload_digest) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert sum(kinds.values()) == len(rows) and kinds["response", hashlib.sha256(text.encode()).hexdigest()] == 300
    df = docs(spark, [t for _, _, t in rows], [i for i, _, _ in rows]).repartition(6)
    kept = neardup.keep_one(df)
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, text)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_first" in plan and "row_number" not in plan


def test_topk_routes_in_blocks(spark, monkeypatch):
    """Many shards, few bytes: distances of a query or two at a time, and fewer shards where centres would not fit."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, mtree.top_k(df).collect()))
    monkeypatch.setattr(mtree, "ROUTING", 8 * 50)
    assert sorted(map(tuple, mtree.top_k(df, shard_rows=6).collect())) == want
    monkeypatch.setattr(mtree, "CENTRES", 8 * 9 * 4)
    assert sorted(map(tuple, mtree.top_k(df, shard_rows=6).collect())) == want
