import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def label(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, label(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + v[h:]
    members, stops, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
        stops[tuple(v)].append(c)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        w = len(WORD.findall(k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * w + sum(saved[x] for x in children[k])
        e = hashlib.sha256(",".join(map(str, sorted(stops[k]))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], e))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, prefixtrie.trie(df).select(*prefixtrie.COLUMNS).collect()), key=str)


def conversations(n, seed=1, turns=7, kinds=3):
    rng = random.Random(seed)
    said = ["", None, "yes", "no  no", "a b\tc\nd", "é ß 😀", "x" * 2000]
    return [(c, rng.choice([None, i, i]) if not i else i, rng.choice(["user", "assistant", None][:kinds]), rng.choice(said)) for c in range(n) for i in range(rng.randint(1, turns))]


@pytest.mark.parametrize(("most", "lot"), [(5_000, 40_000), (3, 10), (1, 1), (20, 50)])
def test_matches_brute_force(spark, monkeypatch, most, lot):
    rows = conversations(300, kinds=2)
    monkeypatch.setattr(prefixtrie, "MOST", most)
    monkeypatch.setattr(prefixtrie, "LOT", lot)
    df = spark.createDataFrame(rows, KIND).withColumn("depth", F.lit(1)).withColumn("words", F.lit("x")).withColumn("p1", F.lit(2)).repartition(5)
    assert got(df) == brute(rows)


def test_hot_sequence_and_heavy_nodes_beyond_broadcast(spark, monkeypatch):
    """A third of all conversations are one sequence, most share a first turn; heavy nodes are joined."""
    rows = [(c, i, "user", f"turn {i}" if c % 3 == 0 or i == 0 else f"own {c % 50} {i}") for c in range(1500) for i in range(4)]
    monkeypatch.setattr(prefixtrie, "MOST", 10)
    monkeypatch.setattr(prefixtrie, "AT_HAND", 0)
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_odd_rows(spark):
    """Ids that are null, negative or large, repeated rows and turns, no base, and conversations that rebuild to nothing."""
    lone = [c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(None, 1, "a", "b"), (-5, 1, "user", "a b"), (-20, None, "user", "a b"), (-20, 2, None, "c"), ((1 << 62) + 7, 0, "user", "z")]
    rows += [(c, 0, "user", "gone") for c in lone] + [(4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "user", "other"), (4, None, None, None)]
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows)
    assert got(spark.createDataFrame([], KIND)) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], KIND)) == []


def test_role_and_text_keep_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")] * 2
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_long_conversations_and_texts(spark):
    rows = [(c, i, "user", f"{i % 7}") for c in (0, 40) for i in range(3000)] + [(80, 0, "user", "word " * 200_000)]
    assert got(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_louds():
    """Parents and degrees from the bits equal those of random forests."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        parent = np.array([-1 if i == 0 or rng.random() < 0.1 else int(rng.integers(0, i)) for i in range(n)])
        level = np.zeros(n, int)
        for i in range(n):
            level[i] = 0 if parent[i] < 0 else level[parent[i]] + 1
        trie = prefixtrie.Louds(level, parent)
        at = {int(v): i for i, v in enumerate(trie.order)}
        assert len(trie.bits) == 2 * n + 1 and trie.bits.sum() == n
        assert trie.parents.tolist() == [-1 if parent[v] < 0 else at[parent[v]] for v in trie.order]
        assert trie.degrees.tolist() == [int((parent == v).sum()) for v in trie.order]
