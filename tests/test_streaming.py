import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestar.operators import state
from lodestar.store import Store
from lodestar.streaming import keyed, snapshots

KIND = "source_id string, text string, source_url string, etag string, retrieved_at timestamp"
NOW = datetime(2026, 10, 6)


def rows(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([None, *x])
    return [(f"s{rng.randint(0, 2)}", f"t{rng.randint(0, 9)}", pick("u1", "u2"), pick("e1", "e2"), pick(*[NOW + timedelta(days=d) for d in range(9)])) for _ in range(n)]


def landed(spark, path, *batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_batch(spark, tmp_path):
    batches = [rows(30, i) for i in range(4)]
    landed(spark, tmp_path / "in", *batches)
    every = spark.createDataFrame([r for b in batches for r in b], KIND)
    want = {(r.source_id, r.content_hash): (r.first_seen, r.last_seen) for r in state.document_snapshots(every).collect()}
    got = snapshots.run_snapshots(spark, str(tmp_path / "in"), lambda e: e, files=1)
    assert {(r.source_id, r.content_hash): (r.first_seen, r.last_seen) for r in got.collect()} == want
    # keys that leave at once come back as new; sinks merge them to the same first and last times
    again = snapshots.run_snapshots(spark, str(tmp_path / "in"), lambda e: e, files=1, ttl_days=1e-8)
    assert {(r.source_id, r.content_hash): (r.first_seen, r.last_seen) for r in again.collect()} == want


def test_state_knows_what_it_saw(spark, tmp_path):
    """A later batch updates a key; late rows only lower its first time, and repeated ones change nothing."""
    t = lambda d: NOW + timedelta(days=d)
    landed(spark, tmp_path / "in", [("s", "x", "u1", None, t(5))])
    landed(spark, tmp_path / "in", [("s", "x", "u0", "e", t(1)), ("s", "y", None, None, None)])
    landed(spark, tmp_path / "in", [("s", "x", "u1", None, t(5)), ("s", "x", "u9", None, t(7))])
    seen = []
    for ttl, want in ((30, {("u1", True), ("u1", False), ("u9", False), (None, True)}), (1e-8, {("u1", True), ("u0", True), ("u9", True), (None, True)})):
        seen.clear()
        with keyed.keyed_state(spark):
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = keyed.snapshots(stream, ttl).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"log{ttl}")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert {(r.source_url, r.is_new) for r in seen} == want, ttl
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    assert spark.conf.get(keyed.PROVIDER, "").find("RocksDB") < 0  # other queries are not touched


def test_store_follows_a_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 8)
    batches = [rows(25, 10 + i) for i in range(3)]
    for i in range(3):
        landed(spark, tmp_path / "in", batches[i])
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        snapshots.follow_snapshots(stream, store, str(tmp_path / "log"), available_now=True).awaitTermination()
        every = spark.createDataFrame([r for b in batches[: i + 1] for r in b], KIND)
        first_last = lambda df: sorted((r.source_id, r.content_hash, r.first_seen, r.last_seen) for r in df.where("first_seen IS NOT NULL").collect())
        assert first_last(store.read("source_snapshots")) == first_last(state.document_snapshots(every))
    assert store.versions() == [1, 2, 3]


def test_events_come_once(spark, tmp_path):
    kind = "event_id string, n int"
    for i in range(3):
        spark.createDataFrame([(f"e{k % 5}", i) for k in range(20)] + [(f"own{i}", i)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = snapshots.run_events(spark, str(tmp_path / "in"), lambda e: e, files=1)
    assert sorted(r.event_id for r in got.collect()) == sorted([*(f"e{k}" for k in range(5)), *(f"own{i}" for i in range(3))])
    assert snapshots.run_events(spark, str(tmp_path / "in"), lambda e: e, files=1, ttl_days=1e-8).count() == 8


def test_nothing_to_stream_gives_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert snapshots.run_snapshots(spark, str(tmp_path / "in"), lambda e: e, schema=KIND).count() == 0
    assert snapshots.run_events(spark, str(tmp_path / "none"), lambda e: e.select(F.col("source_id").alias("event_id")), schema=KIND).count() == 0
