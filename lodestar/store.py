"""The store: tables in hash buckets below a folder, each batch one version that readers see whole or not at all.

Every table is dealt to buckets by a hash of its key. A commit reads and rewrites only the buckets that hold keys of
its batch: each attempt writes them to folders of its own, never written by another, and then one manifest that
names the folder of every bucket of every table. A manifest is put where none is: of two writers of a version one
fails, reads the other's version, merges its batch into that and tries the next number. Nothing that was committed is
lost, whoever writes when, and what a failed attempt has left is read by nobody.

Folders don't change once they are named, so every version can be read as it was, and two versions differ only in
buckets whose folders differ (:meth:`Store.changed` reads no others). Merges are the functions of
operators/state.py; no join here may broadcast by the files' size. Reading with the tables' present columns is the migration: columns that old files lack are null.

Putting a manifest needs a file system that renames or links only where nothing is (HDFS, local disks). On stores
without that, commits must come from one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import changes, filters, state

PART = "struct<name:string,score:int,weight:double>"
#: Columns of the tables; opportunities have those that normalising gives.
TABLES = {
    "workspaces": "id string, name string, created_at timestamp",
    "organisations": "workspace_id string, id string, legal_name string, vat_number string, country string, company_size string, employees int, turnover double, balance_sheet double, financial_autonomy double, regions array<string>, applicant_types array<string>, sectors array<string>, activities array<string>, certifications array<string>, consortium_capability string, preferred_geographies array<string>, preferred_opportunity_types array<string>, excluded_opportunity_types array<string>, updated_at timestamp",
    "source_snapshots": "source_id string, content_hash string, first_seen timestamp, last_seen timestamp, source_url string, etag string",
    "opportunity_snapshots": "id string, hash string, payload_json string, captured_at timestamp",
    "evidence": "opportunity_id string, evidence_id string, source_id string, source_url string, `group` string, section string, start int, `end` int, excerpt string, source_hash string",
    "assessments": f"workspace_id string, organisation_id string, opportunity_id string, state string, n_findings long, overall int, components array<{PART}>, strengths struct<positive:array<string>,negative:array<string>>, assessed_at timestamp",
    "changes": "change_id string, opportunity_id string, field string, old_value string, new_value string, detected_at timestamp",
    "notifications": "event_id string, event_type string, opportunity_id string, workspace_id string, organisation_id string, created_at timestamp, payload map<string,string>, delivered_at timestamp",
}
#: What deals a table's rows to buckets. Tables about opportunities go by their id, so their buckets match.
KEYS = {
    "workspaces": ["id"],
    "organisations": ["workspace_id", "id"],
    "source_snapshots": ["source_id", "content_hash"],
    "opportunities": ["id"],
    "opportunity_snapshots": ["id"],
    "evidence": ["opportunity_id"],
    "assessments": ["workspace_id", "organisation_id", "opportunity_id"],
    "changes": ["opportunity_id"],
    "notifications": ["event_id"],
}
#: Buckets of a new store (a store keeps its own number), and attempts of a commit.
BUCKETS, ATTEMPTS = 64, 20
#: Tables whose rows need one of another table: (child, columns, parent, its columns). Null columns need none.
REFERENCES = (
    ("organisations", ["workspace_id"], "workspaces", ["id"]),
    ("evidence", ["opportunity_id"], "opportunities", ["id"]),
    ("assessments", ["workspace_id", "organisation_id"], "organisations", ["workspace_id", "id"]),
    ("assessments", ["opportunity_id"], "opportunities", ["id"]),
    ("changes", ["opportunity_id"], "opportunities", ["id"]),
    ("notifications", ["opportunity_id"], "opportunities", ["id"]),
    ("notifications", ["workspace_id", "organisation_id"], "organisations", ["workspace_id", "id"]),
)


class StoreError(ValueError):
    """A batch that would leave the store inconsistent."""


_columns: list[str] = []


def opportunity_columns(spark: SparkSession) -> str:
    """The columns of normalised records; worked out once, they don't depend on the session."""
    from lodestar.sources.evidence import normalize

    if _columns:
        return _columns[0]

    kind = "source_id string, source_url string, title string, text string, metadata map<string,string>, links array<string>, retrieved_at timestamp"
    _columns.append(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in normalize(spark.createDataFrame([], kind)).schema))
    return _columns[0]


def fitted(df: DataFrame, columns: str) -> DataFrame:
    """df with exactly these columns, missing ones null."""
    wanted = df.sparkSession.createDataFrame([], columns).schema
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


class Conflict(StoreError):
    """Another writer has committed the version that this one would have been."""


class Snapshot:
    """The tables of one version."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest
        self.version: int = manifest["version"]

    def folders(self, table: str) -> dict[int, str]:
        return {int(b): f for b, f in self.manifest["tables"].get(table, {}).items()}

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets."""
        spark, kind, found = self.store.spark, self.store.columns[table], self.folders(table)
        paths = [f"{self.store.path}/{table}/{found[b]}/b={b}" for b in sorted(found) if buckets is None or b in set(buckets)]
        return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


#: A table's part in a commit: the batch, and the new rows of the buckets that hold its keys.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """The tables below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = TABLES | {"opportunities": opportunity_columns(spark)}
        self._new_buckets = buckets

    # versions

    def _files(self) -> tuple:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, root, files = self._files()
        names = (x.getPath().getName() for x in files.globStatus(root.suffix("/*.json")) or ())
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or one by number; version 0 is the empty store."""
        done = self.versions()
        if version is None:
            version = done[-1] if done else 0
        if version == 0:
            return Snapshot(self, {"version": 0, "buckets": self._new_buckets, "tables": {}})
        if version not in done:
            raise StoreError(f"there is no version {version}")
        return Snapshot(self, json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json").first()[0]))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.snapshot(version).read(table)

    def _put(self, version: int, text: str) -> None:
        """The manifest of a version, whole, if there is none yet."""
        jvm, root, files = self._files()
        temporary, final = root.suffix(f"/{uuid.uuid4().hex}.part"), root.suffix(f"/{version:012d}.json")
        out = files.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if files.getScheme() == "file":  # a local rename would replace; a link does not
                local = lambda p: unquote(urlparse(p.toString()).path)
                try:
                    os.link(local(temporary), local(final))
                except FileExistsError as e:
                    raise Conflict(f"version {version} is there already") from e
                return
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(temporary, final, none)
            except Exception as e:
                if files.exists(final):
                    raise Conflict(f"version {version} is there already") from e
                raise
        finally:
            files.delete(temporary, False)

    def bucket(self, table: str, of: Snapshot) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in KEYS[table])), F.lit(of.manifest["buckets"])).cast("int")

    def _write(self, df: DataFrame, path: str) -> None:
        # rebalanced by bucket: a large bucket is several files, small ones share a task
        df.hint("rebalance", "b").write.partitionBy("b").parquet(path)

    def commit(self, work: Callable[[Snapshot], dict[str, tuple[DataFrame, Merge]]]) -> int:
        """The next version, from the batches that work() makes of the newest one; the version's number.

        Each table's batch comes with what merges it: merge(rows of the touched buckets, batch) gives these buckets'
        new rows. On a conflict everything is made anew from the version that won.
        """
        for _ in range(ATTEMPTS):
            try:
                return self._attempt(self.snapshot(), work)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts met other writers")

    def _attempt(self, base: Snapshot, work: Callable[[Snapshot], dict[str, tuple[DataFrame, Merge]]]) -> int:
        attempt, tables = uuid.uuid4().hex, {name: dict(x) for name, x in base.manifest["tables"].items()}
        new: dict[str, DataFrame] = {}
        for name, (batch, merge) in work(base).items():
            batch = fitted(batch, self.columns[name])
            # at most as many rows as there are buckets
            touched = sorted(r[0] for r in batch.select(self.bucket(name, base)).distinct().collect())
            if not touched:
                continue
            merged = fitted(merge(base.read(name, touched), batch), self.columns[name])
            self._write(merged.withColumn("b", self.bucket(name, base)), f"{self.path}/{name}/{attempt}")
            tables.setdefault(name, {}).update({str(b): attempt for b in touched})
            new[name] = batch
        after = Snapshot(self, {"version": base.version + 1, "buckets": base.manifest["buckets"], "tables": tables})
        for child, own, parent, theirs in REFERENCES:
            if child not in new:
                continue
            wanted = new[child].select(*own).where(F.concat(*map(F.col, own)).isNotNull()).distinct()
            as_parent = wanted.select(*[F.col(o).alias(t) for o, t in zip(own, theirs)])
            near = sorted(r[0] for r in as_parent.select(self.bucket(parent, base)).distinct().collect()) if theirs == KEYS[parent] else None
            if not state.dangling(as_parent, after.read(parent, near), theirs).isEmpty():
                raise StoreError(f"{child} without their {parent}")
        self._put(after.version, json.dumps(after.manifest))
        return after.version

    # merges

    def save_discovery(self, documents: DataFrame, evidence: DataFrame, find: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Documents' snapshots, their opportunities, changes, notifications and evidence, in one version.

        find: from the known opportunities to what api.discover() returns, called again where another writer was first.
        """
        found: dict[str, DataFrame] = {}

        def work(base: Snapshot) -> dict[str, tuple[DataFrame, Merge]]:
            found.update(find(base.read("opportunities")))
            proofs = lambda held, new: held.join(new.select("opportunity_id").distinct().hint("merge"), "opportunity_id", "left_anti").select(*held.columns).unionByName(new.dropDuplicates(["opportunity_id", "evidence_id"]))
            return {
                "source_snapshots": (state.document_snapshots(documents), _seen),
                "opportunities": (found["batch"], _replaced("id")),
                "opportunity_snapshots": (found["snapshots"], _added("id", "hash")),
                "changes": (found["changes"], _added("change_id")),
                "notifications": (found["notifications"], _added("event_id")),
                "evidence": (evidence, proofs),
            }

        self.commit(work)
        return found

    def save_source_snapshots(self, snapshots: DataFrame) -> int:
        """Sightings of documents (columns of source_snapshots) join those known: first and last, whatever their order."""
        rows = snapshots.checkpoint() if self.spark.sparkContext.getCheckpointDir() else snapshots
        return self.commit(lambda base: {"source_snapshots": (rows, _seen)})

    def save_opportunities(self, batch: DataFrame, at: Column) -> int:
        """A batch with one row for each id: their new state, snapshots, changes and notifications."""

        def work(base: Snapshot) -> dict[str, tuple[DataFrame, Merge]]:
            rows = fitted(batch, self.columns["opportunities"])
            touched = sorted(r[0] for r in rows.select(self.bucket("opportunities", base)).distinct().collect())
            out = state.save_opportunities(base.read("opportunities", touched), rows, at)
            return {"opportunities": (rows, _replaced("id")), "opportunity_snapshots": (out["snapshots"], _added("id", "hash")), "changes": (out["changes"], _added("change_id")), "notifications": (out["notifications"], _added("event_id"))}

        return self.commit(work)

    def save_assessments(self, assessed: dict[str, DataFrame]) -> int:
        """What assess() returns: a later assessment of the same pair and time replaces, events of high fit come once."""
        pair = ("workspace_id", "organisation_id", "opportunity_id", "assessed_at")
        return self.commit(lambda base: {"assessments": (assessed["assessments"].dropDuplicates(list(pair)), _replaced(*pair)), "notifications": (assessed["events"], _added("event_id"))})

    def save_organisations(self, given: DataFrame, at: Column, workspaces: DataFrame | None = None) -> int:
        """New profiles join; of known ones the values given change. workspaces: id and name of those that join or are renamed."""
        keys = ["workspace_id", "id"]

        def profiles(held: DataFrame, new: DataFrame) -> DataFrame:
            fresh = new.alias("n").join(held.alias("h").hint("merge"), keys, "left").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"h.{c}")).alias(c) for c in held.columns if c not in keys])
            return held.join(new.select(*keys).hint("merge"), keys, "left_anti").select(*held.columns).unionByName(fresh.select(*held.columns))

        def named(held: DataFrame, new: DataFrame) -> DataFrame:
            fresh = new.drop("created_at").join(held.select("id", "created_at").hint("merge"), "id", "left").select("id", "name", F.coalesce("created_at", at).alias("created_at"))
            return held.join(new.select("id").hint("merge"), "id", "left_anti").select(*held.columns).unionByName(fresh)

        tables: dict[str, tuple[DataFrame, Merge]] = {} if workspaces is None else {"workspaces": (workspaces, named)}
        return self.commit(lambda base: tables | {"organisations": (given.withColumn("updated_at", at), profiles)})

    def mark_delivered(self, event_id: str, at: Column) -> bool:
        """Whether the event was there and not delivered before; only its bucket is read."""
        key = self.spark.createDataFrame([(event_id,)], "event_id string")
        found = False

        def work(base: Snapshot) -> dict[str, tuple[DataFrame, Merge]]:
            nonlocal found
            near = [r[0] for r in key.select(self.bucket("notifications", base)).collect()]
            event = base.read("notifications", near).where((F.col("event_id") == event_id) & F.col("delivered_at").isNull())
            found = not event.isEmpty()
            return {"notifications": (event, lambda held, _: filters.mark_delivered(held, event_id, at))} if found else {}

        base = self.snapshot()
        if not work(base):
            return False
        self.commit(work)
        return found

    # reads

    def latest_assessments(self) -> DataFrame:
        return state.keep_latest(self.read("assessments"), ["workspace_id", "organisation_id", "opportunity_id"], [F.desc("assessed_at")])

    def history(self, opportunity_id: str | None = None) -> DataFrame:
        """id, hash, payload_json and captured_at of every state a record has had, in order."""
        out = self.read("opportunity_snapshots")
        return (out if opportunity_id is None else out.where(F.col("id") == opportunity_id)).orderBy("id", "captured_at", "hash")

    def variants(self, opportunity_id: str) -> DataFrame:
        return state.variants(self.read("opportunities"), opportunity_id)

    def unparented(self) -> DataFrame:
        """child, parent and rows: what the references between tables would miss."""
        now, out = self.snapshot(), None
        for child, own, parent, theirs in REFERENCES:
            rows = now.read(child).where(F.concat(*map(F.col, own)).isNotNull())
            lost = state.dangling(rows.select(*[F.col(o).alias(t) for o, t in zip(own, theirs)]), now.read(parent), theirs)
            one = lost.agg(F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.count("*").alias("rows"))
            out = one if out is None else out.unionByName(one)
        return out

    def changed(self, table: str, old: int, new: int) -> tuple[DataFrame, DataFrame]:
        """The table at two versions, in those buckets only that were written between them."""
        a, b = self.snapshot(old), self.snapshot(new)
        x, y = a.folders(table), b.folders(table)
        touched = [n for n in sorted(set(x) | set(y)) if x.get(n) != y.get(n)]
        return a.read(table, touched), b.read(table, touched)

    def change_feed(self, old: int, new: int, at: Column) -> DataFrame:
        """Field changes of opportunities between any two versions, and ``kind``: created, changed or removed.

        Only buckets that were written in between are read; rows that are the same on both sides drop out by hash
        before their fields are compared.
        """
        before, after = self.changed("opportunities", old, new)
        hashed = lambda df: df.select("*", state.stable_hash(df).alias("_hash"))
        a, b = hashed(before), hashed(after)
        same = a.select("id", "_hash").join(b.select("id", "_hash").hint("merge"), ["id", "_hash"])
        a, b = (df.join(same.hint("merge"), ["id", "_hash"], "left_anti").drop("_hash").select(*before.columns) for df in (a, b))
        rows = changes.detect_changes(a, b, at).withColumn("kind", F.lit("changed"))
        only = lambda x, y, kind: x.join(y.select("id").hint("merge"), "id", "left_anti").select(F.col("id").alias("opportunity_id"), F.lit(kind).alias("kind"))
        return rows.unionByName(only(b, a, "created"), allowMissingColumns=True).unionByName(only(a, b, "removed"), allowMissingColumns=True)


def _replaced(*keys: str) -> Merge:
    """Rows of the batch replace those with their keys."""
    return lambda held, new: held.join(new.select(*keys).hint("merge"), list(keys), "left_anti").select(*held.columns).unionByName(new)


def _seen(held: DataFrame, new: DataFrame) -> DataFrame:
    last = F.struct("last_seen", "source_url", "etag")
    return new.unionByName(held).groupBy("source_id", "content_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("source_url", last).alias("source_url"), F.max_by("etag", last).alias("etag"))


def _added(*ids: str) -> Merge:
    """Rows of the batch whose ids the table lacks join it; replays add nothing."""
    return lambda held, new: held.unionByName(new.dropDuplicates(list(ids)).join(held.select(*ids).hint("merge"), list(ids), "left_anti").select(*held.columns))
