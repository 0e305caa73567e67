import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar import api, cli
from lodestar.operators import reports
from lodestar.sources import evidence
from lodestar.store import Conflict, Store, StoreError

NOW = datetime(2026, 10, 6)
KIND = "source_id string, source_url string, title string, text string, metadata map<string,string>, links array<string>, retrieved_at timestamp, etag string"


def documents(spark, *rows):
    return spark.createDataFrame([(s, "https://x/1", "t", json.dumps(r, indent=2), {}, [], NOW, None) for s, r in rows], KIND)


def saved(store, docs, at=NOW):
    return store.save_discovery(docs, evidence.evidence_of(evidence.located(docs)), lambda known: api.discover(docs, known, F.lit(at)))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("changes").count() == 0 and store.read("opportunities").count() == 0
    a = {"id": "1", "topicCode": "LIFE-1", "title": "Call", "status": "open", "deadline": "2026-11-01"}
    saved(store, documents(spark, ("s1", a), ("s2", a | {"id": "2"})))
    first = {t: store.read(t).count() for t in ("opportunities", "opportunity_snapshots", "notifications", "changes", "source_snapshots")}
    assert first == {"opportunities": 2, "opportunity_snapshots": 2, "notifications": 2, "changes": 0, "source_snapshots": 2} and store.read("evidence").count() > 3
    # the same batch again adds nothing; a later one adds its change
    saved(store, documents(spark, ("s1", a), ("s2", a | {"id": "2"})))
    assert {t: store.read(t).count() for t in first} == first
    saved(store, documents(spark, ("s1", a | {"deadline": "2026-12-01"})))
    assert [r.field for r in store.read("changes").collect()] == ["deadline"] and store.read("opportunity_snapshots").count() == 3
    event = store.read("notifications").first().event_id
    store.mark_delivered(event, F.lit(NOW))
    assert store.read("notifications").where("delivered_at IS NOT NULL").count() == 1


def test_store_refuses_rows_without_their_parent(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(StoreError):
        store.save_organisations(spark.createDataFrame([("w", "o")], "workspace_id string, id string"), F.lit(NOW))
    assert store.read("organisations").count() == 0  # a batch that fails leaves nothing
    store.save_organisations(spark.createDataFrame([("w", "o", "PT")], "workspace_id string, id string, country string"), F.lit(NOW), spark.createDataFrame([("w", "W")], "id string, name string"))
    store.save_organisations(spark.createDataFrame([("w", "o", 7)], "workspace_id string, id string, employees int"), F.lit(NOW))
    row = store.read("organisations").first()
    assert (row.country, row.employees) == ("PT", 7) and store.read("workspaces").count() == 1


def calls(spark, *rows):
    return spark.createDataFrame([(i, "s", f"t{i}", s) for i, s in rows], "id string, source_id string, title string, status string")


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 8)
    store.save_opportunities(calls(spark, *[(str(i), "open") for i in range(100)]), F.lit(NOW))
    before = store.snapshot()
    store.save_opportunities(calls(spark, ("7", "closed")), F.lit(NOW))
    after = store.snapshot()
    moved = [b for b, f in after.folders("opportunities").items() if before.folders("opportunities")[b] != f]
    assert len(moved) == 1 and after.read("opportunities", moved).where("id = '7'").count() == 1
    assert len(list((tmp_path / "s" / "opportunities").iterdir())) == 2
    written = sum(1 for f in (tmp_path / "s" / "opportunities" / after.folders("opportunities")[moved[0]]).rglob("b=*") if f.is_dir())
    assert written == 1
    # earlier versions stay as they were, and records keep their payloads
    assert store.read("opportunities", 1).where("status = 'closed'").count() == 0 and store.read("opportunities").where("status = 'closed'").count() == 1
    assert [json.loads(r.payload_json)["status"] for r in store.history("7").collect()] == ["open", "closed"]
    with pytest.raises(StoreError):
        store.read("opportunities", 9)


@pytest.mark.parametrize("step", [1, 4, 5])
def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch, step):
    """While A commits, B commits before A's write number step (the last ones: before and after A's manifest)."""
    a, b = (Store(spark, f"file://{tmp_path}/s", 4) for _ in range(2))
    a.save_opportunities(calls(spark, ("0", "open")), F.lit(NOW))
    count, done = 0, []
    write, put = Store._write, Store._put

    def other():
        nonlocal count
        if count == step and not done:
            done.append(b.save_opportunities(calls(spark, ("b", "open"), ("0", "closed")), F.lit(NOW)))
        count += 1

    def slow_write(self, df, path):
        if self is a:
            other()
        write(self, df, path)

    def slow_put(self, version, text):
        if self is a:
            other()
        put(self, version, text)
        if self is a:
            other()

    monkeypatch.setattr(Store, "_write", slow_write)
    monkeypatch.setattr(Store, "_put", slow_put)
    version = a.save_opportunities(calls(spark, ("a", "open"), ("0", "upcoming")), F.lit(NOW))
    if not done:
        count = step
        other()
    got = {r.id: r.status for r in a.read("opportunities").collect()}
    last = "closed" if done[0] > version else "upcoming"
    assert got == {"0": last, "a": "open", "b": "open"} and sorted([version, *done]) == [2, 3] == a.versions()[1:]
    assert [json.loads(r.payload_json)["status"] for r in a.history("0").collect()].__len__() == 3
    assert a.read("changes").count() == 2 and not [r for r in a.unparented().collect() if r.rows]


def test_a_version_is_put_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store._put(1, "{}")
    with pytest.raises(Conflict):
        store._put(1, "[]")
    assert (tmp_path / "s" / "manifest" / "000000000001.json").read_text() == "{}" and len(list((tmp_path / "s" / "manifest").glob("*.part"))) == 0


def test_change_feed_equals_a_full_comparison(spark, tmp_path):
    from lodestar.operators import changes

    store, rng = Store(spark, f"file://{tmp_path}/s", 8), random.Random(1)
    for _ in range(4):
        store.save_opportunities(calls(spark, *{str(i): (str(i), rng.choice(["open", "closed", "upcoming"])) for i in rng.choices(range(40), k=9)}.values()), F.lit(NOW))
    for old, new in ((0, 4), (1, 4), (2, 3), (4, 1), (3, 3)):
        a, b = store.read("opportunities", old), store.read("opportunities", new)
        want = {(r.opportunity_id, r.field, r.old_value, r.new_value, "changed") for r in changes.detect_changes(a, b, F.lit(NOW)).collect()}
        ids = lambda df: {r.id for r in df.select("id").collect()}
        want |= {(i, None, None, None, "created") for i in ids(b) - ids(a)} | {(i, None, None, None, "removed") for i in ids(a) - ids(b)}
        assert {(r.opportunity_id, r.field, r.old_value, r.new_value, r.kind) for r in store.change_feed(old, new, F.lit(NOW)).collect()} == want


def test_announcements(spark, tmp_path):
    """New records that are no duplicates are announced once, open ones near their deadline too; delivery is said once."""
    store = Store(spark, f"file://{tmp_path}/s", 4)
    kind = "id string, source_id string, title string, status string, deadline timestamp, duplicate_of string"
    rows = [("a", "s", "t", "open", datetime(2026, 10, 20), None), ("b", "s", "t", "open", datetime(2027, 1, 1), None), ("c", "s", "t", "open", datetime(2026, 10, 20), "a")]
    for _ in range(2):
        store.save_opportunities(spark.createDataFrame(rows, kind), F.lit(NOW))
    got = sorted((r.opportunity_id, r.event_type) for r in store.read("notifications").collect())
    assert got == [("a", "deadline_approaching"), ("a", "new_opportunity"), ("b", "new_opportunity")]
    event = store.read("notifications").first().event_id
    assert (store.mark_delivered(event, F.lit(NOW)), store.mark_delivered(event, F.lit(NOW)), store.mark_delivered("none", F.lit(NOW))) == (True, False, False)
    assert store.read("notifications").count() == 3 and store.variants("a").first().id == "c"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "landed").mkdir()
    page = "https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/LIFE-1"
    call = {"id": "1", "topicCode": "LIFE-1", "title": "Clean water", "type": "1", "status": "open", "deadlineDate": "2999-11-01", "url": page}
    (tmp_path / "landed" / "1.json").write_text(json.dumps({"total": 1, "results": [call, {"title": "x"}]}))

    def run(*arguments, code=0):
        assert cli.main(list(arguments), spark) == code
        return capsys.readouterr().out

    store = ["--store", f"file://{tmp_path}/s"]
    assert run("source", "check", "eu_funding_tenders", "--landed", str(tmp_path / "landed")) == "eu_funding_tenders: 1 accepted, 1 rejected\n"
    assert json.loads(run("source", "check", "eu_funding_tenders", "--landed", str(tmp_path / "landed"), "--json"))["report"][0]["accepted"] == 1
    assert json.loads(run("discover", "--source", "eu_funding_tenders", "--landed", str(tmp_path / "landed"), *store))["new_snapshots"] == 1
    run("organisation", "add", "--workspace-id", "w", "--workspace-name", "W", "--id", "o", "--country", "PT", "--region", "Norte", *store)
    assert json.loads(run("organisation", "show", "--workspace-id", "w", "--id", "o", *store))["country"] == "PT"
    run("organisation", "show", "--workspace-id", "x", "--id", "o", *store, code=1)
    listed = json.loads(run("opportunity", "list", "--type", "grant", *store))
    assert (listed["title"], listed["state"]) == ("Clean water", "included")
    assert run("opportunity", "list", "--type", "loan", *store) == "" != run("opportunity", "list", "--type", "loan", "--include-excluded", *store)
    assert run("changes", *store) == "" and "new_opportunity" in run("notification", "list", "--workspace-id", "w", *store)
    assess = ["assess-opportunity", "--workspace-id", "w", "--organisation-id", "o", "--opportunity-id", listed["id"], "--strategic-fit", "90", *store]
    assert run(*assess, "--output", "r.md") == "r.md\n"
    report = (tmp_path / "r.md").read_text()
    assert report.startswith("# Clean water\n") and "## Eligibility: uncertain" in report and "- strategic_fit: 90" in report and "No rules were published." not in report
    run(*assess, "--output", "r.md", code=2)
    run(*assess, "--output", "r.html", "--force")
    assert (tmp_path / "r.html").read_text().startswith("<h1>Clean water</h1>")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Deadline\n\nThe deadline of the clean water call is in May.")
    run("assess", "--corpus", str(tmp_path / "docs"), "--question", "deadline of the water call", "--question", "zzqx vvkw", "--output", "a.md")
    answer = (tmp_path / "a.md").read_text()
    assert "is in May. [ev-" in answer and "No supported answer." in answer


def test_report_names_rules_and_variants(spark):
    calls = spark.createDataFrame([("c", "Call", None, [("r1", "Must be small")])], "id string, title string, programme string, eligibility_rules array<struct<rule_id:string,reason:string>>")
    for name in ("authority", "status", "opportunity_type", "canonical_url", "deadline", "budget_total", "funding_max"):
        calls = calls.withColumn(name, F.lit(None).cast("string"))
    done = spark.createDataFrame([("o", "c", "ineligible", None, [("eligibility", 35, 0.16), ("maturity", None, 0.1)])], "organisation_id string, opportunity_id string, state string, overall int, components array<struct<name:string,score:int,weight:double>>")
    found = spark.createDataFrame([("o", "c", "r1", "ineligible", ["ev-1"])], "organisation_id string, opportunity_id string, rule_id string, state string, cited array<string>")
    other = spark.createDataFrame([("c", "v", "deadline", None, '"x"')], "canonical_id string, variant_id string, field string, canonical_value string, variant_value string")
    text = reports.assessment_report(calls, done, found, other).first().text
    assert "- ineligible: Must be small [ev-1]" in text and "## Fit: not scored" in text and "- maturity: no data (weight 0.1)" in text and '- deadline: unknown here, "x" in v' in text


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_states_meet_without_a_broadcast(spark, tmp_path, monkeypatch):
    """Files of many alike records are small: what a join holds must not follow from their size."""
    store, made = Store(spark, f"file://{tmp_path}/s", 4), []
    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, df, path: (made.append(broadcasts(df)), write(self, df, path))[1])
    for day, status in ((1, "open"), (2, "closed")):
        store.save_opportunities(calls(spark, *[(str(i), status) for i in range(50)]), F.lit(NOW.replace(day=day)))
    assert made and not any(made)
    feed = store.change_feed(1, 2, F.lit(NOW))
    assert not broadcasts(feed) and feed.count() == 50
