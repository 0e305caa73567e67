"""The command line: python -m lodestar.cli COMMAND. Each command is a function of api.py or of the store, printed.

Sources are fetched, or with --landed read from the files of a folder.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import api, settings
from lodestar.operators import eligibility, reports, retrieval
from lodestar.operators.filters import Criteria
from lodestar.sources import corpus, evidence, fetch, registry
from lodestar.store import Store

TYPES = ("grant", "repayable_incentive", "loan", "guarantee", "tax_incentive", "financial_instrument", "public_programme", "tender")
SIGNALS = tuple(n for n in eligibility.WEIGHTS if n != "eligibility")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description="Evidence-backed funding opportunities")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict], of=commands, store: bool = True) -> None:  # noqa: ANN001
        c = of.add_parser(name)
        c.set_defaults(run=run)
        if store:
            c.add_argument("--store", default=os.environ.get("LODESTAR_STORE") or "lodestar-store")
        for option, how in options:
            c.add_argument(option, **how)

    def group(name: str):  # noqa: ANN202
        return commands.add_parser(name).add_subparsers(dest="action", required=True)

    need, many = {"required": True}, {"action": "append", "default": None}
    tenant = [("--workspace-id", need), ("--organisation-id", need)]
    report = [("--output", {"default": None}), ("--format", {"choices": ("markdown", "html"), "default": None}), ("--force", {"action": "store_true"})]
    landed = [("--landed", {"default": None, "help": "folder of landed responses, instead of fetching"}), ("--query", {"default": ""}), ("--limit", {"type": int, "default": 20})]
    of = group("source")
    command("list", source_list, ("--registry", need), of=of, store=False)
    command("check", source_check, ("source_id", {"choices": sorted(fetch.ADAPTERS), "nargs": "?"}), ("--all-active", {"action": "store_true"}), ("--registry", {"default": None}), *landed, ("--json", {"action": "store_true", "dest": "as_json"}), of=of, store=False)
    command("discover", discover, ("--source", need | {"choices": sorted(fetch.ADAPTERS)}), *landed, ("--registry", {"default": None}))
    of = group("organisation")
    single = [(f"--{x}", {}) for x in ("name", "vat-number", "country", "company-size")]
    several = [(f"--{x}", many) for x in ("region", "applicant-type", "sector", "preferred-geography")]
    command("add", organisation_add, ("--workspace-id", need), ("--workspace-name", need), ("--id", need), *single, ("--employees", {"type": int}), *several, ("--preferred-type", many | {"choices": TYPES}), ("--excluded-type", many | {"choices": TYPES}), of=of)
    command("show", organisation_show, ("--workspace-id", need), ("--id", need), of=of)
    wanted = [(f"--{x}", many) for x in ("applicant-type", "region", "geography", "sector")]
    command("list", opportunity_list, ("--workspace-id", {}), ("--organisation-id", {}), ("--type", many | {"choices": TYPES}), *wanted, ("--minimum-funding", {"type": float}), ("--deadline-within-days", {"type": int}), ("--include-excluded", {"action": "store_true"}), of=group("opportunity"))
    command("changes", changes, ("--opportunity-id", {}))
    command("list", notifications, ("--workspace-id", need), ("--organisation-id", {}), of=group("notification"))
    command("assess-opportunity", assess_opportunity, *tenant, ("--opportunity-id", need), ("--weights-file", {"default": None}), *report, *[(f"--{x.replace('_', '-')}", {"type": int, "choices": range(101), "metavar": "0-100"}) for x in SIGNALS])
    command("assess", assess, ("--corpus", need), ("--question", need | {"action": "append"}), *report, store=False)
    return p


def printed(df: DataFrame) -> None:
    """A line of JSON for each row; rows stream to the driver."""
    for line in df.toJSON().toLocalIterator():
        print(line)


def scanned(spark: SparkSession, a: argparse.Namespace, source: str) -> DataFrame:
    return fetch.scan(spark, source, a.query, a.limit, a.landed)


def source_list(spark: SparkSession, a: argparse.Namespace) -> int:
    printed(api.source_list(registry.load(spark, a.registry)))
    return 0


def source_check(spark: SparkSession, a: argparse.Namespace) -> int:
    """Counts, reasons, quality and dates of a source, or of all active ones of a registry; fails where one accepts nothing.

    With --all-active, --landed names a folder that has one for each source.
    """
    if a.all_active == bool(a.source_id) or (a.all_active and not a.registry):
        raise ValueError("give a source, or --all-active with --registry")
    names = fetch.active_sources(registry.load(spark, a.registry)) if a.all_active else [a.source_id]  # four at most
    checked = {}
    for name in names:
        path = f"{a.landed}/{name}" if a.all_active and a.landed else a.landed
        try:
            found = api.source_check(fetch.scan(spark, name, a.query, a.limit, path).cache())
            checked[name] = {k: [r.asDict(True) for r in found[k].collect()] for k in ("report", "quality", "dates")}  # a row for each source
        except (AnalysisException, OSError) as e:
            checked[name] = {"report": [], "quality": [], "dates": [], "error": str(e).splitlines()[0]}
    rows = {n: c["report"][0] if c["report"] else {"accepted": 0, "rejected": 0} for n, c in checked.items()}
    ok = all(r["accepted"] for r in rows.values())
    if a.as_json:
        whole = {"sources": checked, "totals": {"sources": len(rows), "accepted": sum(r["accepted"] for r in rows.values()), "rejected": sum(r["rejected"] for r in rows.values()), "all_succeeded": ok}}
        print(json.dumps(whole if a.all_active else checked[a.source_id], default=str))
    else:
        for n, r in rows.items():
            print(f"{n}: {r['accepted']} accepted, {r['rejected']} rejected")
    return 0 if ok else 1


def discover(spark: SparkSession, a: argparse.Namespace) -> int:
    store, now = Store(spark, a.store), F.current_timestamp()
    docs = scanned(spark, a, a.source).where("reject_reason IS NULL").withColumns({"retrieved_at": now, "etag": F.lit(None).cast("string")})
    if a.registry:
        docs = registry.with_context(docs, registry.load(spark, a.registry))
        context = F.map_filter(F.create_map(*[x for n in ("source_family", "source_role", "canonical_source", "authority_relationship") for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
        docs = docs.withColumn("metadata", F.map_concat("metadata", context))
    found = store.save_discovery(docs, evidence.evidence_of(evidence.located(docs)), lambda known: api.discover(docs, known, now))
    printed(found["counts"])
    return 0


def organisation_add(spark: SparkSession, a: argparse.Namespace) -> int:
    given = {
        "workspace_id": a.workspace_id, "id": a.id, "legal_name": a.name, "vat_number": a.vat_number, "country": a.country, "company_size": a.company_size, "employees": a.employees, "regions": a.region,
        "applicant_types": a.applicant_type, "sectors": a.sector, "preferred_geographies": a.preferred_geography, "preferred_opportunity_types": a.preferred_type, "excluded_opportunity_types": a.excluded_type,
    }
    kinds = {"employees": "int"} | dict.fromkeys(("regions", "applicant_types", "sectors", "preferred_geographies", "preferred_opportunity_types", "excluded_opportunity_types"), "array<string>")
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in given))
    Store(spark, a.store).save_organisations(row, F.current_timestamp(), spark.createDataFrame([(a.workspace_id, a.workspace_name)], "id string, name string"))
    return 0


def _profile(spark: SparkSession, a: argparse.Namespace, organisation: str) -> DataFrame:
    return api.organisation_show(Store(spark, a.store).read("organisations"), a.workspace_id, organisation)


def organisation_show(spark: SparkSession, a: argparse.Namespace) -> int:
    found = _profile(spark, a, a.id)
    printed(found)
    return 1 if found.isEmpty() else 0


def opportunity_list(spark: SparkSession, a: argparse.Namespace) -> int:
    own = _profile(spark, a, a.organisation_id).first() if a.workspace_id and a.organisation_id else None
    wanted = Criteria(tuple(a.type or ()), (), tuple(a.region or ()), tuple(a.geography or ()), tuple(a.sector or ()), tuple(a.applicant_type or ()), a.minimum_funding, a.deadline_within_days, own.asDict() if own else {})
    found = api.opportunity_list(Store(spark, a.store).read("opportunities"), wanted, F.current_timestamp(), a.include_excluded)
    printed(found.select("id", "title", "status", "opportunity_type", "deadline", "state", "reasons"))
    return 0


def changes(spark: SparkSession, a: argparse.Namespace) -> int:
    printed(api.change_list(Store(spark, a.store).read("changes"), a.opportunity_id))
    return 0


def notifications(spark: SparkSession, a: argparse.Namespace) -> int:
    printed(api.notification_list(Store(spark, a.store).read("notifications"), a.workspace_id, a.organisation_id or ""))
    return 0


def _written(text: str, a: argparse.Namespace, name: str) -> None:
    """The report as Markdown or HTML, by the format asked for or the file's name; whole or not there."""
    path = a.output or f"{name}.md"
    if (a.format or ("html" if path.endswith((".html", ".htm")) else "markdown")) == "html":
        text = reports.markdown_to_html(text)
    if os.path.exists(path) and not a.force:
        raise FileExistsError(f"{path} is there already; --force replaces it")
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
    print(path)


def assess_opportunity(spark: SparkSession, a: argparse.Namespace) -> int:
    store = Store(spark, a.store)
    profile = _profile(spark, a, a.organisation_id)
    every = store.read("opportunities")
    call = every.where(F.col("id") == a.opportunity_id)
    if profile.isEmpty() or call.isEmpty():
        raise LookupError("no such organisation in the workspace, or no such opportunity")
    given = {n: getattr(a, n) for n in SIGNALS if getattr(a, n) is not None}
    pair = spark.createDataFrame([(a.organisation_id, a.opportunity_id, *given.values())], ", ".join(["organisation_id string", "opportunity_id string", *[f"{n} int" for n in given]]))
    out = api.assess(call, profile, pair, F.current_timestamp(), settings.load_weights(a.weights_file) if a.weights_file else None)
    store.save_assessments(out)
    report = reports.assessment_report(call, store.latest_assessments().where((F.col("opportunity_id") == a.opportunity_id) & (F.col("organisation_id") == a.organisation_id)), out["findings"], reports.divergence(call, every.where(F.col("duplicate_of") == a.opportunity_id)))
    _written(report.first().text, a, "lodestar-opportunity")
    return 0


def assess(spark: SparkSession, a: argparse.Namespace) -> int:
    """Answers from a folder of documents: for each question its passages, or that nothing supports an answer."""
    passages = retrieval.passages(corpus.load(spark, a.corpus)).cache()
    parts = []
    for question in a.question:
        hits = retrieval.snippets(retrieval.search(passages, question, section="section", stem="stem"), question).orderBy(F.desc("score"), F.lower("source"), "line").collect()
        sure = retrieval.MIN_CONFIDENCE <= max((0.7 * h.coverage + 0.3 * h.score / (h.score + 2.0) for h in hits[:1]), default=0.0)
        lines = [f"- {' '.join(h.excerpt.split())} [{h.evidence_id}; {h.source}, {h.location}]" for h in hits] if sure else ["No supported answer."]
        parts.append("\n".join([f"## {question}", "", *lines]))
    _written("\n\n".join(["# Assessment", *parts]) + "\n", a, "lodestar-report")
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    try:
        return a.run(spark, a)
    except (ValueError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
