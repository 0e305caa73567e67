"""Facts about organisations from providers that are told a VAT number and nothing else.

A provider is made on executors by a factory (``module:callable``): it has a ``provider_id`` and either
``enrich(vat_number)`` or ``enrich_many(vat_numbers)``, which answers some at once as a dictionary. Each distinct number
is asked once, whatever the number of profiles that carry it, and numbers with facts that are recent enough not at all.
A number whose asking fails is tried again with growing pauses, and is one row with its error in the end; a fact that
isn't as it must be is a row with its error, too, and is never applied.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Profile fields that facts may fill, and what a fact of them is: text, whole number, number or list.
FIELDS = {
    "legal_name": "str", "country": "str", "regions": "arr", "applicant_types": "arr", "company_size": "str", "employees": "int", "turnover": "num", "balance_sheet": "num", "financial_autonomy": "num",
    "sectors": "arr", "activities": "arr", "technologies": "arr", "products_services": "arr", "certifications": "arr", "export_activity": "str", "internationalisation": "str",
}
FACT = "vat_number string, ord int, profile_field string, str string, num decimal(38,6), arr array<string>, provider_id string, retrieved_at timestamp, evidence_id string, evidence_url string, error string"
NAMES = [c.split()[0] for c in FACT.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.decimal128(38, 6), pa.list_(pa.string()), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string()]
#: Numbers asked at once, attempts for each, and seconds before the second.
TOGETHER, ATTEMPTS, PAUSE = 50, 3, 0.5


def _made(factory: str) -> object:
    module, _, name = factory.partition(":")
    return getattr(importlib.import_module(module), name)()


def _patient(ask: Callable[[], object], attempts: int, pause: float) -> tuple[object, str | None]:
    for n in range(attempts):
        try:
            return ask(), None
        except Exception as e:  # a provider may fail in any way; its number becomes a row
            error = f"{type(e).__name__}: {e}"
            if n + 1 < attempts:
                time.sleep(pause * 2**n)
    return None, error


def fault(fact: Mapping, provider_id: str) -> str | None:
    """What is wrong with a fact, if anything."""
    name, value, at = fact.get("profile_field"), fact.get("value"), fact.get("retrieved_at")
    kind = FIELDS.get(name) if isinstance(name, str) else None
    if kind is None:
        return "unknown_field"
    if isinstance(value, bool) or not isinstance(value, {"str": str, "int": int, "num": (int, Decimal), "arr": (list, tuple)}[kind]):
        return "wrong_type"
    if isinstance(value, Decimal) and not value.is_finite():
        return "not_finite"
    if kind == "arr" and not all(isinstance(v, str) and v.strip() for v in value):
        return "blank_item"
    if fact.get("provider_id", provider_id) != provider_id or not 1 <= len(provider_id.strip()) <= 100:
        return "wrong_provider"
    if not isinstance(at, datetime) or at.tzinfo is None:
        return "no_time_zone"
    return None if fact.get("evidence_id") else "no_evidence"


def _rows(vat: str, said: list[Mapping], provider_id: str) -> Iterator[tuple]:
    for n, fact in enumerate(said):
        wrong = fault(fact, provider_id)
        kind, value = FIELDS.get(fact.get("profile_field")), None if wrong else fact["value"]
        at = fact.get("retrieved_at")
        yield (
            vat, n, str(fact.get("profile_field")), value if kind == "str" else None, Decimal(value) if value is not None and kind in ("int", "num") else None, list(value) if value is not None and kind == "arr" else None,
            provider_id, at if isinstance(at, datetime) and at.tzinfo else None, fact.get("evidence_id"), fact.get("evidence_url"), wrong,
        )


def facts(profiles: DataFrame, factory: str, known: DataFrame | None = None, since: Column | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE, together: int = TOGETHER) -> DataFrame:
    """FACT rows of the profiles' VAT numbers. known: facts of earlier runs; numbers with one from ``since`` on aren't asked."""
    numbers = profiles.select(F.trim("vat_number").alias("vat_number")).where(F.col("vat_number") != "").distinct()
    if known is not None:
        fresh = known.where(F.col("error").isNull() & (F.col("retrieved_at") >= since)) if since is not None else known.where(F.col("error").isNull())
        numbers = numbers.join(fresh.select("vat_number").distinct(), "vat_number", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = None
        for batch in batches:
            asked = batch.column(0).to_pylist()
            for i in range(0, len(asked), together):
                provider = provider or _made(factory)
                out: list[tuple] = []
                some = asked[i : i + together]
                many = getattr(provider, "enrich_many", None)
                answers, failed = _patient(lambda: many(some), attempts, pause) if many else ({}, None)  # noqa: B023
                for vat in some:
                    said, error = (answers.get(vat, ()), None) if many and failed is None else (None, failed) if many else _patient(lambda: provider.enrich(vat), attempts, pause)  # noqa: B023
                    out += [(vat, None, None, None, None, None, provider.provider_id, None, None, None, error)] if error else _rows(vat, list(said), provider.provider_id)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)] if out else [pa.array([], k) for k in KINDS], names=NAMES)

    return numbers.mapInArrow(ask, FACT)


def apply(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """profiles with unknown fields filled by the first fact about them, and ``enrichment``: ids of the evidence behind it.

    Known values stay; facts that say the same as a value add their evidence. A number's facts are few: a provider's
    fields. Profiles without a VAT number stay as they are.
    """
    fields = {c: k for c, k in FIELDS.items() if c in profiles.columns}
    good = found.where(F.col("error").isNull() & F.col("profile_field").isin(*fields))
    held = good.groupBy(F.col("vat_number").alias("_vat")).agg(F.array_sort(F.collect_list(F.struct("ord", "profile_field", "str", "num", "arr", "evidence_id"))).alias("_facts"))
    out = profiles.join(held, F.trim("vat_number") == F.col("_vat"), "left")
    kinds = dict(profiles.dtypes)
    of = lambda c: F.filter("_facts", lambda f: f["profile_field"] == c)
    value = lambda f, c: f[{"str": "str", "arr": "arr"}.get(fields[c], "num")].cast(kinds[c])
    final = {c: F.coalesce(F.col(c), value(F.try_element_at(of(c), F.lit(1)), c)) for c in fields}
    same = lambda c: lambda f: value(f, c).eqNullSafe(final[c])
    proofs = [F.transform(F.filter(of(c), same(c)), lambda f: f["evidence_id"]) for c in fields]
    none = F.array().cast("array<string>")
    proof = F.array_distinct(F.flatten(F.array(*[F.coalesce(p, none) for p in proofs]))) if proofs else none
    return out.select(*[final[c].alias(c) if c in fields else F.col(c) for c in profiles.columns], proof.alias("enrichment"))
