import os
import tempfile
from collections import Counter
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from lodestar.sources import enrichment

NOW = datetime(2026, 10, 6, tzinfo=UTC)
LOG = os.path.join(tempfile.gettempdir(), "lodestar-asked.log")
KIND = "id string, vat_number string, legal_name string, employees int, turnover double, regions array<string>, country string"


def fact(field, value, n=1, **more):
    return {"profile_field": field, "value": value, "retrieved_at": NOW, "evidence_id": f"ev-{field}-{n}", "evidence_url": "https://x/"} | more


class Provider:
    provider_id = "register"

    def note(self, vat):
        with open(LOG, "a") as f:
            f.write(f"{vat}\n")

    def enrich(self, vat):
        self.note(vat)
        if vat == "down":
            raise TimeoutError("no answer")
        if vat == "odd":
            return [fact("vat_number", "x"), fact("employees", True), fact("turnover", Decimal("NaN")), fact("regions", ["a", " "]), fact("country", "PT", provider_id="other"), fact("country", "PT", retrieved_at=datetime(2026, 1, 1)), fact("country", "PT", evidence_id=None)]
        return [fact("legal_name", f"Name of {vat}"), fact("employees", 7), fact("employees", 9, 2), fact("turnover", Decimal("12.5")), fact("regions", ("Norte", "Sul")), fact("country", "PT")]


class Many(Provider):
    def enrich_many(self, some):
        for vat in some:
            self.note(vat)
        return {v: self.__class__.__mro__[1].enrich(self, v)[:1] for v in some if v != "none"}


def asked():
    with open(LOG) as f:
        return Counter(f.read().split())


def profiles(spark):
    rows = [("a", "1", None, None, None, None, None), ("b", " 1 ", "Own", 9, None, [], "PT"), ("c", None, None, None, None, None, None), ("d", "", None, None, None, None, None), ("e", "down", None, None, None, None, None), ("f", "odd", None, None, None, None, None)]
    return spark.createDataFrame(rows * 20, KIND)


def test_each_number_is_asked_once_and_failures_are_rows(spark):
    open(LOG, "w").close()
    found = enrichment.facts(profiles(spark), "tests.test_enrichment:Provider", pause=0.001).collect()
    assert asked() == {"1": 1, "down": 3, "odd": 1}
    assert [(r.vat_number, r.error) for r in found if r.vat_number == "down"] == [("down", "TimeoutError: no answer")]
    assert [r.error for r in sorted((r for r in found if r.vat_number == "odd"), key=lambda r: r.ord)] == ["unknown_field", "wrong_type", "not_finite", "blank_item", "wrong_provider", "no_time_zone", "no_evidence"]
    known = spark.createDataFrame(found, enrichment.FACT)
    open(LOG, "w").close()
    enrichment.facts(profiles(spark), "tests.test_enrichment:Provider", known, F.lit(NOW), 1, 0.001).collect()
    assert asked() == {"down": 1, "odd": 1}


def test_unknown_fields_are_filled_with_evidence(spark):
    found = enrichment.facts(profiles(spark), "tests.test_enrichment:Provider", attempts=1)
    out = {r.id: r for r in enrichment.apply(profiles(spark), found).collect()}
    a, b = out["a"], out["b"]
    assert (a.legal_name, a.employees, a.turnover, a.regions, a.country) == ("Name of 1", 7, 12.5, ["Norte", "Sul"], "PT")
    assert sorted(a.enrichment) == ["ev-country-1", "ev-employees-1", "ev-legal_name-1", "ev-regions-1", "ev-turnover-1"]
    # known values stay, also an empty list; equal facts add their evidence
    assert (b.legal_name, b.employees, b.regions, b.country) == ("Own", 9, [], "PT") and sorted(b.enrichment) == ["ev-country-1", "ev-employees-2", "ev-turnover-1"]
    assert all(out[i].enrichment == [] and out[i].employees is None for i in "cdef")


def test_some_at_once(spark):
    open(LOG, "w").close()
    df = spark.createDataFrame([(str(i), str(i % 30)) for i in range(300)] + [("x", "none")], "id string, vat_number string")
    found = enrichment.facts(df, "tests.test_enrichment:Many", together=7).collect()
    assert sorted(r.vat_number for r in found) == sorted(map(str, range(30))) and all(r.error is None for r in found)
