"""Rule matching with unknowns, findings that need evidence, the overall state, and the weighted fit score.

Rule values are a tagged union, struct<kind, str, num, arr> with kind in str, num, arr; nothing is converted
between kinds but where a comparison of numbers reads numeric strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import squeezed, squeezed_set

#: Profile fields that rules may ask for, operators, and fit components with their weights.
PROFILE_FIELDS = ("country", "regions", "applicant_types", "company_size", "employees", "turnover", "balance_sheet", "financial_autonomy", "sectors", "activities", "certifications", "consortium_capability")
OPERATORS = ("equals", "in", "intersects", "minimum", "maximum", "present")
WEIGHTS = {
    "eligibility": 0.16, "strategic_fit": 0.17, "probability_of_winning": 0.17, "funding_attractiveness": 0.10, "application_effort": 0.08,
    "time_to_deadline": 0.07, "company_capabilities": 0.10, "consortium_readiness": 0.05, "maturity": 0.05, "evidence_completeness": 0.05,
}
VALUE = "struct<kind:string,str:string,num:decimal(38,6),arr:array<string>>"


def value(kind: str | None = None, string: Column | None = None, number: Column | None = None, array: Column | None = None) -> Column:
    """A tagged value; null if its own part is null."""
    own = {"str": string, "num": number, "arr": array}.get(kind)
    parts = F.struct(F.lit(kind).alias("kind"), (F.lit(None) if string is None else string).cast("string").alias("str"), (F.lit(None) if number is None else number).cast("decimal(38,6)").alias("num"), (F.lit(None) if array is None else array).cast("array<string>").alias("arr"))
    return F.when(own.isNotNull(), parts) if own is not None else F.lit(None).cast(VALUE)


def _number(v: Column) -> Column:
    return F.when(v["kind"] == "num", v["num"]).when(v["kind"] == "str", v["str"].try_cast("decimal(38,6)"))


def _strings(v: Column) -> Column:
    """The value's strings; null if it is a number."""
    return F.when(v["kind"] == "arr", squeezed_set(v["arr"])).when(v["kind"] == "str", F.array(squeezed(v["str"])))


def matches(operator: Column, actual: Column, expected: Column) -> Column:
    """True, false, or null where the profile says nothing or kinds can't be compared."""
    known = actual.isNotNull()
    both = known & expected.isNotNull()
    present = F.when(known, F.coalesce(~(((actual["kind"] == "str") & (actual["str"] == "")) | ((actual["kind"] == "arr") & (F.size(actual["arr"]) == 0))), F.lit(True)))
    texts = (actual["kind"] == "str") & (expected["kind"] == "str")
    numbers = (actual["kind"] != "arr") & (expected["kind"] != "arr")
    equals = F.when(texts, squeezed(actual["str"]) == squeezed(expected["str"])).when(numbers, _number(actual) == _number(expected))
    overlap = F.when((actual["kind"] != "num") & (expected["kind"] != "num"), F.arrays_overlap(_strings(actual), _strings(expected)))
    low, high = F.when(numbers, _number(actual) >= _number(expected)), F.when(numbers, _number(actual) <= _number(expected))
    return (
        F.when(operator == "present", present)
        .when(~both, F.lit(None).cast("boolean"))
        .when(operator == "equals", equals)
        .when(operator.isin("in", "intersects"), overlap)
        .when(operator == "minimum", low)
        .when(operator == "maximum", high)
    )


def finding_state(has_evidence: Column, field: Column, match: Column, remediation: Column, hard_gate: Column) -> Column:
    return (
        F.when(~has_evidence | ~field.isin(*PROFILE_FIELDS) | match.isNull(), "uncertain")
        .when(match, "eligible")
        .when(F.coalesce(remediation, F.lit("")) != "", "remediable")
        .when(hard_gate, "ineligible")
        .otherwise("uncertain")
    )


SEVERITY = {"ineligible": 3, "uncertain": 2, "remediable": 1, "eligible": 0}


def worst(state: Column) -> Column:
    """Aggregate: the most severe of the states."""
    rank = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    return F.max_by(state, F.element_at(rank, state))


def findings(pairs: DataFrame, rules: DataFrame, profile_values: DataFrame) -> DataFrame:
    """A finding for each rule of each pair, and an uncertain one for pairs whose call has no rules.

    pairs: opportunity_id, organisation_id, opp_evidence_ids; rules: opportunity_id, rule_id, profile_field,
    operator, expected, evidence_ids, hard_gate, remediation; profile_values: organisation_id, profile_field,
    actual (a value). Both joins are by key; sizes decide how they run.
    """
    x = pairs.join(rules, "opportunity_id", "left").join(profile_values, ["organisation_id", "profile_field"], "left")
    cited = F.array_intersect(F.coalesce("evidence_ids", F.array().cast("array<string>")), F.coalesce("opp_evidence_ids", F.array().cast("array<string>")))
    state = finding_state(F.size(cited) > 0, F.col("profile_field"), matches(F.col("operator"), F.col("actual"), F.col("expected")), F.col("remediation"), F.col("hard_gate"))
    return x.select("organisation_id", "opportunity_id", F.coalesce("rule_id", F.lit("no-published-rules")).alias("rule_id"), F.when(F.col("rule_id").isNull(), "uncertain").otherwise(state).alias("state"), cited.alias("cited"))


def assess(found: DataFrame) -> DataFrame:
    return found.groupBy("organisation_id", "opportunity_id").agg(worst(F.col("state")).alias("state"), F.count("*").alias("n_findings"))


def eligibility_score(state: Column) -> Column:
    return F.when(state == "eligible", 100).when(state == "remediable", 55).otherwise(35)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    out = WEIGHTS | weights
    if set(out) != set(WEIGHTS) or not all(0 <= w <= 1 for w in out.values()) or not any(out.values()):
        raise ValueError("weights must be known names with values from 0 to 1, one of them above 0")
    return out


def fit_score(state: Column, signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the components that are known, rounded half up; null if ineligible or nothing but eligibility is scored."""
    w = check_weights(weights or {})
    values = {"eligibility": eligibility_score(state)} | {n: signals.get(n, F.lit(None).cast("int")) for n in WEIGHTS if n != "eligibility"}
    used = [n for n in WEIGHTS if w[n] > 0]
    top, bottom, any_signal = F.lit(0.0), F.lit(0.0), F.lit(False)
    for n in used:
        top = top + F.when(values[n].isNotNull(), values[n] * F.lit(w[n])).otherwise(F.lit(0.0))
        bottom = bottom + F.when(values[n].isNotNull(), F.lit(w[n])).otherwise(F.lit(0.0))
        if n != "eligibility":
            any_signal = any_signal | values[n].isNotNull()
    return F.when((state != "ineligible") & any_signal, F.floor(top / bottom + F.lit(0.5)).cast("int"))


def components(state: Column, signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The ten components in their fixed order."""
    w = check_weights(weights or {})
    values = {"eligibility": eligibility_score(state)} | {n: signals.get(n, F.lit(None).cast("int")) for n in WEIGHTS if n != "eligibility"}
    return F.array(*[F.struct(F.lit(n).alias("name"), values[n].cast("int").alias("score"), F.lit(w[n]).alias("weight")) for n in WEIGHTS])


def strengths(parts: Column) -> Column:
    """Names of components with 70 or more, and of those below 50."""
    pick = lambda f: F.transform(F.filter(parts, f), lambda c: c["name"])
    return F.struct(pick(lambda c: c["score"] >= 70).alias("positive"), pick(lambda c: c["score"] < 50).alias("negative"))
