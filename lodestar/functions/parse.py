"""Loosely written values to typed ones. Whatever cannot be read is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English months in order.
MONTHS = "january february march april may june july august september october november december".split()
#: Fixed values of status texts, squeezed.
OPEN = ("open", "open for submission", "submission open", "ongoing", "aberto", "aberta", "sedia.global.openforsubmission", "31094502")
UPCOMING = ("forthcoming", "upcoming", "planned", "previsto", "prevista", "sedia.global.forthcoming", "31094501")
CLOSED = ("closed", "closed for submission", "deadline passed", "fechado", "fechada", "sedia.global.closed", "31094503")
#: Folded type names and what they mean.
TYPES = {
    "grant": "grant", "grants": "grant", "loan": "loan", "guarantee": "guarantee", "taxincentive": "tax_incentive", "financialinstrument": "financial_instrument",
    "publicprogramme": "public_programme", "tender": "tender", "repayableincentive": "repayable_incentive", "reimbursableadvance": "repayable_incentive",
}


def text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def when(c: Column) -> Column:
    """Instant of a written date; the first form that matches decides, dates are midnight UTC.

    ISO date (also compact), spreadsheet serial number 20000..80000, d/m/yyyy, d MonthName yyyy, ISO time with
    offset. A time without offset is null.
    """
    x = F.trim(c)
    midnight = lambda d: F.to_timestamp(F.concat(d.cast("string"), F.lit(" 00:00:00+00:00")))
    serial = F.when(x.rlike(r"^\d{5}(\.\d+)?$") & F.try_to_number(F.regexp_extract(x, r"^(\d{1,5})", 1), F.lit("99999")).between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(x, r"^(\d{5})", 1).try_cast("int")))
    group = lambda p, i: F.regexp_extract(x, p, i)
    built = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    slashes, named = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(group(named, 2))).cast("string")
    offset = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    return F.coalesce(
        F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), midnight(F.try_to_date(x, "yyyy-MM-dd"))),
        F.when(x.rlike(r"^\d{8}$"), midnight(F.try_to_date(x, "yyyyMMdd"))),
        midnight(serial),
        F.when(x.rlike(slashes), midnight(built(group(slashes, 3), group(slashes, 2), group(slashes, 1)))),
        F.when(x.rlike(named) & (month != "0"), midnight(built(group(named, 3), month, group(named, 1)))),
        F.when(x.rlike(offset), x.try_cast("timestamp")),
    )


def decimal(c: Column, kind: str = "decimal(38,6)") -> Column:
    """Amounts as written in Europe or with thousands points; null unless finite and at least 0."""
    x = F.regexp_replace(F.regexp_replace(c, "€", ""), r"[\s ]+", "")
    comma = F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    x = F.when(F.contains(x, F.lit(",")), comma).when(x.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x)
    value = x.try_cast(kind)
    return F.when(value >= 0, value)


def level(c: Column) -> Column:
    """An integer from 0 to 9."""
    return F.when(c.between(0, 9), c)


def strings(c: Column) -> Column:
    """Parts between |, ; and line feeds, trimmed; null if there is none."""
    parts = F.filter(F.transform(F.split(c, r"[|;\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def status(c: Column) -> Column:
    from lodestar.functions.text import squeezed

    x = squeezed(c)
    return F.when(x.isin(*OPEN), "open").when(x.isin(*UPCOMING), "upcoming").when(x.isin(*CLOSED), "closed").otherwise("unknown")


def opportunity_type(c: Column) -> Column:
    from lodestar.functions.text import key

    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key(c)), F.lit("unknown"))


def hash_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first digits of the SHA-256 of the parts, which a zero byte separates; null parts read None."""
    joined = []
    for p in parts:
        joined += [F.char(F.lit(0)), F.coalesce(p.cast("string"), F.lit("None"))]
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(*joined[1:]), 256), F.lit(length)))
