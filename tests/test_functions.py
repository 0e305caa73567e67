from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from lodestar.functions import parse
from lodestar.functions import text as T


def each(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_fold_and_tokens(spark):
    assert each(spark, T.fold, ["Straße ÉÑ", "İx", None]) == ["strasse en", "ix", None]
    assert each(spark, T.plain_text, ["Olá, Múndo 2!", None]) == ["ola mundo 2", ""]
    assert each(spark, T.key, ["Código do Aviso", "topic-Code"]) == ["codigodoaviso", "topiccode"]


def test_search_text_phrases(spark):
    out = each(spark, T.search_text, ["Pequenas e Médias Empresas", "R&D and i + d", "artificial intelligence"])
    assert out == ["PME", "investigacao desenvolvimento and investigacao desenvolvimento", "ai"]


def test_normal_url(spark):
    out = each(spark, T.normal_url, ["HTTPS://Ex.org/A/?utm_source=x&b=1&ref=q#f", "https://ex.org", "https://ex.org/a//?k", None])
    assert out == ["https://ex.org/A?b=1", "https://ex.org/", "https://ex.org/a?k=", None]


def test_dates(spark):
    values = ["2026-10-05", "20261005", "46300.75", "5/10/2026", "31/02/2026", "5 October 2026", "2026-10-05T17:00:00+02:00", "2026-10-05T17:00:00", "soon", None, "99999"]
    out = each(spark, parse.when, values)
    day = datetime(2026, 10, 5)
    assert out[0] == day and out[1] == day and out[3] == day and out[5] == day
    assert out[2] == datetime(2026, 10, 5) and out[4] is None
    assert out[6] == datetime(2026, 10, 5, 15) and out[7:] == [None] * 4


def test_decimals_lists_codes(spark):
    assert each(spark, parse.decimal, ["1 500 000 €", "1.500", "1.500,5", "12.5", "-1", "x", None]) == [Decimal(1500000), Decimal(1500), Decimal("1500.5"), Decimal("12.5"), None, None, None]
    assert each(spark, parse.strings, ["a | b;;c\n", " ", None]) == [["a", "b", "c"], None, None]
    assert each(spark, parse.status, ["Open  for submission", "31094501", "FECHADO", "?"]) == ["open", "upcoming", "closed", "unknown"]
    assert each(spark, parse.opportunity_type, ["Tax incentive", "Grants", "x", None]) == ["tax_incentive", "grant", "unknown", "unknown"]
