import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestar import settings, sinks
from lodestar.sources import corpus


def test_settings(tmp_path):
    f = tmp_path / "env"
    f.write_text("# c\nLODESTAR_MODEL_NAME='m'\nLODESTAR_TIMEOUT_SECONDS=60\n")
    out = settings.load(str(f), {"LODESTAR_MODEL_NAME": "n", "OTHER": "x"})
    assert out["LODESTAR_MODEL_NAME"] == "n" and out["LODESTAR_TIMEOUT_SECONDS"] == "60" and "OTHER" not in out
    f.write_text("X=1")
    with pytest.raises(ValueError):
        settings.load(str(f), {})
    f.write_text('{"maturity": 0.5}')
    assert settings.load_weights(str(f))["maturity"] == 0.5
    f.write_text('{"luck": 0.5}')
    with pytest.raises(ValueError):
        settings.load_weights(str(f))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, Decimal("1.50"), "é")], "id string, b string, n decimal(38,6), c string")
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df, str(tmp_path / "t"), force=True)
    sinks.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["b"] is None
    sinks.write_report(spark.createDataFrame([("r", "x\ny")], "name string, text string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "name=r"), wholetext=True).first().value == "x\ny\n"
    p = sinks.payloads(df)
    assert list(json.loads(p.first().payload)) == ["b", "c", "id", "n"]
    assert sinks.typed(spark, p, "id string, b string, n decimal(38,6), c string").first() == df.first()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sinks.typed(spark, p.withColumn("payload", F.lit("{")), "id string").collect()


def test_pdf_needs_its_reader(spark):
    with pytest.raises(RuntimeError):
        corpus.pdf_text(spark.createDataFrame([], "path string, content binary"))
