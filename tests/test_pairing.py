"""Pairing on one small filing and its variants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import pairing
from quillspark.schema import EXTRACTION

STATEMENT = "struct<text:string,rows:array<array<string>>,scale:double,declared:boolean,share_scale:double>"
TRUTH = {"period_end": dt.date(2026, 9, 26), "fiscal_period": "Q3", "revenue": 94_900_000.0, "net_income": 5_000_000.0, "total_assets": 365e6, "cash_and_equivalents": 30e6, "stockholders_equity": 66e6, "state_of_incorporation": "CA", "shares_diluted": 15_204_137.0}


def paired(spark, truth=None, cover="For the quarter ended September 26, 2026. California", income_rows=None, **columns):
    truth = {f.name: None for f in EXTRACTION} | TRUTH | (truth or {})
    rows = income_rows if income_rows is not None else [["Net sales", "94,900"], ["Net income", "5,000"], ["Weighted average shares, diluted", "15,204,137"]]
    text = "\n".join(" | ".join(r) for r in rows)
    balance = ("Total assets | 365,000\nCash | 30,000\nEquity | 66,000", [["Total assets", "365,000"]], 1000.0, True, None)
    row = {"accession": "a", "has_document": True, "bank": False, "readable": True, "period_end": dt.date(2026, 9, 26), "fiscal_period": "Q3", "truth": tuple(truth[f.name] for f in EXTRACTION), "cover": cover, "income": (text, rows, 1000.0, True, None), "balance": balance, "auditor": ""} | columns
    schema = T.StructType([
        T.StructField("accession", T.StringType()), *[T.StructField(n, T.BooleanType()) for n in ("has_document", "bank", "readable")], T.StructField("period_end", T.DateType()), T.StructField("fiscal_period", T.StringType()),
        T.StructField("truth", EXTRACTION), T.StructField("cover", T.StringType()), *[T.StructField(n, T.DataType.fromDDL(STATEMENT)) for n in ("income", "balance")], T.StructField("auditor", T.StringType()),
    ])
    return pairing.pair(spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)).first()


def test_a_whole_filing_is_kept_and_its_share_scale_read(spark):
    got = paired(spark)
    assert (got.drop_reason, got.scale, got.share_scale, got.not_on_page) == (None, 1000.0, 1.0, [])


def test_reasons_in_order(spark):
    assert paired(spark, bank=True, has_document=False).drop_reason == "bank"
    assert paired(spark, fiscal_period="H1", readable=False).drop_reason == "no_period"
    assert paired(spark, income=None).drop_reason == "no_income_statement"
    assert paired(spark, truth={"net_income": None, "total_assets": None}).drop_reason == "truth_missing:net_income"
    assert paired(spark, truth={"cash_and_equivalents": -1.0}).drop_reason == "truth_invalid:cash_and_equivalents"
    assert paired(spark, cover="California").drop_reason == "unlocatable:period_end"
    assert paired(spark, truth={"revenue": 12e6}).drop_reason == "unlocatable:revenue"
    mixed = ("Total assets | 365", [["Total assets", "365"]], 1e6, True, None)
    assert paired(spark, balance=mixed).drop_reason == "mixed_scale"


def test_an_unprinted_share_line_becomes_null_but_a_wrong_one_drops(spark):
    assert paired(spark, income_rows=[["Net sales", "94,900"], ["Net income", "5,000"]]).not_on_page == ["shares_diluted"]
    assert paired(spark, income_rows=[["Net sales", "94,900"], ["Net income", "5,000"], ["Diluted shares", "7"]]).drop_reason == "unlocatable:shares_diluted"


def test_names(spark):
    shown = lambda name, text, states: spark.range(1).select(pairing.name_printed(F.lit(name), F.lit(text), states)).first()[0]
    assert shown("DE", "State of Delaware", True) and not shown("DE", "deny", True) and shown("Firm LLP", "signed, FIRM", False)
