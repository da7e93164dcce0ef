"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, html_text, lattice, minhash, packing, personal_data, quality_model, quality_rules, secret_scan, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 300_000 + "x" * 5_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank at noon", "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog near the river bank at noon", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "short", None, "a", 5),
    (None, None, None, None, None),
    (4, LONG, "zz", "b", len(LONG)),
    (5, " \n\t ", "en", "a", 4),
    (6, "\U0001f600 é \x00 \x1c mail a@b.co", "de", "c", 9),
]
BENCH = [("b1", "quick brown fox"), ("b2", None), (None, "lazy dog near"), ("b1", "quick brown fox"), ("b3", "")]

OPERATORS = {
    "token_counts": lambda s, d, b: token_counts.token_counts(d),
    "packing": lambda s, d, b: packing.pack(d),
    "decontamination": lambda s, d, b: decontamination.find_contamination(d, b),
    "drop_contaminated": lambda s, d, b: decontamination.drop_contaminated(d, b),
    "remove_spans": lambda s, d, b: decontamination.remove_spans(d, b),
    "quality_rules": lambda s, d, b: quality_rules.judge(d),
    "keep_good": lambda s, d, b: quality_rules.keep_good(d),
    "lattice": lambda s, d, b: lattice.score(d),
    "secrets": lambda s, d, b: secret_scan.find_secrets(d),
    "redact_secrets": lambda s, d, b: secret_scan.redact_secrets(d),
    "html": lambda s, d, b: html_text.extract(d.withColumnRenamed("text", "html")),
    "near_duplicates": lambda s, d, b: minhash.near_duplicates(d),
    "keep_one": lambda s, d, b: minhash.keep_one(d),
    "personal_data": lambda s, d, b: personal_data.find_personal_data(d),
    "redact_personal_data": lambda s, d, b: personal_data.redact_personal_data(d),
    "quality_model": lambda s, d, b: quality_model.score(d, quality_model.fit(d, s.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id bigint, quality int"))),
}
#: Rows that come out of ROWS, where it isn't one each.
COUNTS = {"drop_contaminated": 7, "keep_good": None, "keep_one": 8, "packing": None}
CLASH = ["n_words", "items", "content", "band", "row", "_row", "_text", "_lang", "key", "score", "spans", "piece", "n_bytes", "kept", "base", "_result", "personal_data", "held_out", "_scan0"]


def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    rows = OPERATORS[name](spark, docs, benchmark(spark)).collect()
    want = COUNTS.get(name, len(ROWS))
    assert want is None or len(rows) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id string, text string")
    assert OPERATORS[name](spark, docs, bench).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, k):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("content", F.lit("x"))
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, str(tmp_path))
        out.collect()
        assert name == "packing" or out.columns == docs.columns
