"""Operators on small cases with known answers."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers, costing, grading, hashing, statistics, text
from quillspark.operators import facts, reports, runs, sampling, splits, statements
from quillspark.schema import FACT, FIELDS, field_dim
from quillspark.sources import filings, markup, sinks
from quillspark.streaming import logs

DAY = dt.date.fromisoformat


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def grade(spark, kind, p, t, scale=1000.0, share=None, others=()):
    lit = lambda x: F.lit(x).cast("double")
    other = F.array(*[F.lit(float(o)) for o in others]) if others else F.expr("cast(array() as array<double>)")
    return value(spark, grading.grade_number(F.lit(kind), lit(p), lit(t), lit(scale), lit(share), other))


@pytest.mark.parametrize(
    ("kind", "p", "t", "kw", "want"),
    [
        ("monetary", 1_235_000_000, 1_234_600_000, {"scale": 1e6}, "correct"),
        ("monetary", 0, 300, {}, "correct"),
        ("per_share", -0.3055, -0.31, {}, "correct"),
        ("per_share", -0.32, -0.31, {}, "wrong_value"),
        ("share_count", 146e6, 145.8e6, {"share": 1e6}, "correct"),
        ("share_count", 729_950_000, 729_341_000, {"others": [729_950_000]}, "wrong_period"),
        ("share_count", 146.0e6, 145.8e6, {"share": 1e6, "others": [146.1e6]}, "correct"),
        ("monetary", 913.4e6, 1.4e9, {}, "wrong_value"),
        ("monetary", 5e6, 0, {}, "wrong_value"),
        ("monetary", -5e8, 5e8, {}, "sign"),
        ("monetary", 5e5, 5e8, {}, "scale"),
        ("monetary", None, 5e8, {}, "missing"),
        ("monetary", 5e8, None, {}, "hallucinated"),
        ("monetary", None, None, {}, "correct"),
        ("monetary", float("nan"), 5e8, {}, "malformed"),
    ],
)
def test_grading(spark, kind, p, t, kw, want):
    assert grade(spark, kind, p, t, **kw) == want


def test_unparsed_answers_are_malformed_even_without_a_truth(spark):
    null = F.lit(None)
    args = [F.lit("monetary"), null.cast("double"), null.cast("string"), null.cast("double"), null.cast("string"), F.lit(1.0), null.cast("double"), F.expr("cast(null as array<struct<num:double,str:string>>)")]
    assert value(spark, grading.grade_field(*args, F.lit(False))) == "malformed"
    assert value(spark, grading.grade_field(*args, F.lit(True))) == "correct"


@pytest.mark.parametrize(("a", "b"), [("DELOITTE AND TOUCHE, L.L.P.", "Deloitte & Touche LLP"), ("Société Générale, S.A.", "société générale sa"), ("Inc. LLC", "")])
def test_names_fold(spark, a, b):
    assert value(spark, grading.normalise_name(F.lit(a))) == value(spark, grading.normalise_name(F.lit(b)))


def test_printed_numbers_and_dates(spark):
    assert value(spark, text.printed_numbers(F.lit("a 1,234.5 | - | 7"))) == [1234.5, 7.0, 0.0]
    assert value(spark, text.printed_numbers(F.lit("a-b 3"))) == [3.0]
    forms = value(spark, text.date_forms(F.lit("2026-09-05").cast("date")))
    assert len(forms) == 13 and "Sept. 05, 2026" in forms and "9/5/2026" in forms
    assert len(value(spark, text.date_forms(F.lit("2026-03-31").cast("date")))) == 9
    for shown in ("2026-09-05", "September 5, 2026", "5 SEPTEMBER 2026", "9/5/2026", "September 5 , 2026"):
        assert value(spark, text.parse_date(F.lit(shown))) == DAY("2026-09-05"), shown
    assert value(spark, text.parse_date(F.lit("soon"))) is None
    assert value(spark, text.share_count_row(F.lit("Weighted-average shares used in net loss per share"))) is True
    assert value(spark, text.share_count_row(F.lit("Net loss per share, basic"))) is False


def staircase_break_even(rate, rps, api, fixed, u):
    c, g, k = rps * 3600 * 730.5 * u, rate * 730.5, 1
    while k < 10_000:
        need = (k * g + fixed) / api
        if need <= k * c:
            return k, max(need, (k - 1) * c)
        if g / c >= api:
            return None
        k += 1
    return None


def test_break_even_equals_the_search_over_machines(spark):
    cases = [(r, s, a, f, u) for r in (0.3, 1.0) for s in (0.001, 0.5, 1.0) for a in (0.002, 0.003, 0.01) for f in (0.0, 250.0, 1000.0, 5000.0) for u in (0.1, 0.5, 0.9)]
    df = spark.createDataFrame(cases, "r double, s double, a double, f double, u double")
    for row in df.select("*", costing.break_even(*[F.col(c) for c in "rsafu"]).alias("b")).collect():
        want = staircase_break_even(*row[:5])
        assert (row.b.gpus, row.b.volume) == ((None, None) if want is None else (want[0], pytest.approx(want[1])))
    assert df.where("r = 1 and s = 1 and a = 0.003 and f = 1000 and u = 0.1").select(costing.break_even(*[F.col(c) for c in "rsafu"])["gpus"]).first()[0] == 18


def test_quantiles_and_intervals(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert [df.agg(statistics.nearest_rank("v", p)).first()[0] for p in (50, 99, 100, 1)] == [50, 99, 100, 1]
    four = spark.createDataFrame([(5.0,), (1.0,), (9.0,), (3.0,)], "v double")
    assert four.agg(statistics.nearest_rank("v", 99), statistics.upper_median("v")).first()[:] == (9, 5)
    w = value(spark, statistics.wilson(F.lit(6), F.lit(200)))
    assert (round(w.point, 3), round(w.low, 3), round(w.high, 3)) == (0.03, 0.014, 0.064)
    rows = spark.createDataFrame([("a", i, float(i % 3)) for i in range(50)], "g string, k int, v double")
    got = statistics.numpy_bootstrap(rows, ["g"], "k", "v", 1000, 7).first()
    v = np.array([float(i % 3) for i in range(50)])
    means = v[np.random.default_rng(7).integers(0, 50, size=(1000, 50))].mean(axis=1)
    assert (got.low, got.high) == tuple(np.percentile(means, [2.5, 97.5]))


def test_blake2b_fraction(spark):
    got = value(spark, hashing.blake2b_fraction(5, F.lit(12)))
    assert got == int.from_bytes(hashlib.blake2b(b"5:12", digest_size=8).digest(), "big") / 2**64


def test_splits_leave_no_company_in_two_pools(spark):
    start = DAY("2025-01-15")
    rows = [(f"{c}-{k}", c, start + dt.timedelta(days=91 * k), "s" + str(c % 3)) for c in range(200) for k in range(8)]
    df = spark.createDataFrame(rows, "item_id string, cik int, filed date, stratum string")
    assigned = splits.assign_splits(df, splits.assign_pools(df, "cik", "stratum"), "cik", "filed", "2026-10-01").cache()
    splits.check_no_leakage(assigned, "cik")
    assert assigned.where("split is null and pool = 'test'").isEmpty() and assigned.where("split in ('train', 'validation') and filed > '2026-10-01'").isEmpty()
    report = {r.split: r for r in splits.split_report(assigned, "cik").collect()}
    assert sum(r.filings for r in report.values()) == 1600 and report["test_pre_cutoff"].companies == report["test_post_cutoff"].companies == 39
    leaky = spark.createDataFrame([(1, "train"), (1, "test_pre_cutoff")], "cik int, split string")
    with pytest.raises(ValueError):
        splits.check_no_leakage(leaky, "cik")
    with pytest.raises(ValueError):
        splits.require_splits(leaky, ["train"])


Q3 = ("2026-09-26", "Q3")
REVENUE = "us-gaap:Revenues"


def fact_rows(*rows):
    return [(i, c, "USD", v, None, DAY(s) if s else None, DAY(e), "a", "10-Q", DAY("2026-10-30")) for i, (c, v, s, e) in enumerate(rows)]


def selected(spark, rows, period, field="revenue"):
    report = spark.createDataFrame([("a", DAY(period[0]), period[1])], "accession string, period_end date, fiscal_period string")
    found = facts.candidates(spark.createDataFrame(rows, FACT), report, field_dim(spark).where(F.col("field") == field))
    row = facts.select_facts(found).first()
    return (None, []) if row is None else (row.num_value, sorted(o.num for o in row.others))


def test_the_quarter_is_chosen_and_the_other_columns_are_distractors(spark):
    rows = fact_rows((REVENUE, 94.9e9, "2026-06-28", "2026-09-26"), (REVENUE, 294.9e9, "2025-12-28", "2026-09-26"), (REVENUE, 89.5e9, "2025-06-29", "2025-09-27"), (REVENUE, 274.5e9, "2024-12-29", "2025-09-27"))
    assert selected(spark, rows, Q3) == (94.9e9, [89.5e9, 274.5e9, 294.9e9])
    year = fact_rows((REVENUE, 100e9, "2026-06-28", "2026-09-26"), (REVENUE, 390e9, "2025-09-22", "2026-09-26"))
    assert selected(spark, year, ("2026-09-26", "FY"))[0] == 390e9
    late = fact_rows((REVENUE, 1.0, "2026-06-28", "2026-06-30"))
    assert selected(spark, late, Q3) == (None, [1.0])
    assets = fact_rows(("us-gaap:Assets", 365e9, None, "2026-09-26"), ("us-gaap:Assets", 352e9, None, "2025-09-27"))
    assert selected(spark, assets, Q3, "total_assets") == (365e9, [352e9])


def test_run_checks(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    log = spark.createDataFrame([("a", True, "x"), ("b", False, None)], "item_id string, ok boolean, text string")
    graded, failed = runs.grade_run(log, items, "item_id")
    assert graded.count() == 1 and failed == 1
    assert [r.item_id for r in sampling.unanswered(items, log, "item_id").collect()] == ["b"]
    with pytest.raises(ValueError):
        runs.grade_run(log, items.where("item_id = 'a'"), "item_id")
    with pytest.raises(ValueError):
        runs.paired_differences(log.withColumn("v", F.lit(1)), items.where("item_id = 'a'").withColumn("v", F.lit(1)), ["item_id"], "v").count()
    with pytest.raises(ValueError):
        runs.require_disjoint(log, items, "item_id")


def test_load_summary(spark):
    rows = [(1, i / 10, i / 10 + (i + 1) / 1000, i / 10 + 0.1, 50, True) for i in range(100)]
    t = spark.createDataFrame(rows, "concurrency int, sent_at double, first_token_at double, done_at double, output_tokens bigint, ok boolean")
    r = runs.load_summary(t, ["concurrency"], 0.0).first()
    assert (round(r.window_s, 6), round(r.requests_per_second, 6), round(r.tokens_per_second, 6), round(r.ttft_p50_ms), round(r.ttft_p99_ms), round(r.e2e_p99_ms)) == (10, 10, 500, 50, 99, 100)
    cut = runs.load_summary(t, ["concurrency"], 1.0).first()
    assert (cut.requests, round(cut.window_s, 6), round(cut.ttft_p50_ms)) == (90, 9, 55)
    bad = runs.load_summary(t.withColumn("ok", F.col("sent_at") < 9), ["concurrency"], 0.0).first()
    assert (bad.errors, round(bad.requests_per_second, 6)) == (10, 9)


def test_pareto_keeps_equal_points(spark):
    p = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, 0.5), (3, 2.0, 0.5), (4, 2.0, 0.7), (5, 3.0, 0.6)], "i int, c double, a double").withColumn("g", F.lit(0))
    assert sorted(r.i for r in reports.pareto_front(p, ["g"], "c", "a").collect()) == [1, 2, 4]


INDEX = """Form Type   Company Name
------------------------------------------------------------------------------------------------------------------------
1                Northern Lantern Holdings, Inc.                               2000001     2025-03-14  edgar/data/2000001/9999999999-25-000001.txt
10-Q             1 900 PARCELS CO                                              1000002     2025-01-30  edgar/data/1000002/0001000002-25-000012.txt
SC 13G/A         GAMMA  WORKS, LLC /DE/                                        700003      2025-02-11  edgar/data/700003/0000700003-25-000007.txt"""


def test_form_index(spark, tmp_path):
    (tmp_path / "form.idx").write_text(INDEX)
    rows = filings.read_form_index(spark, str(tmp_path)).collect()
    assert [(r.form, r.company, r.cik, str(r.filed)) for r in rows] == [("1", "Northern Lantern Holdings, Inc.", 2000001, "2025-03-14"), ("10-Q", "1 900 PARCELS CO", 1000002, "2025-01-30"), ("SC 13G/A", "GAMMA  WORKS, LLC /DE/", 700003, "2025-02-11")]
    assert rows[1].accession == "0001000002-25-000012"
    with pytest.raises(ValueError):
        filings.form_index(spark.createDataFrame([("nothing",)], "value string"))


def test_company_facts_and_history(spark):
    entry = {"end": "2026-01-02", "val": 5, "accn": "x", "form": "10-K", "filed": "2026-02-01"}
    payload = {"sic": "6021", "facts": {"us-gaap": {"Assets": {"units": {"USD": [entry, {"end": "2026-01-02", "val": 1}]}}}, "dei": {"Name": {"units": {"": [entry | {"val": "Q1", "filed": None}]}}}}, "filings": {"recent": {"accessionNumber": ["a", "b", "c"], "primaryDocument": ["a.htm", ""]}, "files": [{"name": "p1", "filingTo": "2020-01-01"}, {"name": "p2", "filingTo": "2025-01-01"}]}}
    df = spark.createDataFrame([(json.dumps(payload),)], "value string")
    got = {(r.concept, r.num_value, r.str_value, str(r.filed)) for r in filings.company_facts(df).collect()}
    assert got == {("us-gaap:Assets", 5.0, None, "2026-02-01"), ("dei:Name", None, "Q1", "2026-01-02")}
    assert [tuple(r) for r in filings.primary_documents(df).collect()] == [("a", "a.htm")]
    assert [r.name for r in filings.history_pages(df, "2024-06-01").collect()] == ["p2"]
    assert df.select(filings.industry_code(F.col("value"))).first()[0] == 6021
    assert [r.quarter for r in filings.quarters(spark, "2024Q3", "2025Q2").orderBy("start").collect()] == ["2024Q3", "2024Q4", "2025Q1", "2025Q2"]


PAGE = """<html><head><title>t</title></head><body><p>ACME CORP</p><!-- c --><p>CONSOLIDATED STATEMENTS OF OPERATIONS</p><p>(in thousands, except per share data)</p>
<div style="display: none"><p>987,654</p></div><table><tr><td>Net sales</td><td>$</td><td>1,200</td></tr><tr><td>Operating income</td><td>(</td><td>300</td><td>)</td></tr><tr><td>Net income</td><td>250</td><td>240</td></tr>
<tr><td>Net income per share</td><td>0.31</td></tr><tr><td>Weighted-average shares</td><td>800</td></tr></table><p>The auditor</p><p>Firm LLP</p><p>We have served as the Company's auditor since 2012.</p><p>Boston</p></body></html>"""


def test_blocks_and_statements(spark):
    b = markup.blocks(spark.createDataFrame([("f", PAGE)], "filing string, html string")).cache()
    rows = b.orderBy("idx").collect()
    assert "987,654" not in str(rows) and rows[0].text == "ACME CORP"
    table = next(r.rows for r in rows if r.rows)
    assert table[0] == ["Net sales", "$1,200"] and table[1] == ["Operating income", "(300)"]
    found = statements.locate_statement(b, "filing", "income").first()
    assert found.heading == ["CONSOLIDATED STATEMENTS OF OPERATIONS", "(in thousands, except per share data)"] and (found.scale, found.declared, found.share_scale) == (1000.0, True, None)
    assert statements.locate_statement(b, "filing", "balance").count() == 0
    assert statements.auditor(b, "filing").first().auditor.split("\n")[-3:] == ["Firm LLP", "We have served as the Company's auditor since 2012.", "Boston"]
    assert statements.cover(b, "filing").first().cover.startswith("ACME CORP\nCONSOLIDATED")
    assert value(spark, statements.scales(F.lit("(in millions, except share and per share data)")))[:] == (1e6, True, 1.0)


def test_tagged_facts(spark):
    page = '<xbrli:context id="c1"><xbrli:period><xbrli:startDate>2026-01-01</xbrli:startDate><xbrli:endDate>2026-03-31</xbrli:endDate></xbrli:period></xbrli:context><xbrli:context id="c2"><xbrli:segment>s</xbrli:segment><xbrli:instant>2026-03-31</xbrli:instant></xbrli:context><p><ix:nonNumeric name="dei:DocumentPeriodEndDate" contextRef="c1">March 31, 2026</ix:nonNumeric><ix:nonNumeric name="dei:EntityIncorporationStateCountryCode" contextRef="c1">Delaware</ix:nonNumeric><ix:nonNumeric name="dei:AuditorName" contextRef="c2">x</ix:nonNumeric></p>'
    rows = markup.tagged_facts(spark.createDataFrame([("a", page)], "accession string, html string"), "html", ["accession"]).orderBy("ordinal").collect()
    assert [(r.concept, r.value, str(r.end)) for r in rows] == [("dei:DocumentPeriodEndDate", "2026-03-31", "2026-03-31"), ("dei:EntityIncorporationStateCountryCode", "DE", "2026-03-31")]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('```json\n{"revenue": 5, "auditor_name": "X"}\n```', {"revenue": 5.0, "auditor_name": "X"}),
        ('{"revenue": " 1e3 ", "period_end": "2026-01-02T00:00:00"}', {"revenue": 1000.0, "period_end": DAY("2026-01-02")}),
        ('{"revenue": true}', {"revenue": 1.0}),
        ('{"period_end": 86400}', {"period_end": DAY("1970-01-02")}),
        ('{"revenue": "1,234"}', None), ('{"revenue": 1, "other": 2}', None), ("no answer", None), ('{"total_assets": -1}', None), ('{"auditor_name": 3}', None), ('{"fiscal_period": "H1"}', None), ("[1]", None), (None, None),
    ],
)
def test_answers_are_validated_whole(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "t string").select(answers.parse_extraction("t").alias("v")).first().v
    assert got is None if want is None else {k: v for k, v in got.asDict().items() if v is not None} == want


def test_canonical_answer(spark):
    got = spark.createDataFrame([('{"revenue": 5, "eps_basic": -0.31, "auditor_name": "A \\"q\\"", "period_end": "2026-01-02"}',)], "t string").select(answers.canonical(answers.parse_extraction("t")).alias("v")).first().v
    want = dict.fromkeys(f[0] for f in FIELDS) | {"revenue": 5, "eps_basic": -0.31, "auditor_name": 'A "q"', "period_end": "2026-01-02"}
    assert got == json.dumps(want)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, v string")
    sinks.write_sorted_json(rows, str(tmp_path / "out"), "id")
    sums = sinks.checksums(spark, str(tmp_path / "out")).where("name like 'part%'")
    assert sinks.mismatches(spark, str(tmp_path / "out"), sums).count() == 0
    assert sinks.mismatches(spark, str(tmp_path / "out"), sums.withColumn("sha256", F.lit("x"))).count() == sums.count()
    assert len(sinks.digest_of(spark, str(tmp_path / "out"))) == 64
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_sorted_json(rows, str(tmp_path / "out"), "id")
    changed = sinks.upsert(rows, spark.createDataFrame([(2, "z")], "id int, v string"), "id")
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "a"), (2, "z"), (3, "c")]


def test_streams_resume_and_keep_the_latest(spark, tmp_path):
    source, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "k int, n int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], schema).coalesce(1).write.parquet(source)
    logs.latest_by_key(logs.read_log(spark, source, schema), "k", "n", out, mark)
    spark.createDataFrame([(1, 3, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    query = logs.latest_by_key(logs.read_log(spark, source, schema), "k", "n", out, mark)
    assert sorted(tuple(r) for r in logs.read_latest(spark, out).collect()) == [(1, 3, "c"), (2, 2, "b")]
    logs.append_only(logs.read_log(spark, source, schema), str(tmp_path / "all"), str(tmp_path / "mark2"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3


def test_windows_and_sessions(spark):
    e = spark.createDataFrame([("a", "2026-01-01 00:00:10", 1.0), ("a", "2026-01-01 00:00:50", 2.0), ("a", "2026-01-01 00:10:00", 4.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.total for r in logs.windowed(e, "t", ["k"], "v", "1 minute").collect()) == [3.0, 4.0]
    assert sorted(r.n for r in logs.sessions(e, "t", ["k"], "5 minutes").collect()) == [1, 2]
