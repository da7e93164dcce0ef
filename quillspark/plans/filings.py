"""Registered queries of filings and their reading. Those over written examples have their results, worked out by hand from what each
operator is to do, as their SQL; the others run over the tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, grading, hashing, text
from ..operators import corpus, evidence, pairing, runs, statements
from ..schema import FIELDS, MISS_REASONS
from ..sources import filings, markup, sinks
from .queries import QUERIES, SQL, _query, table


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"null::{kind}"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}::{kind}" if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + f"'::{kind}"


def _cases(doc: str, given: str, rows: list[tuple], found: str, expected: list[tuple]) -> Callable:
    """Registers f(frame of rows) as a query whose SQL is the expected rows; given and found are 'name kind, ...'."""
    names, kinds = zip(*(c.split(" ") for c in found.split(", ")), strict=True)
    values = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in expected)

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark.createDataFrame(rows, given)).select(*names)

        run.__name__, run.__doc__ = f.__name__, doc
        QUERIES[f.__name__] = run
        SQL[f.__name__] = f"select * from (values {values}) t({', '.join(names)})"
        return run

    return add


def _joined(column: Column | str) -> Column:
    return F.array_join(column, "|")


# Scalar readings -------------------------------------------------------------------------------------------------------------

@_cases("C11: cover dates in the shapes that filers tag.", "n int, t string", [
    (1, "September 27, 2025"), (2, "Sept. 27, 2025"), (3, "December 31 , 2024"), (4, "SEPTEMBER 27 2025"), (5, "27 September 2025"), (6, "09/27/2025"), (7, "2025-09-27"), (8, "Septembre 27, 2025"), (9, "February 30, 2025"), (10, "the third quarter"), (11, "May 1, 2024"), (12, "3 Jan. 2024"), (13, None),
], "n int, day varchar", [(1, "2025-09-27"), (2, "2025-09-27"), (3, "2024-12-31"), (4, "2025-09-27"), (5, "2025-09-27"), (6, "2025-09-27"), (7, "2025-09-27"), (8, None), (9, None), (10, None), (11, "2024-05-01"), (12, "2024-01-03"), (13, None)])
def cover_dates(df: DataFrame) -> DataFrame:
    return df.select("n", F.date_format(text.parse_date(F.col("t")), "yyyy-MM-dd").alias("day"))


@_cases("C12: cover values by concept; states by name become codes.", "n int, c string, v string", [
    (1, "dei:DocumentPeriodEndDate", "Sept. 30, 2026"), (2, "dei:DocumentFiscalPeriodFocus", "q3"), (3, "dei:EntityIncorporationStateCountryCode", "Delaware"), (4, "dei:EntityIncorporationStateCountryCode", "nv"), (5, "dei:EntityIncorporationStateCountryCode", "Atlantis"), (6, "dei:AuditorName", "  Deloitte &  Touche LLP "), (7, "dei:AuditorName", "   "),
], "n int, v varchar", [(1, "2026-09-30"), (2, "Q3"), (3, "DE"), (4, "NV"), (5, None), (6, "Deloitte & Touche LLP"), (7, None)])
def cover_values(df: DataFrame) -> DataFrame:
    return df.select("n", markup.cover_value(F.col("c"), F.col("v")).alias("v"))


@_cases("C5: the money's scale, whether it is declared, and the shares' own.", "n int, t string", [
    (1, "(In thousands, except per share data)"), (2, "(In millions, except share and per share data)"), (3, "(in millions; shares in thousands)"), (4, "STATEMENTS OF INCOME"), (5, "($000's omitted)"), (6, "(Thousands of dollars)"),
], "n int, scale double, declared boolean, share_scale double", [(1, 1e3, True, None), (2, 1e6, True, 1.0), (3, 1e6, True, 1e3), (4, 1.0, False, None), (5, 1e3, True, None), (6, 1e3, True, None)])
def heading_scales(df: DataFrame) -> DataFrame:
    return df.select("n", statements.scales(F.col("t")).alias("s")).select("n", "s.*")


@_cases("C6: the scale in the label of the first share row that prints one.", "n int, r array<array<string>>", [
    (1, [["Net income", "5"], ["Diluted shares (in thousands)", "7"]]), (2, [["Weighted average shares (000's)", "1"]]), (3, [["Shares", "1"]]), (4, [["Net income (in millions)", "1"], ["Basic shares (in millions)", "2"]]),
], "n int, scale double", [(1, 1e3), (2, 1e3), (3, None), (4, 1e6)])
def label_scales(df: DataFrame) -> DataFrame:
    return df.select("n", statements.label_scale(F.col("r")).alias("scale"))


@_cases("C3, C4: the statements that a title names; a combined one with per-share lines is the income statement.", "n int, t string, labels string", [
    (1, "CONSOLIDATED STATEMENTS OF OPERATIONS", ""), (2, "Balance Sheets", ""), (3, "Statements of Comprehensive Income", "Net income Basic earnings per share"), (4, "Statements of Comprehensive Income", "Net income"), (5, "Statements of Consolidated Cash Flows", ""), (6, "Statements of Changes in Stockholders' Equity", ""), (7, "Notes", ""),
], "n int, titles varchar", [(1, "income"), (2, "balance"), (3, "income"), (4, "comprehensive"), (5, "cash"), (6, "equity"), (7, "")])
def statement_titles(df: DataFrame) -> DataFrame:
    return df.select("n", _joined(text.resolved_titles(text.statement_titles(F.col("t")), F.col("labels"), F.lit("income"))).alias("titles"))


@_cases("F6: rows that print a share count.", "n int, t string", [
    (1, "Weighted average shares outstanding"), (2, "Basic earnings per share"), (3, "Diluted"), (4, "Net income per common share"), (5, "Shares used in computing per share amounts, weighted"), (6, "Revenue"), (7, "Number of common shares"), (8, "Assuming dilution"),
], "n int, share_row boolean", [(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, True), (8, True)])
def share_rows(df: DataFrame) -> DataFrame:
    return df.select("n", text.share_count_row(F.col("t")).alias("share_row"))


@_cases("C2: printed magnitudes; a dash that stands alone adds a zero.", "n int, t string", [
    (1, "Total | 1,234.5 | (12)"), (2, "Debt | — | 7"), (3, "non-current 3"), (4, "-"), (5, "2026-09-30"), (6, "x"),
], "n int, numbers varchar", [(1, "1234.5|12.0"), (2, "7.0|0.0"), (3, "3.0"), (4, "0.0"), (5, "2026.0|9.0|30.0"), (6, "")])
def magnitudes(df: DataFrame) -> DataFrame:
    return df.select("n", _joined(F.transform(text.printed_numbers(F.col("t")), lambda x: x.cast("string"))).alias("numbers"))


@_cases("F11: numeric cells of a table.", "n int, r array<array<string>>", [(1, [["Sales", "$ 1,234", "(5)"], ["Margin", "12%", "n/a"]]), (2, [["a"], []]), (3, [["2024", "2023", "−7.5", "$(1,000)", "1 2"]])], "n int, cells int", [(1, 3), (2, 0), (3, 4)])
def numeric_cells(df: DataFrame) -> DataFrame:
    return df.select("n", text.numeric_cells(F.col("r")).alias("cells"))


@_cases("F7, J19: a printed number is the fact at its printed precision.", "n int, kind string, p double, t double, scale double, share double", [
    (1, "monetary", 1235.0, 1234600.0, 1e3, None), (2, "monetary", 1234.0, 1234600.0, 1e3, None), (3, "monetary", 12.0, -12000.0, 1e3, None), (4, "per_share", 0.31, -0.3149, 1e3, None), (5, "per_share", 0.31, 0.32, 1.0, None), (6, "share_count", 146.0, 145.8e6, 1e3, 1e6), (7, "share_count", 146.0, 145.8e6, 1e3, None),
], "n int, printed boolean", [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, False)])
def printed_facts(df: DataFrame) -> DataFrame:
    return df.select("n", text.printed_as(F.col("kind"), F.col("p"), F.col("t"), F.col("scale"), F.col("share")).alias("printed"))


@_cases("F9: numbers near a value at the grader's tolerance.", "n int, kind string, v double, p array<double>, scale double", [
    (1, "monetary", 236000.0, [236340.0], 1.0), (2, "monetary", 236000.0, [240000.0, 1.0], 1.0), (3, "monetary", 300.0, [0.0], 1e3), (4, "per_share", 0.31, [0.314], 1e3), (5, "per_share", 0.31, [0.32], 1e3),
], "n int, near boolean", [(1, True), (2, False), (3, True), (4, True), (5, False)])
def near_printed(df: DataFrame) -> DataFrame:
    return df.select("n", pairing.near_printed(F.col("kind"), F.col("v"), F.col("p"), F.col("scale"), F.lit(None).cast("double")).alias("near"))


@_cases("J20: among values filed for a period, the one that the page prints.", "n int, v double, o array<double>, p array<double>", [
    (1, 100.0, [90.0], [100.0, 90.0]), (2, 5000.0, [94900.0], [94900.0]), (3, 236000.0, [100000.0, 236340.0], [236340.0, 100000.0]), (4, 5000.0, [7000.0], [1.0]), (5, None, [7.0], [7.0]),
], "n int, v double", [(1, 100.0), (2, 94900.0), (3, 236340.0), (4, 5000.0), (5, None)])
def printed_synonyms(df: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return df.select("n", pairing.printed_synonym("monetary", F.col("v"), F.col("o"), F.col("p"), one, F.lit(None).cast("double")).alias("v"))


@_cases("F10: whether a statement prints a share-count line.", "n int, r array<array<string>>", [(1, [["Net income", "5"], ["Weighted average shares", "7"]]), (2, [["Net income", "5"], ["Earnings per share", "1"]]), (3, [[]])], "n int, printed boolean", [(1, True), (2, False), (3, False)])
def share_line_printed(df: DataFrame) -> DataFrame:
    return df.select("n", pairing.line_printed(F.col("r")).alias("printed"))


@_cases("F8: facts are found in their own section: dates in any spelling, folded names, states by name, numbers.", "n int, cover string", [
    (1, "For the period ended September 30 , 2026. Delaware. Deloitte and Touche, L.L.P."), (2, "ended 9/30/2026, DE, Ernst & Young"), (3, "September 2026, Nevada"), (4, "Sept. 30, 2026 denied"),
], "n int, day boolean, state boolean, auditor boolean", [(1, True, True, True), (2, True, True, False), (3, False, False, False), (4, True, False, False)])
def located_facts(df: DataFrame) -> DataFrame:
    c = F.col("cover")
    return df.select("n", pairing.date_printed(F.lit("2026-09-30").cast("date"), c).alias("day"), pairing.name_printed(F.lit("DE"), c, True).alias("state"), pairing.name_printed(F.lit("Deloitte & Touche LLP"), c).alias("auditor"))


@_cases("P2: shares that are printed whole under a heading that scales only money.", "n int, shares double, r array<array<string>>, scale double, own double", [
    (1, 15204137.0, [["Diluted shares", "15,204,137"]], 1e3, None), (2, 15204000.0, [["Diluted shares", "15,204"]], 1e3, None), (3, 15204137.0, [["Diluted shares", "15,204,137"]], 1e3, 1e6), (4, 15204137.0, [["Diluted shares", "15,204,137"]], 1.0, None), (5, 7.0, [["Diluted shares", "9"]], 1e3, None),
], "n int, share_scale double", [(1, 1.0), (2, None), (3, 1e6), (4, None), (5, None)])
def share_scale_read(df: DataFrame) -> DataFrame:
    return df.select("n", pairing.read_share_scale(F.col("shares"), F.col("r"), F.col("scale"), F.col("own")).alias("share_scale"))


@_cases("G6, G8: dates and names, misread ones and malformed answers.", "n int, kind string, p string, t string, o array<string>, parsed boolean", [
    (1, "categorical", "DELOITTE AND TOUCHE, L.L.P.", "Deloitte & Touche LLP", [], True), (2, "date", "2026-09-26", "2026-09-26", [], True), (3, "date", "2025-09-27", "2026-09-26", ["2025-09-27"], True), (4, "categorical", "KPMG", "Ernst & Young LLP", [], True), (5, "categorical", None, "DE", [], True), (6, "categorical", "DE", None, [], True), (7, "categorical", None, None, [], True), (8, "date", None, None, [], False),
], "n int, reason varchar", [(1, "correct"), (2, "correct"), (3, "wrong_period"), (4, "wrong_value"), (5, "missing"), (6, "hallucinated"), (7, "correct"), (8, "malformed")])
def grade_texts(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    others = F.transform("o", lambda x: F.struct(none.alias("num"), x.alias("str")))
    return df.select("n", grading.grade_field(F.col("kind"), none, F.col("p"), none, F.col("t"), F.lit(1.0), none, others, F.col("parsed")).alias("reason"))


@_cases("C30: numbers as an auditor reads them.", "n int, v double", [(1, 1234567.0), (2, 0.5), (3, -0.004), (4, 0.0), (5, 12.345), (6, 0.0000004)], "n int, shown varchar", [(1, "1,234,567"), (2, "0.50"), (3, "-0.004"), (4, "0"), (5, "12.35"), (6, "0.000000")])
def auditor_numbers(df: DataFrame) -> DataFrame:
    return df.select("n", evidence.shown_number(F.col("v")).alias("shown"))


@_cases("C32, C33: cells by place, dashes that print zero, whole words.", "n int, t string", [(1, "Debt | — | 7"), (2, "Cash | 5 | - | –"), (3, "a - b"), (4, "INC of DE | x")], "n int, dashes varchar, word int, cell int", [(1, "1:7", None, 0), (2, "2:11|3:15", None, 0), (3, "", None, None), (4, "", 7, 0)])
def cells_and_words(df: DataFrame) -> DataFrame:
    t = F.col("t")
    dashes = F.transform(evidence.dash_cells(t), lambda x: F.concat_ws(":", x["column"], x["start"]))
    return df.select("n", _joined(dashes).alias("dashes"), evidence.whole_word(t, "de").alias("word"), evidence.column_at(t, F.lit(3)).alias("cell"))


@_cases("C7, C33: where a line prints a scale, and dates with any white space between their words.", "n int, t string", [(1, "STATEMENTS (in thousands, except per share)"), (2, "(shares in millions)"), (3, "ended March 31 , 2025"), (4, "none")], "n int, money int, shares int, day boolean", [(1, 12, None, False), (2, 8, 1, False), (3, None, None, True), (4, None, None, False)])
def scale_headings(df: DataFrame) -> DataFrame:
    t = F.col("t")
    spaced = F.regexp_replace(t, " ", " ")
    return df.select("n", evidence.scale_heading(t)["start"].alias("money"), evidence.scale_heading(t, True)["start"].alias("shares"), F.expr("1 = 1").alias("_"), spaced.alias("_t")).withColumn("day", F.regexp_like("_t", evidence.loose_pattern(F.lit("March 31, 2025"))))


_PAGE = "STATEMENTS OF INCOME (in thousands)\nRevenue | 1,234 | 1,100\nNet loss | (45) | 1,234\n[x]\nTotal assets | 9,999"


@_cases("W14, W18: the line that prints a field's scale: its own section first, strict readings before loose ones.", "key int, own string, shares boolean, line_no int, section string, line string", [
    *((k, own, shares, i, s, t) for k, own, shares in ((1, "balance", False), (2, "income", False), (3, "income", True)) for i, (s, t) in enumerate([("income", "INCOME (thousands, except shares)"), ("income", "(in millions)"), ("income", "diluted shares in billions"), ("balance", "BALANCE"), ("cover", "in billions")])),
    (4, "income", False, 0, "income", "(thousands)"), (4, "income", False, 1, "balance", "in millions"), (5, "income", False, 0, "income", "none"),
], "key int, line_no int, section varchar, text varchar", [(1, 1, "income", "in millions"), (2, 1, "income", "in millions"), (3, 2, "income", "shares in billions"), (4, 0, "income", "(thousands")])
def scale_lines(df: DataFrame) -> DataFrame:
    return evidence.scale_lines(df, "key", "own", "shares")


@_cases("W19, C34: the printed numbers nearest a value, with their column and brackets, and what is doubtful.", "key int, truth double, unit double, line_no int, line string", [
    (1, -45000.0, 1e3, 0, "Revenue | 1,234 | 1,100"), (1, -45000.0, 1e3, 1, "Net loss | $ (45) | 44"), (2, 7.0, 1.0, 0, "a 7 | 7 | 8 | 9"),
], "key int, place int, printed double, cell int, parenthesised boolean", [(1, 1, 45.0, 1, True), (1, 2, 44.0, 2, False), (1, 3, 1100.0, 2, False), (2, 1, 7.0, 0, False), (2, 2, 7.0, 1, False), (2, 3, 8.0, 2, False)])
def nearest_printed(df: DataFrame) -> DataFrame:
    return evidence.printed_places(df, "key", "truth", "unit").withColumnRenamed("column", "cell")


@_cases("C34: what is doubtful about a label.", "n int, v double, s boolean, has boolean, scale double, own boolean, c array<int>, p array<boolean>", [
    (1, None, True, True, 1.0, True, [], []), (2, 5.0, False, False, 1e3, True, [1], [False]), (3, 5.0, False, True, 1e3, False, [2, 3], [False, False]), (4, -5.0, True, True, 1.0, True, [1], [False]), (5, 5.0, True, True, 1.0, True, [1], [True]), (6, 5.0, True, True, 1.0, True, [], []), (7, -5.0, True, True, 1.0, True, [1], [True]),
], "n int, flags varchar", [(1, "null_label"), (2, "no_scale_printed"), (3, "scale_of_another_statement|only_in_a_later_column"), (4, "negative_without_brackets"), (5, "positive_in_brackets"), (6, "not_found"), (7, "")])
def audit_flags(df: DataFrame) -> DataFrame:
    return df.select("n", _joined(evidence.evidence_flags(F.col("v"), F.col("s"), F.col("has"), F.col("scale"), F.col("own"), F.col("c"), F.col("p"))).alias("flags"))


# Answers --------------------------------------------------------------------------------------------------------------------

_ANSWERS = [
    (1, '```json\n{"revenue": 5, "auditor_name": "KPMG"}\n```'), (2, '{"revenue": "1,234"}'), (3, 'It is {"net_income": -2.5, "fiscal_period": "Q3"} I think'), (4, '{"total_assets": -1}'), (5, '{"extra": 1}'), (6, "no answer"), (7, '{"period_end": "2026-09-26", "eps_basic": "0.31"}'), (8, '{"fiscal_period": "H1"}'), (9, None), (10, '["revenue"]'),
]


@_cases("JS1, JS2: the object inside an answer, validated whole.", "n int, t string", _ANSWERS, "n int, found boolean, ok boolean, revenue double, income double, period varchar, day varchar", [
    (1, True, True, 5.0, None, None, None), (2, True, False, None, None, None, None), (3, True, True, None, -2.5, "Q3", None), (4, True, False, None, None, None, None), (5, True, False, None, None, None, None), (6, False, False, None, None, None, None), (7, True, True, None, None, None, "2026-09-26"), (8, True, False, None, None, None, None), (9, False, False, None, None, None, None), (10, False, False, None, None, None, None),
])
def parsed_answers(df: DataFrame) -> DataFrame:
    e = df.withColumn("e", answers.parse_extraction("t")).withColumn("c", answers.candidate(F.col("t")))
    return e.select("n", F.col("c").isNotNull().alias("found"), F.col("e").isNotNull().alias("ok"), F.col("e.revenue").alias("revenue"), F.col("e.net_income").alias("income"), F.col("e.fiscal_period").alias("period"), F.date_format("e.period_end", "yyyy-MM-dd").alias("day"))


_EMPTY = {n: None for n, *_ in FIELDS}


@_cases("JS3: the canonical answer: every key in order, whole numbers without a fraction.", "n int, t string", [(1, '{"revenue": 94900000.0, "eps_basic": -0.31, "auditor_name": "A \\"B\\"", "period_end": "2026-09-26"}'), (2, "{}")], "n int, answer varchar", [
    (1, json.dumps(_EMPTY | {"period_end": "2026-09-26", "revenue": 94900000, "eps_basic": -0.31, "auditor_name": 'A "B"'})), (2, json.dumps(_EMPTY)),
])
def canonical_answers(df: DataFrame) -> DataFrame:
    return df.select("n", answers.canonical(answers.parse_extraction("t")).alias("answer"))


@_query("select o_orderkey, sha256(o_orderpriority || chr(10) || o_orderstatus) fingerprint from orders")
def prompt_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """JS5: the digest over a prompt's parts."""
    return table(spark, d, "orders").select("o_orderkey", answers.fingerprint(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("fingerprint"))


# Readings of the tables ------------------------------------------------------------------------------------------------------

@_query("select doc_id, length(c) n, md5(c) digest from (select doc_id, trim(regexp_replace(text, '[\\s\\x{0B}\\x{A0}\\x{200B}\\x{202F}]+', ' ', 'g'), ' ') c from documents)")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """White space of all kinds as single spaces."""
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@_query("""select o_orderkey, case when month(o_orderdate) = 9 then 13 else 9 end forms, strftime(o_orderdate, '%B %-d, %Y') first, strftime(o_orderdate, '%Y-%m-%d') last from orders""")
def date_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The printed spellings of a date."""
    forms = text.date_forms(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.size(forms).alias("forms"), forms[0].alias("first"), F.element_at(forms, -1).alias("last"))


@_query("select o_orderkey, o_orderdate::date back from orders")
def date_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a date is read as that date."""
    day = F.to_date("o_orderdate")
    forms = F.filter(text.date_forms(day), lambda f: ~f.rlike("^$"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(forms).alias("f")).groupBy("o_orderkey").agg(F.max(text.parse_date(F.col("f"))).alias("hi"), F.min(text.parse_date(F.col("f"))).alias("lo")).select("o_orderkey", F.when(F.col("hi") == F.col("lo"), F.col("hi")).alias("back"))


@_query("select o_orderkey, lpad(o_custkey::varchar, 10, '0') || '-26-' || lpad(o_orderkey::varchar, 6, '0') accession from orders")
def accession_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The accession number in an archive path."""
    own = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-26-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return table(spark, d, "orders").select("o_orderkey", hashing.accession_of(F.concat(F.lit("edgar/data/"), F.col("o_custkey").cast("string"), F.lit("/"), own, F.lit(".txt"))).alias("accession"))


@_query("""select a.o_orderkey, array_to_string(list_sort(list_filter([case when a.o_orderstatus is distinct from b.o_orderstatus then 'o_orderstatus' end, case when a.o_orderpriority is distinct from b.o_orderpriority then 'o_orderpriority' end, case when a.o_custkey is distinct from b.o_custkey then 'o_custkey' end], lambda x: x is not null)), '|') differing
  from orders a join orders b on b.o_orderkey = a.o_orderkey + 1""")
def manifest_differences(spark: SparkSession, d: str) -> DataFrame:
    """which keys of two manifests differ."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    keys = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    a, b = o, o.withColumn("o_orderkey", F.col("o_orderkey") - 1)
    found = runs.differing_keys(a, b.select(F.col("o_orderkey").alias("_next"), *keys), keys, F.col("a.o_orderkey") == F.col("b._next"), ("o_orderkey",))
    return found.select("o_orderkey", _joined(F.array_sort("differing")).alias("differing"))


@_query("""select count(*) filter (answered) joined, count(*) filter (not answered) failed from (select event_type <> 'error' and value is not null answered from events where user_id in (select c_custkey from customer))""")
def graded_calls(spark: SparkSession, d: str) -> DataFrame:
    """Answers joined with their items, failed calls apart, an orphan an error."""
    items = table(spark, d, "customer").select("c_custkey")
    log = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), (F.col("event_type") != "error").alias("ok"), F.col("value").cast("string").alias("text")).join(items, "c_custkey", "left_semi")
    answered, failed = runs.grade_run(log, items, "c_custkey")
    return answered.agg(F.count("*").alias("joined")).withColumn("failed", F.lit(failed).cast("bigint"))


# Sources ---------------------------------------------------------------------------------------------------------------------

_INDEX = ["Form Type   Company Name      CIK    Date Filed  File Name", "-" * 60, "1                Harbor Light Holdings, Inc.        2000001     2025-02-14  edgar/data/2000001/0001-25-000001.txt", "10-Q             24 7 KITCHENS CO INC   1000002     2025-01-31  edgar/data/1000002/0002-25-000002.txt", "SC 13G/A     ZETA  WORKS, LLC /NY/             700003      2025-02-10  edgar/data/700003/0003-25-000003.txt", "not a row"]


@_cases("S1, C16: index rows read from the right.", "value string", [(x,) for x in _INDEX], "form varchar, company varchar, cik bigint, filed varchar, accession varchar", [("1", "Harbor Light Holdings, Inc.", 2000001, "2025-02-14", "0001-25-000001"), ("10-Q", "24 7 KITCHENS CO INC", 1000002, "2025-01-31", "0002-25-000002"), ("SC 13G/A", "ZETA  WORKS, LLC /NY/", 700003, "2025-02-10", "0003-25-000003")])
def index_rows(df: DataFrame) -> DataFrame:
    return filings.form_index(df).withColumn("filed", F.col("filed").cast("string"))


@_cases("F1: annual and quarterly forms only.", "value string", [(x,) for x in _INDEX], "form varchar, cik bigint", [("10-Q", 1000002)])
def index_forms(df: DataFrame) -> DataFrame:
    return filings.form_index(df, forms=["10-K", "10-Q"])


_ENTRY = {"start": "2025-10-01", "end": "2025-12-31", "val": 7, "accn": "a1", "form": "10-Q", "filed": "2026-01-30"}
_PAYLOAD = {"sic": "6021", "facts": {"us-gaap": {"Assets": {"units": {"USD": [_ENTRY, {"end": "2026-01-02", "val": 1}, _ENTRY | {"val": 2.5, "start": None, "filed": None}]}}}, "dei": {"Name": {"units": {"": [_ENTRY | {"val": "Q1"}]}}}}, "filings": {"recent": {"accessionNumber": ["a1", "b", "c"], "primaryDocument": ["a.htm", ""]}, "files": [{"name": "p1", "filingTo": "2020-01-01"}, {"name": "p2", "filingTo": "2025-01-01"}]}}


@_cases("S2: company facts flattened; entries without an end, accession or value are skipped.", "value string", [(json.dumps(_PAYLOAD),)], "concept varchar, unit varchar, num_value double, str_value varchar, start varchar, filed varchar", [("us-gaap:Assets", "USD", 7.0, None, "2025-10-01", "2026-01-30"), ("us-gaap:Assets", "USD", 2.5, None, None, "2025-12-31"), ("dei:Name", "", None, "Q1", "2025-10-01", "2026-01-30")])
def company_facts(df: DataFrame) -> DataFrame:
    return filings.company_facts(df).withColumn("start", F.col("start").cast("string")).withColumn("filed", F.col("filed").cast("string"))


@_cases("S3, J3, S4: primary documents zipped to the shorter column, pages that reach back, the industry code.", "value string", [(json.dumps(_PAYLOAD),)], "kind varchar, a varchar, b varchar", [("document", "a1", "a.htm"), ("page", "p2", None), ("industry", "6021", None)])
def filing_history(df: DataFrame) -> DataFrame:
    docs = filings.primary_documents(df).select(F.lit("document").alias("kind"), F.col("accession").alias("a"), F.col("document").alias("b"))
    pages = filings.history_pages(df, "2024-01-01").select(F.lit("page").alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"))
    code = df.select(F.lit("industry").alias("kind"), filings.industry_code(F.col("value")).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    return docs.union(pages).union(code)


@_query("select year(s) || 'Q' || quarter(s) as \"quarter\", s::date as \"start\" from (select unnest(generate_series(timestamp '2023-10-01', timestamp '2026-07-01', interval 3 month)) s)")
def quarter_range(spark: SparkSession, d: str) -> DataFrame:
    """Quarters, both ends included."""
    return filings.quarters(spark, "2023Q4", "2026Q3")


_PRICES = "prices:\n  - gpu: L4\n    provider: acme\n    kind: spot\n    usd_per_hour: 0.49\n    checked: 2026-09-26\n    source: \"list\"\n  - gpu: A100 # big\n    provider: acme\n    kind: on-demand\n    usd_per_hour: 1.89\n"


@_cases("S16: price entries.", "value string", [(_PRICES,)], "gpu varchar, kind varchar, usd_per_hour double, checked varchar, source varchar", [("L4", "spot", 0.49, "2026-09-26", "list"), ("A100", "on-demand", 1.89, None, None)])
def price_entries(df: DataFrame) -> DataFrame:
    return filings.price_entries(df).withColumn("checked", F.col("checked").cast("string"))


_TAGGED = """<html><body><div style="display:none"><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2026-07-01</xbrli:startDate><xbrli:endDate>2026-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:segment>x</xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2026-09-30</xbrli:instant></xbrli:period></xbrli:context></div>
<p>Ended <ix:nonNumeric name="dei:DocumentPeriodEndDate" contextRef="c1">September 30, 2026</ix:nonNumeric> <ix:nonNumeric name="dei:EntityIncorporationStateCountryCode" contextRef="c2">NV</ix:nonNumeric>
<ix:nonNumeric name="dei:EntityIncorporationStateCountryCode" contextRef="c1">Delaware</ix:nonNumeric> <ix:nonNumeric name="dei:DocumentFiscalPeriodFocus" contextRef="none">Q3</ix:nonNumeric></p></body></html>"""


@_cases("S5, J26: cover tags joined with their undimensioned contexts.", "k int, html string", [(1, _TAGGED), (2, ""), (3, None)], "k int, concept varchar, value varchar, start varchar", [(1, "dei:DocumentPeriodEndDate", "2026-09-30", "2026-07-01"), (1, "dei:EntityIncorporationStateCountryCode", "DE", "2026-07-01")])
def tagged_cover(df: DataFrame) -> DataFrame:
    return markup.tagged_facts(df, "html", ["k"]).withColumn("start", F.col("start").cast("string"))


# A small corpus --------------------------------------------------------------------------------------------------------------

def _page(scale: str = "(In thousands, except per share data)", cover: str = "For the quarterly period ended September 30, 2026", state: str = "Delaware", revenue: str = "94,900", auditor: str = "", balance: bool = True) -> str:
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    tags = f'<ix:nonNumeric name="dei:DocumentPeriodEndDate" contextRef="c">{cover.split("ended ")[-1]}</ix:nonNumeric><ix:nonNumeric name="dei:DocumentFiscalPeriodFocus" contextRef="c">Q3</ix:nonNumeric><ix:nonNumeric name="dei:EntityIncorporationStateCountryCode" contextRef="c">DE</ix:nonNumeric>'
    context = '<xbrli:context id="c"><xbrli:startDate>2026-07-01</xbrli:startDate><xbrli:endDate>2026-09-30</xbrli:endDate></xbrli:context>'
    income = row("", "2026", "2025") + row("Net sales", "$", revenue, "$", "89,500") + row("Operating income", "9,000", "8,000") + row("Income tax expense", "(", "900", ")", "(", "800", ")") + row("Net income", "5,000", "4,000") + row("Basic earnings per share", "0.33", "0.30") + row("Weighted average diluted shares", "15,204", "15,100")
    sheet = row("Cash and cash equivalents", "30,000", "20,000") + row("Total current assets", "90,000", "80,000") + row("Total assets", "365,000", "352,000") + row("Total liabilities", "299,000", "290,000") + row("Total stockholders' equity", "66,000", "62,000")
    return f"""<html><body><div style="display: none">{context}{tags}987,654</div><p>FORM 10-Q</p><p>{cover}</p><p>{state}</p><p>Registrant {"of many words " * 20}</p><p>TABLE OF CONTENTS</p><p>Some long discussion. {"Words follow here. " * 30}</p>
<p>CONDENSED CONSOLIDATED STATEMENTS OF OPERATIONS</p><p>{scale}</p><table>{income}</table>""" + (f"<p>{'More prose stands here. ' * 20}</p><p>CONDENSED CONSOLIDATED BALANCE SHEETS</p><p>{scale}</p><table>{sheet}</table>" if balance else "") + f"<p>{auditor}</p></body></html>"


def _facts_of(accession: str, revenue: float = 94_900_000, **other: float) -> dict:
    values = {"Revenues": revenue, "OperatingIncomeLoss": 9e6, "NetIncomeLoss": 5e6, "EarningsPerShareBasic": 0.33, "WeightedAverageNumberOfDilutedSharesOutstanding": 15_204_000, **other}
    instants = {"Assets": 365e6, "Liabilities": 299e6, "CashAndCashEquivalentsAtCarryingValue": 30e6, "StockholdersEquity": 66e6}
    entry = lambda v, start: {"end": "2026-09-30", "val": v, "accn": accession, "form": "10-Q", "filed": "2026-11-04"} | ({"start": start} if start else {})
    return {"facts": {"us-gaap": {n: {"units": {"USD": [entry(v, "2026-07-01"), entry(v * 3, "2026-01-01")]}} for n, v in values.items()} | {n: {"units": {"USD": [entry(v, None)]}} for n, v in instants.items()}}}


def _history_of(accession: str, document: str = "a.htm", sic: str = "3571") -> dict:
    return {"sic": sic, "filings": {"recent": {"accessionNumber": [accession], "primaryDocument": [document]}, "files": []}}


#: (cik, accession, history, facts, page, what becomes of the filing, its revenue label).
_FILINGS = [
    (1, "a-1", _history_of("a-1"), _facts_of("a-1"), _page(), "kept", 94_900_000.0),
    (2, "a-2", _history_of("a-2", sic="6021"), _facts_of("a-2"), _page(), "bank", None),
    (3, "a-3", _history_of("a-3", ""), _facts_of("a-3"), _page(), "no_primary_document", None),
    (4, "a-4", _history_of("a-4"), _facts_of("a-4"), None, "not_fetched", None),
    (5, "a-5", None, _facts_of("a-5"), _page(), "not_fetched", None),
    (6, "a-6", _history_of("a-6"), _facts_of("a-6", NetIncomeLoss=6e6), _page(), "unlocatable:net_income", 94_900_000.0),
    (7, "a-7", _history_of("a-7"), _facts_of("a-7"), _page(state="Nevada"), "unlocatable:state_of_incorporation", 94_900_000.0),
    (8, "a-8", _history_of("a-8"), _facts_of("a-8"), _page(balance=False), "no_balance_sheet", 94_900_000.0),
    (9, "a-9", _history_of("a-9"), _facts_of("a-9", 5_000.0, RevenueFromContractWithCustomerExcludingAssessedTax=94_900_000.0), _page(), "kept", 94_900_000.0),
    (10, "a-10", _history_of("a-10"), _facts_of("other"), _page(), "truth_missing:revenue", None),
]


def _built(spark: SparkSession) -> DataFrame:
    entries = spark.createDataFrame([("2026Q4", "10-Q", c, "x", "2026-11-04", a) for c, a, *_ in _FILINGS] + [("2027Q1", "10-Q", 1, "x", "2026-11-04", "a-1"), ("2026Q4", "8-K", 1, "x", "2026-11-04", "z")], "quarter string, form string, cik bigint, company string, filed string, accession string").withColumn("filed", F.col("filed").cast("date"))
    histories = spark.createDataFrame([(c, json.dumps(h)) for c, _, h, *_ in _FILINGS if h], "cik bigint, value string")
    payloads = spark.createDataFrame([(c, json.dumps(f)) for c, _, _, f, *_ in _FILINGS], "cik bigint, value string")
    pages = spark.createDataFrame([(a, p) for _, a, _, _, p, *_ in _FILINGS if p], "accession string, html string")
    return corpus.build(entries, histories, payloads, pages)


@_query("select * from (values " + ", ".join(f"('{a}'::varchar, '{k}'::varchar, {r if r else 'null'}::double)" for _, a, _, _, _, k, r in _FILINGS) + ") t(accession, key, revenue)")
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """From index, histories, facts and pages to items and named drops."""
    revenue = F.when(F.col("document").isNotNull() & ~F.col("bank") & F.col("truth").isNotNull(), F.col("truth.revenue"))
    return _built(spark).select("accession", corpus.drop_key().alias("key"), revenue.alias("revenue"))


@_query("select * from (values ('kept'::varchar, 2::bigint), ('bank', 1), ('no_primary_document', 1), ('not_fetched', 2), ('unlocatable:net_income', 1), ('unlocatable:state_of_incorporation', 1), ('no_balance_sheet', 1), ('truth_missing:revenue', 1)) t(key, n)")
def corpus_drops(spark: SparkSession, d: str) -> DataFrame:
    """The tally of a build."""
    return _built(spark).groupBy(corpus.drop_key().alias("key")).agg(F.count("*").alias("n"))


@_query("select * from (values ('a-1'::varchar, 1e3::double, 'CONDENSED CONSOLIDATED STATEMENTS OF OPERATIONS'::varchar, 7::int, true, false), ('a-9', 1e3, 'CONDENSED CONSOLIDATED STATEMENTS OF OPERATIONS', 7, true, false)) t(accession, scale, title, n_rows, on_cover, contents_on_cover)")
def located_statements(spark: SparkSession, d: str) -> DataFrame:
    """The income statement and cover of the kept filings."""
    kept = _built(spark).where("drop_reason is null")
    return kept.select("accession", F.col("income.scale").alias("scale"), F.split(F.col("income.text"), "\n")[0].alias("title"), F.size("income.rows").alias("n_rows"), F.contains("cover", F.lit("Delaware")).alias("on_cover"), F.contains("cover", F.lit("CONTENTS")).alias("contents_on_cover"))


# Sinks -----------------------------------------------------------------------------------------------------------------------

def _place(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("select o_orderkey, o_orderstatus from orders")
def sorted_build(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in order, read back."""
    place = _place(spark, "build")
    sinks.write_sorted_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), place, "o_orderkey")
    return filings.json_lines(spark, place, "o_orderkey bigint, o_orderstatus string")


@_query("select count(*) names, 0::bigint wrong, 1::bigint digests from (select unnest([1]))")
def build_checksums(spark: SparkSession, d: str) -> DataFrame:
    """K4, K5: checksums of a build's files, verified, and one digest over them."""
    place = _place(spark, "sums")
    table(spark, d, "nation").coalesce(1).write.json(place)
    sums = sinks.checksums(spark, place).where("name like 'part-%'")
    wrong = sinks.mismatches(spark, place, sums.select("name", "sha256"))
    same = sinks.digest_of(spark, place) == sinks.digest_of(spark, place)
    return sums.agg(F.count("*").alias("names")).withColumn("wrong", F.lit(wrong.count()).cast("bigint")).withColumn("digests", F.lit(int(same)).cast("bigint"))


@_query("select n_nationkey n, case when n_nationkey = 3 then 'wrong' else '' end verdict from nation")
def sheet_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One verdict put into a sheet, which is written anew and swapped."""
    place = _place(spark, "sheet")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.lit("").alias("verdict")).write.option("emptyValue", "").csv(place, header=True)
    sinks.replace_sheet(spark, place, spark.createDataFrame([(3, "wrong")], "n int, verdict string"), "n")
    return spark.read.csv(place, header=True).select(F.col("n").cast(table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n"), F.coalesce("verdict", F.lit("")).alias("verdict"))


@_query("select * from (values ('2026-09-26'::varchar, 'L4'::varchar, 0.5::double), ('2026-10-01', 'L4', 0.6)) t(date, gpu, usd_per_hour)")
def dated_prices(spark: SparkSession, d: str) -> DataFrame:
    """K8: prices by date; another date is added."""
    place = _place(spark, "prices")
    for day, usd in (("2026-09-26", 0.5), ("2026-10-01", 0.6)):
        sinks.write_prices(spark.createDataFrame([(day, "L4", usd)], "date string, gpu string, usd_per_hour double"), place)
    return spark.read.schema("gpu string, usd_per_hour double, date string").json(place).select("date", "gpu", "usd_per_hour")


@_query("select count(*) bodies, sum(strlen(o_orderpriority || o_orderkey))::bigint bytes from orders")
def stored_bodies(spark: SparkSession, d: str) -> DataFrame:
    """K3: compressed bodies with digests, compacted once their digests hold."""
    place = _place(spark, "bodies")
    sinks.store_bodies(table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("body")), f"{place}/raw", "url", "body")
    n, size = sinks.compact_bodies(spark, f"{place}/raw", f"{place}/compact", "url", "body")
    return spark.range(1).select(F.lit(n).cast("bigint").alias("bodies"), F.lit(size).cast("bigint").alias("bytes"))


@_query("select case when doc_id % 4 = 0 then 'validation' else 'train' end split, count(*) examples, sum(length(lang) + length(text) + length(source))::bigint chars from documents where text is not null group by 1")
def training_file(spark: SparkSession, d: str) -> DataFrame:
    """Training rows in order, with their manifest."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train").alias("split"), F.col("lang").alias("system"), F.col("text").alias("user"), F.col("source").alias("assistant"))
    return sinks.write_training(docs, _place(spark, "training"))


@_query("select * from (values ('m-awq'::varchar, 'm-bf16'::varchar, 'block'::varchar, 2::bigint, 'revenue'::varchar), ('a-vs-b', 'c', 'pass', 1, '')) t(candidate, baseline, verdict, suites, blocked)")
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a gate, by the names of their directories."""
    place = _place(spark, "gates")
    texts = {"m-awq-vs-m-bf16": "## Gate: BLOCK\n| field | items |\n| revenue | 5 | x | block |\n| net_income | 5 | x | pass |", "a-vs-b-vs-c": "## Gate: PASS\n| revenue | 5 | x | pass |"}
    rows = spark.createDataFrame([(k, line) for k, t in texts.items() for line in t.split("\n")], "dir string, value string")
    name, jvm = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm
    for k in texts:
        rows.where(F.col("dir") == k).select("value").coalesce(1).write.text(f"{place}/{k}.part")
        fs = name(place).getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.globStatus(name(f"{place}/{k}.part/part-*")))
        fs.mkdirs(name(f"{place}/{k}"))
        fs.rename(part, name(f"{place}/{k}/decision.txt"))
        fs.delete(name(f"{place}/{k}.part"), True)
    del jvm
    return filings.gate_decisions(spark, place)


@_query(f"select * from (values {', '.join(f'({i}::int, {chr(39)}{r}{chr(39)}::varchar)' for i, r in enumerate(MISS_REASONS))}) t(i, reason)")
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The miss reasons in their order."""
    return spark.createDataFrame(list(enumerate(MISS_REASONS)), "i int, reason string")
