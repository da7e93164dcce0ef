"""Readers of filing archives: form indexes, company facts, filing histories, cached responses, price and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import accession_of

# Fixed value: a row's format, read from the right: fixed shapes at the end, the form up to a double space, the company between.
INDEX_ROW = r"^(\S(?:\S| (?! ))*)\s{2,}(.*?)\s+(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(edgar/\S+)\s*$"
FACTS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("start", "end", "val", "accn", "form", "filed")]))))])))
HISTORY = "recent struct<accessionNumber:array<string>,primaryDocument:array<string>>, files array<struct<name:string,filingTo:string>>"


def quarters(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(quarter, start) of every quarter from one like '2022Q1' to another, both included."""
    import re

    if not all(re.fullmatch(r"\d{4}Q[1-4]", q) for q in (first, last)) or first > last:
        raise ValueError(f"not a range of quarters: {first} to {last}")
    ends = [f"{q[:4]}-{3 * int(q[5]) - 2:02d}-01" for q in (first, last)]
    days = spark.range(1).select(F.explode(F.sequence(*[F.lit(d).cast("date") for d in ends], F.expr("interval 3 months"))).alias("start"))
    return days.select(F.concat(F.year("start"), F.lit("Q"), F.quarter("start")).alias("quarter"), "start")


def form_index(lines: DataFrame, value: str = "value", forms: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(form, cik, company, filed, path, accession) of an index's lines; lines of another shape are skipped, but an index with
    no row of the right shape is an error."""
    part = lambda i: F.regexp_extract(value, INDEX_ROW, i)
    rows = lines.where(F.col(value).rlike(INDEX_ROW))
    if strict and rows.isEmpty():
        raise ValueError("no line has the shape of an index row")
    out = rows.select(part(1).alias("form"), part(3).cast("bigint").alias("cik"), F.trim(part(2)).alias("company"), part(4).cast("date").alias("filed"), part(5).alias("path"), accession_of(part(5)).alias("accession"))
    return out.where(F.col("form").isin(forms)) if forms else out


def read_form_index(spark: SparkSession, path: str, forms: list[str] | None = None) -> DataFrame:
    """form_index of latin-1 index files."""
    lines = spark.read.format("csv").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("value string").load(path)
    return form_index(lines, forms=forms)


def company_facts(payloads: DataFrame, value: str = "value") -> DataFrame:
    """One row per reported value: ordinal, concept, unit, num_value, str_value, start, end, accession, form, filed. The ordinal
    is the place of a value among its concept's.

    Taxonomy, concept, unit and entry are four explodes; entries without end, accession or value are skipped; filed is the
    end where absent. Strings and numbers are told apart by their JSON.
    """
    tree = payloads.select("*", F.from_json(F.get_json_object(value, "$.facts"), FACTS).alias("_f"))
    out = tree.select("*", F.explode("_f").alias("_taxonomy", "_c")).select("*", F.explode("_c").alias("_concept", "_u")).select("*", F.posexplode("_u.units").alias("_unit", "unit", "_e")).select("*", F.posexplode("_e").alias("_at", "_x"))
    out = out.where("_x.end is not null and _x.accn is not null and _x.val is not null")
    number = F.expr("try_cast(_x.val as double)")
    return out.select(
        (F.col("_unit") * 1_000_000 + F.col("_at")).cast("int").alias("ordinal"), F.concat_ws(":", "_taxonomy", "_concept").alias("concept"), "unit", number.alias("num_value"), F.when(number.isNull(), F.col("_x.val")).alias("str_value"),
        F.col("_x.start").cast("date").alias("start"), F.col("_x.end").cast("date").alias("end"), F.col("_x.accn").alias("accession"), F.coalesce("_x.form", F.lit("")).alias("form"),
        F.coalesce("_x.filed", "_x.end").cast("date").alias("filed"),
    )


def primary_documents(payloads: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and (accession, document) of a filing history's parallel columns, cut to the shorter; empty documents are skipped."""
    h = payloads.select(*keep, F.from_json(F.get_json_object(value, "$.filings"), HISTORY)["recent"].alias("r"))
    pairs = F.arrays_zip(F.col("r.accessionNumber").alias("accession"), F.col("r.primaryDocument").alias("document"))
    return h.select(*keep, F.inline(pairs)).where("accession is not null and document is not null and document != ''")


def history_pages(payloads: DataFrame, since: str, value: str = "value") -> DataFrame:
    """(name) of the older pages that reach back to since."""
    files = F.from_json(F.get_json_object(value, "$.filings"), HISTORY)["files"]
    return payloads.select(F.inline(files)).where(F.col("filingTo").cast("date") >= F.lit(since).cast("date")).select("name")


def industry_code(payload: Column) -> Column:
    """The industry code of a history, written as a number or as digits."""
    code = F.get_json_object(payload, "$.sic")
    return F.when(code.rlike("^[0-9]+$"), code.cast("int"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_split(items: DataFrame, split: str, limit: int | None = None, order: str = "item_id") -> DataFrame:
    """The items of a split, the first limit by order; none is an error."""
    out = items.where(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"no items in {split}")
    return out.orderBy(order).limit(limit) if limit else out


def run_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per run directory under root that holds run.json, with its name."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/run.json").select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/run\.json$", 1).alias("run"))


def raw_responses(spark: SparkSession, root: str) -> DataFrame:
    """(ledger_id, provider, body): raw logs at any depth, with the JSON that is nested in their text."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").schema("ledger_id bigint, provider string, response struct<status:int,body:struct<text:string>>").json(root)
    return raw.select("ledger_id", "provider", F.col("response.body.text").alias("body"))


def verdict_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n int, item_id string, split string, form string, fiscal_period string, verdict string, wrong_fields string, note string").csv(path, header=True)


# A gate decision's headline, and a suite's row.
HEADLINE, SUITE = r"^## Gate: ([A-Z]+)", r"^\| ([a-z_]+) \| \d+ \|.*\| (pass|block|warn) \|$"


def gate_decisions(spark: SparkSession, root: str) -> DataFrame:
    """(candidate, baseline, verdict, suites, blocked) of decision texts; the directory 'a-vs-b' names both, split at its last
    '-vs-', and blocked lists the fields whose suite blocks, joined by commas."""
    lines = spark.read.text(f"{root}/*/decision.txt").select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)/decision\.txt$", 1).alias("dir"))
    headline, field, said = (F.nullif(F.regexp_extract("value", p, i), F.lit("")) for p, i in ((HEADLINE, 1), (SUITE, 1), (SUITE, 2)))
    found = lines.groupBy("dir").agg(F.lower(F.min(headline)).alias("verdict"), F.count(field).alias("suites"), F.array_join(F.array_sort(F.collect_set(F.when(said == "block", field))), ",").alias("blocked"))
    part = lambda i: F.regexp_extract("dir", "^(.+)-vs-(.+)$", i)
    return found.where("verdict is not null and suites > 0").select(part(1).alias("candidate"), part(2).alias("baseline"), "verdict", "suites", "blocked")


def price_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """(gpu, provider, kind, usd_per_hour, checked, source) of a price list's text: '- key: value' begins an entry and 'key: value'
    goes on with it, in files read whole (one row per file)."""
    entries = lines.select(F.explode(F.filter(F.split(value, r"(?m)^\s*-\s+"), lambda e: e.rlike(r"(?m)^\s*gpu:"))).alias("e"))
    of = lambda key: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?m)^\s*{key}:\s*([^\n#]*)", 1), "[\"']", "")), F.lit(""))
    return entries.select(of("gpu").alias("gpu"), of("provider").alias("provider"), of("kind").alias("kind"), of("usd_per_hour").cast("double").alias("usd_per_hour"), F.try_to_date(of("checked"), "yyyy-MM-dd").alias("checked"), of("source").alias("source"))


def cached_responses(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a response cache."""
    return spark.read.schema("url string, fetched_at timestamp, status int, sha256 string, bytes bigint").json(f"{root}/meta")
