"""The corpus build: from index rows, histories, facts and pages to items and named drops, as joins and windows by filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS, FORMS, field_dim
from ..sources.filings import company_facts, industry_code, primary_documents
from ..sources.markup import blocks, tagged_facts
from ..sources.sinks import written
from . import facts as fact_operators
from . import pairing, sampling, splits, statements

# Industry codes of banks and savings institutions, bounds and names of size bands.
BANKS = [6021, 6022, 6029, 6035, 6036]
BANDS, BAND_NAMES = [1e8, 1e9, 1e10], ["under_100m", "100m_to_1b", "1b_to_10b", "over_10b"]


def selected_filings(entries: DataFrame, companies: int | None, seed: str = "select") -> DataFrame:
    """Annual and quarterly entries (quarter, form, cik, filed, accession), each accession once, of the first companies by rank."""
    own = sampling.first_seen(entries.where(F.col("form").isin(FORMS)), "accession", ["quarter", "cik"])
    return splits.first_companies(own, "cik", companies, seed) if companies else own


def first_cover_value(facts: DataFrame, concept: str, name: str) -> DataFrame:
    """(accession, name): the first text of a concept of each filing."""
    own = facts.where((F.col("concept") == concept) & F.col("str_value").isNotNull())
    return own.groupBy("accession").agg(F.min_by(F.trim("str_value"), "ordinal").alias(name))


def filing_facts(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """The facts of filings: cover facts of the pages (accession, html) before those that companies report, by ordinal."""
    tagged = tagged_facts(pages, "html", ["accession"]).select((F.col("ordinal") - 1_000_000_000).alias("ordinal"), "concept", F.lit(None).cast("double").alias("num_value"), F.col("value").alias("str_value"), "start", "end", "accession", F.col("end").alias("filed"))
    return tagged.unionByName(company_facts(payloads).select(tagged.columns))


def truth_values(selected: DataFrame) -> DataFrame:
    """(accession, truth): the chosen facts of each filing as one struct of the fields."""
    of = lambda name, column: F.max(F.when(F.col("field") == name, F.col(column)))
    value = lambda n, k: F.try_to_date(of(n, "str_value"), "yyyy-MM-dd") if k == "date" else of(n, "str_value") if k == "categorical" else of(n, "num_value")
    return selected.groupBy("accession").agg(F.struct(*[value(n, k).alias(n) for n, k, *_ in FIELDS]).alias("truth"))


def _statement(found: DataFrame, name: str) -> DataFrame:
    shown = F.array_join(F.concat(F.col("heading"), F.transform("rows", lambda r: F.array_join(r, " | "))), "\n")
    return found.select("accession", F.struct(shown.alias("text"), "rows", "scale", "declared", "share_scale").alias(name))


def build(entries: DataFrame, histories: DataFrame, payloads: DataFrame, pages: DataFrame, companies: int | None = None) -> DataFrame:
    """One row per selected filing: its columns, truth, scales, not_on_page, and drop_reason (null: an item).

    histories and payloads are (cik, value) of JSON, pages (accession, html). A filing without its history or page wasn't fetched;
    banks are dropped before anything else of theirs is read.
    """
    chosen = selected_filings(entries, companies)
    known = histories.select("cik", F.coalesce(industry_code(F.col("value")).isin(BANKS), F.lit(False)).alias("bank"))
    names = primary_documents(histories, keep=("cik",))
    own = chosen.join(known, "cik", "left").join(names, ["cik", "accession"], "left")
    read = own.where(~F.coalesce("bank", F.lit(False)) & F.col("document").isNotNull()).select("accession").join(pages.select("accession", "html"), "accession")
    parts = written(blocks(read, "html", ["accession"]), "corpus-blocks")
    found = filing_facts(read, payloads.join(own.where("not bank").select("cik").distinct(), "cik", "left_semi"))
    found = written(found, "corpus-facts")
    end = first_cover_value(found, "dei:DocumentPeriodEndDate", "period_end").withColumn("period_end", F.try_to_date("period_end", "yyyy-MM-dd"))
    period = first_cover_value(found, "dei:DocumentFiscalPeriodFocus", "fiscal_period")
    reports = end.join(period, "accession")
    matched = fact_operators.candidates(found, reports, field_dim(entries.sparkSession))
    truth = truth_values(fact_operators.select_facts(matched))
    other = fact_operators.period_matches(matched).where("num_value is not null").groupBy("accession", "field").agg(F.array_sort(F.collect_list(F.struct("concept_ord", "num_value"))).alias("m"))
    other = other.select("accession", "field", F.transform(F.slice("m", 2, 8), lambda x: x["num_value"]).alias("values"))  # a field has four concepts at most
    synonyms = other.groupBy("accession").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("synonyms"))
    out = own.join(read.select("accession", F.lit(True).alias("fetched")), "accession", "left").join(reports, "accession", "left").join(truth, "accession", "left").join(synonyms, "accession", "left")
    for section in ("income", "balance"):
        located = written(_statement(statements.locate_statement(parts, "accession", section), section), f"corpus-{section}")
        out = out.join(located, "accession", "left")
    out = out.join(statements.cover(parts, "accession"), "accession", "left").join(statements.auditor(parts, "accession"), "accession", "left")
    out = written(out, "corpus-filings")
    ready = out.withColumn("has_document", F.col("document").isNotNull()).withColumn("readable", F.col("cover").isNotNull()).withColumn("cover", F.coalesce("cover", F.lit(""))).withColumn("auditor", F.coalesce("auditor", F.lit("")))
    paired = pairing.pair(ready.withColumn("_history", F.col("bank").isNotNull()).withColumn("bank", F.coalesce("bank", F.lit(False))))
    gone = F.col("_history") & ~F.col("bank") & F.col("has_document") & F.col("fetched").isNull()
    return written(paired.withColumn("drop_reason", F.when(~F.col("_history") | gone, "not_fetched").otherwise(F.col("drop_reason"))).drop("_history", "fetched"), "corpus-build")


def published(built: DataFrame, cutoff: str) -> DataFrame:
    """The items of a build with the size band of their company by median assets, and their split."""
    items = built.where("drop_reason is null")
    bands = splits.size_bands(items.withColumn("assets", F.col("truth.total_assets")), "cik", "assets", BANDS, BAND_NAMES)
    pools = splits.assign_pools(bands.withColumnRenamed("band", "stratum"), "cik", "stratum")
    return splits.assign_splits(items.join(bands.select("cik", "band"), "cik"), pools, "cik", "filed", cutoff)


def drop_key() -> Column:
    """The tally key of a built row: kept, or its reason."""
    return F.coalesce(F.col("drop_reason"), F.lit("kept"))
