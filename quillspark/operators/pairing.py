"""Pairing of filings with their truth: where a fact is printed, and the first reason why a filing can't be an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import normalise_name, tolerance
from ..functions.text import date_forms, printed_as, printed_numbers, share_count_row
from ..schema import FIELDS, FISCAL_PERIODS, REQUIRED
from ..sources.markup import STATES

#: Fields read from a report's shape, and those whose label becomes null where no line of theirs is printed.
NOT_SEARCHED, NULL_WHEN_ABSENT = ["fiscal_period"], ["shares_diluted"]


def share_numbers(rows: Column) -> Column:
    """The numbers printed on a statement's share-count rows."""
    own = F.filter(rows, lambda r: (F.size(r) > 0) & share_count_row(r[0]))
    return printed_numbers(F.array_join(F.flatten(F.transform(own, lambda r: F.slice(r, 2, F.size(r)))), " | "))


def line_printed(rows: Column) -> Column:
    """Whether a statement prints a share-count line at all."""
    return F.exists(rows, lambda r: (F.size(r) > 0) & share_count_row(r[0]))


def date_printed(day: Column, text: Column) -> Column:
    folded = F.lower(F.replace(F.regexp_replace(text, r"\s+", " "), F.lit(" ,"), F.lit(",")))
    return F.exists(date_forms(day), lambda form: F.contains(folded, F.lower(form)))


def name_printed(name: Column, text: Column, states: bool = False) -> Column:
    """Whether a name, or for a state's code the state's name, is printed as whole words after folding."""
    folded = F.concat(F.lit(" "), normalise_name(text), F.lit(" "))
    shown = lambda n: F.contains(folded, F.concat(F.lit(" "), normalise_name(n), F.lit(" ")))
    if not states:
        return shown(name)
    spelled = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.upper(name))
    return shown(name) | F.coalesce(shown(spelled), F.lit(False))


def number_printed(kind: Column, truth: Column, numbers: Column, scale: Column, share_scale: Column) -> Column:
    return F.exists(numbers, lambda n: printed_as(kind, n, truth, scale, share_scale))


def near_printed(kind: Column, value: Column, numbers: Column, scale: Column, share_scale: Column) -> Column:
    """Whether a printed number lies within the grader's tolerance of a value."""
    unit = F.when(kind == "per_share", F.lit(1.0)).when(kind == "share_count", F.coalesce(share_scale, scale)).otherwise(scale)
    return F.exists(numbers, lambda n: F.abs(n * unit - F.abs(value)) <= tolerance(kind, value, scale, share_scale))


def printed_synonym(kind: str, value: Column, others: Column, numbers: Column, scale: Column, share_scale: Column) -> Column:
    """value if it is printed; else the first of the other values filed for the same period that is, unless value is near a printed
    number and the other isn't the same line's; else value."""
    k = F.lit(kind)
    near = near_printed(k, value, numbers, scale, share_scale)
    fits = lambda o: number_printed(k, o, numbers, scale, share_scale) & (~near | (F.abs(o - value) <= tolerance(k, value, scale, share_scale)))
    first = F.try_element_at(F.filter(F.coalesce(others, F.array().cast("array<double>")), fits), F.lit(1))
    return F.when(value.isNull() | number_printed(k, value, numbers, scale, share_scale), value).otherwise(F.coalesce(first, value))


def locatable(name: str, kind: str, value: Column, cover: Column, income: Column, balance: Column, auditor: Column, income_rows: Column, scale: Column, share_scale: Column) -> Column:
    """Whether a field's truth is printed in the section that it is read from."""
    section = {"cover": cover, "income": income, "balance": balance, "auditor": auditor}[next(f[2] for f in FIELDS if f[0] == name)]
    if name in NOT_SEARCHED:
        return F.lit(True)
    if kind == "date":
        return date_printed(value, section)
    if kind == "categorical":
        return name_printed(value, section, name == "state_of_incorporation")
    numbers = share_numbers(income_rows) if kind == "share_count" else printed_numbers(section)
    return number_printed(F.lit(kind), value, numbers, scale, share_scale)


def read_share_scale(shares: Column, income_rows: Column, scale: Column, share_scale: Column) -> Column:
    """1 where a heading scales only money and the count is printed whole but not at the money's scale."""
    null = F.lit(None).cast("double")
    at = lambda s: number_printed(F.lit("share_count"), shares, share_numbers(income_rows), scale, s)
    return F.when(shares.isNotNull() & share_scale.isNull() & (scale != 1) & ~at(null) & at(F.lit(1.0)), 1.0).otherwise(share_scale)


def drop_reason(has_document: Column, industry_bank: Column, period_end: Column, fiscal_period: Column, readable: Column, income: Column, balance: Column, income_scale: Column, balance_scale: Column, truth: Column, invalid: Column, unlocatable: Column) -> Column:
    """The first reason, in order, why a filing isn't an item, as 'reason' or 'reason:field'; null if it is one.

    Scales are null where they aren't declared; invalid and unlocatable name a field or are null.
    """
    first_missing = F.coalesce(*[F.when(truth[n].isNull(), F.lit(n)) for n in REQUIRED])
    return (
        F.when(industry_bank, "bank").when(~has_document, "no_primary_document")
        .when(period_end.isNull() | ~F.coalesce(fiscal_period.isin(FISCAL_PERIODS), F.lit(False)), "no_period")
        .when(~readable, "unreadable").when(income.isNull(), "no_income_statement").when(balance.isNull(), "no_balance_sheet")
        .when(income_scale != balance_scale, "mixed_scale").when(invalid.isNotNull(), F.concat(F.lit("truth_invalid:"), invalid))
        .when(first_missing.isNotNull(), F.concat(F.lit("truth_missing:"), first_missing))
        .when(unlocatable.isNotNull(), F.concat(F.lit("unlocatable:"), unlocatable))
    )


def pair(filings: DataFrame) -> DataFrame:
    """filings (accession, has_document, bank, readable, period_end, fiscal_period, truth, cover, income and balance as
    struct(text, rows, scale, declared, share_scale), auditor, and maybe synonyms, a map of field to the other values filed for
    the period) with truth as the page prints it, scale, share_scale, not_on_page and drop_reason."""
    scale = F.coalesce(F.when(F.col("income.declared"), F.col("income.scale")), F.when(F.col("balance.declared"), F.col("balance.scale")), F.lit(1.0))
    out = filings.withColumn("scale", scale).withColumn("share_scale", read_share_scale(F.col("truth.shares_diluted"), F.col("income.rows"), F.col("scale"), F.col("income.share_scale")))
    if "synonyms" in filings.columns:
        text = {"income": "income.text", "balance": "balance.text"}
        numbers = lambda kind, section: share_numbers(F.col("income.rows")) if kind == "share_count" else printed_numbers(F.col(text[section]))
        new = [printed_synonym(k, F.col(f"truth.{n}"), F.col("synonyms")[n], numbers(k, s), F.col("scale"), F.col("share_scale")).alias(n) if s in text else F.col(f"truth.{n}").alias(n) for n, k, s, *_ in FIELDS]
        out = out.withColumn("truth", F.when(F.col("income").isNotNull() & F.col("balance").isNotNull(), F.struct(*new)).otherwise(F.col("truth")))
    found = {n: locatable(n, k, F.col(f"truth.{n}"), F.col("cover"), F.col("income.text"), F.col("balance.text"), F.col("auditor"), F.col("income.rows"), F.col("scale"), F.col("share_scale")) for n, k, *_ in FIELDS}
    lost = {n: F.col(f"truth.{n}").isNotNull() & ~F.coalesce(f, F.lit(False)) for n, f in found.items()}
    absent = {n: lost[n] & ~F.coalesce(line_printed(F.col("income.rows")), F.lit(False)) for n in NULL_WHEN_ABSENT}
    out = out.withColumn("not_on_page", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in absent.items()]), lambda n: n.isNotNull()))
    first_lost = F.coalesce(*[F.when(c & ~absent.get(n, F.lit(False)), F.lit(n)) for n, c in lost.items()])
    negative = F.coalesce(*[F.when(F.col(f"truth.{n}") < 0, F.lit(n)) for n in ("shares_diluted", "total_assets", "total_liabilities", "cash_and_equivalents")])
    declared = lambda s: F.when(F.col(f"{s}.declared"), F.col(f"{s}.scale"))
    reason = drop_reason(F.col("has_document"), F.col("bank"), F.col("period_end"), F.col("fiscal_period"), F.col("readable"), F.col("income"), F.col("balance"), declared("income"), declared("balance"), F.col("truth"), negative, first_lost)
    return out.withColumn("drop_reason", reason)
