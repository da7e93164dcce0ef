"""Readings of printed text: numbers, dates, scales, statement titles, served names, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, patterns of scales, titles and rows, and the states by code.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
ZERO_DASH = r"(?:^|[|\s])[-–—](?=$|[|\s])"
SHARE_NAMED = r"(?i)weighted|number of (?:common |ordinary )?shares|shares outstanding"
SHARE_ROW = r"(?i)weighted|\bshares\b|^\W*(?:basic|diluted)\b|assuming dilution"
PER_SHARE = r"(?i)per\s+(?:common\s+|ordinary\s+)?share\b|per[\s-]share"
TITLES = {
    "income": r"(?i)statements?\s+of\s+(?:consolidated\s+)?(?:operations|income|earnings|(?:net\s+)?loss)|income\s+statements?",
    "comprehensive": r"(?i)statements?\s+of\s+comprehensive",
    "balance": r"(?i)balance\s+sheets?|statements?\s+of\s+(?:consolidated\s+)?financial\s+(?:position|condition)|statements?\s+of\s+condition",
    "cash": r"(?i)statements?\s+of\s+(?:consolidated\s+)?cash\s+flows?",
    "equity": r"(?i)statements?\s+of\s+(?:consolidated\s+)?(?:changes\s+in\s+)?(?:stockholders|shareholders|members|partners)['’]?\s+(?:equity|deficit)",
}
NUMERIC_CELL = r"^[($\-−\s]*\d[\d,]*(?:\.\d+)?\s*\)?%?$"


def clean(text: Column) -> Column:
    """White space of all kinds as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ​ ]+", " "))


def printed_numbers(text: Column) -> Column:
    """The magnitude of every printed number, then 0 if a dash stands alone for it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda s: F.replace(s, F.lit(","), F.lit("")).cast("double"))
    return F.when(text.rlike(ZERO_DASH), F.concat(found, F.array(F.lit(0.0)))).otherwise(found)


def share_count_row(label: Column) -> Column:
    """Whether a row with this label prints a share count: it names one, or looks like one and isn't per share."""
    return label.rlike(SHARE_NAMED) | (label.rlike(SHARE_ROW) & ~label.rlike(PER_SHARE))


def date_forms(day: Column) -> Column:
    """All printed spellings of a date: nine, and thirteen in September."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    short = F.substring(month, 1, 3)
    names = F.array(month, short, F.concat(short, F.lit(".")))
    names = F.when(F.month(day) == 9, F.concat(names, F.array(F.lit("Sept."), F.lit("Sept")))).otherwise(names)
    year, d = F.year(day).cast("string"), F.dayofmonth(day)
    days = F.array(d.cast("string"), F.lpad(d.cast("string"), 2, "0"))
    spelled = F.flatten(F.transform(names, lambda m: F.transform(days, lambda x: F.concat(m, F.lit(" "), x, F.lit(", "), year))))
    return F.concat(spelled, F.array(F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "yyyy-MM-dd")))


def parse_date(text: Column) -> Column:
    """A cover page's date: ISO, month day year or day month year with the month whole or abbreviated and the comma there or
    not, or m/d/yyyy; null for anything else."""
    t = F.lower(F.regexp_replace(clean(text), r"\s+,", ","))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for n in ([m, m[:3], "Sept"] if i == 9 else [m, m[:3]] if m != "May" else [m]) for x in (n.lower(), str(i))])
    part = lambda p, i: F.regexp_extract(t, p, i)
    shapes = [
        (r"^(\d{4})-(\d{2})-(\d{2})$", lambda p: (part(p, 1), part(p, 2), part(p, 3))),
        (r"^([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$", lambda p: (part(p, 3), F.try_element_at(months, part(p, 1)), part(p, 2))),
        (r"^(\d{1,2})\s+([a-z]+)\.?,?\s+(\d{4})$", lambda p: (part(p, 3), F.try_element_at(months, part(p, 2)), part(p, 1))),
        (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", lambda p: (part(p, 3), part(p, 1), part(p, 2))),
    ]
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(F.concat_ws("-", *of(p)), "y-M-d")) for p, of in shapes])


def statement_titles(text: Column) -> Column:
    """The statements that a text names."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in TITLES.items()]), lambda k: k.isNotNull())


def resolved_titles(titles: Column, labels: Column, section: Column) -> Column:
    """titles, with a combined comprehensive statement that carries per-share lines taken for the income statement."""
    combined = (section == "income") & F.array_contains(titles, "comprehensive") & labels.rlike(r"(?i)per\s+(?:common\s+|basic\s+|diluted\s+)?share|per[\s-]share")
    return F.when(combined, F.array_union(F.array_remove(titles, "comprehensive"), F.array(F.lit("income")))).otherwise(titles)


def numeric_cells(rows: Column) -> Column:
    """How many cells of a table are numbers."""
    return F.size(F.filter(F.flatten(rows), lambda c: c.rlike(NUMERIC_CELL)))


def printed_as(kind: Column, printed: Column, truth: Column, scale: Column, share_scale: Column) -> Column:
    """Whether a printed number is this fact at the precision it is printed to; signs don't count."""
    unit = F.when(kind == "share_count", F.coalesce(share_scale, scale)).otherwise(scale)
    exact = F.abs(printed * unit - F.abs(truth)) <= unit / 2 * (1 + 1e-9)
    return F.when(kind == "per_share", F.abs(printed - F.abs(truth)) <= 0.005).otherwise(exact)


def percent(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", value * 100)


def signed_percent(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%+.{places}f%%", value * 100)


def volume(value: Column) -> Column:
    """A monthly volume in thousands, 'never' for null."""
    return F.coalesce(F.format_string("%,.0fk", value / 1000), F.lit("never"))


def served_name(model: Column, form: Column) -> Column:
    return F.concat_ws("-", model, form)


def parse_served_name(name: Column, forms: list[str]) -> Column:
    """struct(run, format) of a served name; longer formats are tried first."""
    import re

    tail = "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True))
    return F.struct(F.regexp_extract(name, rf"^(.+?)-({tail})$", 1).alias("run"), F.regexp_extract(name, rf"^(.+?)-({tail})$", 2).alias("format"))


RUN_NAME = r"^(.+)-r(\d+)-lr([\d.e-]+)-n(\d+|all)-s(\d+)-e(\d+)$"


def run_parts(name: Column) -> Column:
    """struct(base, rank, rate, volume, seed, epochs) of a training run's name, empty text where it isn't one."""
    return F.struct(*[F.regexp_extract(name, RUN_NAME, i + 1).alias(n) for i, n in enumerate(["base", "rank", "rate", "volume", "seed", "epochs"])])
