"""Evidence for an audit: where a page prints a value, the scale line above it, and what looks doubtful."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NUMBER
from .statements import MONEY_SCALE, OMITTED, SHARE_SCALE

# A looser reading of a scale, cells that print zero, and how many places are shown.
LOOSE_SCALE = r"(?i)\((?:[^)]*?\b)?(thousands|millions|billions)\b"
DASHES = ["-", "–", "—"]
MOST_MATCHES = 3


def scale_heading(line: Column, shares: bool = False) -> Column:
    """struct(start, text): where a line prints the statement's scale, or a scale of share counts; null where it doesn't."""
    found = [SHARE_SCALE] if shares else [MONEY_SCALE, OMITTED]
    return F.coalesce(*[_first(line, p) for p in found])


def _first(line: Column, pattern: str) -> Column:
    shown = F.regexp_extract(line, f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", 1)
    return F.when(line.rlike(pattern), F.struct((F.length(F.split(line, pattern, 2)[0])).alias("start"), shown.alias("text")))


def scale_lines(lines: DataFrame, key: str, own: str, shares: str) -> DataFrame:
    """(key, line_no, section, text) of the line that prints each field's scale. lines has key, line_no, section, line, the field's own
    section, and whether its share counts have a scale of their own. The own section comes first, then a share scale before the
    heading's, then the strict reading before the loose, then page order."""
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("loose"), F.when(F.col(shares), scale_heading(F.col("line"), True)).alias("m")), F.struct(F.lit(0).alias("kind"), F.lit(1).alias("loose"), F.when(F.col(shares), _first(F.col("line"), LOOSE_SCALE)).alias("m")), F.struct(F.lit(1).alias("kind"), F.lit(0).alias("loose"), scale_heading(F.col("line")).alias("m")), F.struct(F.lit(1).alias("kind"), F.lit(1).alias("loose"), _first(F.col("line"), LOOSE_SCALE).alias("m")))
    found = lines.where(F.col("section").isin("income", "balance")).select(key, "line_no", "section", (F.col("section") != F.col(own)).cast("int").alias("far"), F.inline(kinds)).where("m is not null")
    order = F.struct("far", "kind", "loose", "line_no")
    return found.groupBy(key).agg(F.min_by(F.struct("line_no", "section", "m.text"), order).alias("r")).select(key, "r.*")


def shown_number(value: Column) -> Column:
    """A number as an auditor reads it: whole ones without a fraction, others with two places, or as many up to six as show that
    it isn't zero."""
    places = [F.when((F.bround(F.abs(value), p) != 0) | F.lit(p == 6), F.format_number(value, p)) for p in range(2, 7)]
    return F.when(F.rint(value) == value, F.format_number(value, 0)).otherwise(F.coalesce(*places))


def column_at(line: Column, position: Column) -> Column:
    """The number of the cell that a place of a rendered row is in; null for lines of one cell."""
    before = F.substring(line, F.lit(1), position)
    return F.when(F.contains(line, F.lit(" | ")), F.size(F.split(before, r" \| ")) - 1)


def dash_cells(line: Column) -> Column:
    """(column, start) of the cells after the first that print zero as a dash."""
    cells = F.split(line, r" \| ")
    ends = F.transform(cells, lambda c, i: F.length(F.array_join(F.slice(cells, 1, i), " | ")) + F.when(i > 0, 3).otherwise(0))
    found = F.transform(cells, lambda c, i: F.when((i > 0) & F.trim(c).isin(DASHES), F.struct(i.alias("column"), (F.element_at(ends, i + 1) + F.length(c) - F.length(F.ltrim(c))).alias("start"))))
    return F.filter(found, lambda x: x.isNotNull())


def whole_word(line: Column, form: str) -> Column:
    """Where a form stands in a line as a whole word, case aside; null where it doesn't."""
    pattern = r"(?i)(?<!\w)" + re.escape(form) + r"(?!\w)"
    return F.when(line.rlike(pattern), F.length(F.split(line, pattern, 2)[0]))


def loose_pattern(form: Column) -> Column:
    """A pattern for a printed form with any white space between its words and around commas."""
    words = F.filter(F.split(F.regexp_replace(form, ",", " , "), r"\s+"), lambda w: w != "")
    return F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([.\\^$|?*+()\[\]{}/])", r"\\$1")), r"\s*"))


def printed_places(lines: DataFrame, key: str, truth: str, unit: str) -> DataFrame:
    """(key, line_no, printed, column, parenthesised, off, place): the printed numbers nearest a truth, in page order among equals."""
    hits = F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0))
    gaps = F.split("line", NUMBER, -1)
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1))), lambda i: F.struct(F.get(hits, i - 1).alias("shown"), F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), i), lambda j: F.array(F.get(gaps, j - 1), F.when(j < i, F.get(hits, j - 1)).otherwise("")))), "").alias("before")))
    found = lines.select(key, "line_no", "line", truth, unit, F.posexplode(one).alias("at", "n")).where("n.shown is not null")
    value = F.replace(F.col("n.shown"), F.lit(","), F.lit("")).cast("double")
    found = found.withColumn("printed", value).withColumn("off", F.abs(F.col("printed") * F.col(unit) - F.abs(F.col(truth)))).withColumn("column", column_at(F.col("line"), F.length("n.before")))
    found = found.withColumn("parenthesised", F.rtrim(F.regexp_replace(F.rtrim("n.before"), r"\$+$", "")).endswith("("))
    place = F.row_number().over(Window.partitionBy(key).orderBy("off", "line_no", "at"))
    return found.withColumn("place", place).where(F.col("place") <= MOST_MATCHES).select(key, "line_no", "printed", "column", "parenthesised", "off", "place")


def evidence_flags(value: Column, signed: Column, has_scale_line: Column, scale: Column, scale_is_own: Column, columns: Column, parenthesised: Column) -> Column:
    """What is doubtful about a numeric label, by name: the columns and brackets are those of the places where it was found."""
    n = F.size(columns)
    flags = F.array(
        F.when(value.isNull(), "null_label"), F.when((scale != 1) & ~has_scale_line, "no_scale_printed"), F.when((scale != 1) & has_scale_line & ~scale_is_own, "scale_of_another_statement"),
        F.when(value.isNotNull() & (n == 0), "not_found"), F.when((n > 0) & F.forall(columns, lambda c: F.coalesce(c > 1, F.lit(False))), "only_in_a_later_column"),
        F.when(signed & (value < 0) & (n > 0) & ~F.exists(parenthesised, lambda p: p), "negative_without_brackets"), F.when(signed & (value > 0) & (n > 0) & F.forall(parenthesised, lambda p: p), "positive_in_brackets"),
    )
    return F.filter(flags, lambda f: f.isNotNull())
