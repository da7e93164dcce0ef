"""Statement location over ordered blocks: headings, best tables, continuations, covers, audit signatures, as windows by filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NUMBER, clean, numeric_cells, resolved_titles, statement_titles

# The lines that statements carry (the first of each must be there), and the wordings around them.
SIGNATURES = {
    "income": [r"(?i)net\s+\(?(?:income|loss|earnings)", r"(?i)per\s+(?:common\s+|basic\s+|diluted\s+)?share|per[\s-]share", r"(?i)\brevenues?\b|\bnet\s+sales\b|\bsales\b", r"(?i)operating\s+(?:income|loss|expenses)|(?:income|loss)\s+from\s+operations", r"(?i)income\s+tax|provision\s+for\s+(?:income\s+)?taxes", r"(?i)weighted[\s-]+average"],
    "balance": [r"(?i)total\s+assets", r"(?i)total\s+liabilities", r"(?i)(?:stockholders|shareholders)['’]?\s+(?:equity|deficit)", r"(?i)cash\s+and\s+cash\s+equivalents", r"(?i)total\s+current\s+(?:assets|liabilities)", r"(?i)retained\s+earnings|accumulated\s+deficit"],
}
INTRODUCING = r"(?i)\bthe\s+following\s+table\b|\bas\s+a\s+percentage\s+of\b|:\s*$"
COVER_END = r"(?i)^\s*(?:table\s+of\s+contents|index)\s*$|^\s*part\s+i\b"
TENURE = r"(?i)served\s+as\s+[^.]{0,80}?(?:auditors?|accounting\s+firm)\s+(?:of\s+[^.]{0,40}?\s+)?since"
MONEY_SCALE = r"(?i)\bin\s+(thousands|millions|billions)\b|\b(thousands|millions|billions)\s+of\s+(?:u\.?s\.?\s+)?dollars\b"
OMITTED = r"(?i)\b000['’]?s\s+omitted|\bin\s+\$\s*000['’]?s\b"
SHARE_SCALE = r"(?i)\bshares?\b[^)]{0,40}?\bin\s+(thousands|millions|billions)\b"
EXCEPTED, PER_SHARES, SHARES = r"(?i)\bexcept\b([^)]*)", r"(?i)per[\s-]+shares?\b", r"(?i)\bshares?\b"
LABEL_SCALE = r"(?i)\((?:in\s+)?(thousands|millions)\)|\bin\s+(thousands|millions)\b|\(000['’]?s\)"
HEADING_BLOCKS, HEADING_CHARS, LEAST_SIGNATURES, LEAST_CELLS, TITLE_WEIGHT = 4, 300, 3, 5, 3
COVER_CHARS, COVER_LEAST = 5000, 200
AUDIT_BEFORE, AUDIT_AFTER, AUDIT_CHARS = 8, 3, 160


def _by(filing: str) -> object:
    return Window.partitionBy(filing).orderBy("idx")


def _scale_of(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w == "thousands", 1e3).when(w == "millions", 1e6).when(w == "billions", 1e9)


def scales(text: Column) -> Column:
    """struct(scale, declared, share_scale) of a heading: shares have their own scale where it says so, and print whole where
    the money's scale excepts share counts (and not only per-share amounts)."""
    word = F.coalesce(*[F.nullif(F.regexp_extract(text, MONEY_SCALE, i), F.lit("")) for i in (1, 2)])
    scale = F.when(word.isNotNull(), _scale_of(word)).when(text.rlike(OMITTED), 1e3)
    own = F.nullif(F.regexp_extract(text, SHARE_SCALE, 1), F.lit(""))
    clause = F.regexp_extract(text, EXCEPTED, 1)
    excepted = F.regexp_replace(clause, PER_SHARES, "").rlike(SHARES)
    share = F.when(own.isNotNull(), _scale_of(own)).when(scale.isNotNull() & excepted, 1.0)
    return F.struct(F.coalesce(scale, F.lit(1.0)).alias("scale"), scale.isNotNull().alias("declared"), share.alias("share_scale"))


def label_scale(rows: Column) -> Column:
    """The scale in the label of the first share row that prints one."""
    labels = F.filter(F.transform(rows, lambda r: F.try_element_at(r, F.lit(1))), lambda x: x.rlike(r"(?i)\bshares\b") & x.rlike(LABEL_SCALE))
    first = F.try_element_at(labels, F.lit(1))
    word = F.coalesce(*[F.nullif(F.regexp_extract(first, LABEL_SCALE, i), F.lit("")) for i in (1, 2)], F.when(first.isNotNull(), F.lit("thousands")))
    return _scale_of(word)


def with_headings(blocks: DataFrame, filing: str) -> DataFrame:
    """blocks with heading: the short texts directly above, up to four, back to a table, a long text or an introduction."""
    near = F.collect_list(F.struct("text", "rows")).over(_by(filing).rowsBetween(-HEADING_BLOCKS, -1))
    stops = lambda b: b["rows"].isNotNull() | (F.length(b["text"]) > HEADING_CHARS) | b["text"].rlike(INTRODUCING)
    kept = F.aggregate(near, F.expr("cast(array() as array<string>)"), lambda acc, b: F.when(F.coalesce(stops(b), F.lit(False)), F.expr("cast(array() as array<string>)")).otherwise(F.concat(acc, F.array(b["text"]))))
    return blocks.withColumn("heading", kept)


def _labels(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(""))), " ")


def _title_text(heading: Column, rows: Column, n: int = 3) -> Column:
    return F.concat_ws(" ", F.array_join(heading, " "), F.array_join(F.transform(F.slice(rows, 1, n), lambda r: F.array_join(r, " ")), " "))


def _matched(section: str, labels: Column) -> Column:
    out = F.lit(0)
    for p in SIGNATURES[section]:
        out = out + labels.rlike(p).cast("int")
    return out


def table_scores(blocks: DataFrame, filing: str, section: str) -> DataFrame:
    """Tables that can be the statement, with score: its lines, and a weight for its own title; other statements' titles rule out."""
    t = with_headings(blocks, filing).where("rows is not null")
    labels = _labels(F.col("rows"))
    titles = resolved_titles(statement_titles(_title_text(F.col("heading"), F.col("rows"))), labels, F.lit(section))
    t = t.withColumn("_titles", titles).withColumn("_n", _matched(section, labels))
    own = F.array_contains("_titles", section)
    fits = (numeric_cells(F.col("rows")) >= LEAST_CELLS) & (own | (F.size("_titles") == 0)) & labels.rlike(SIGNATURES[section][0]) & (F.col("_n") >= LEAST_SIGNATURES)
    return t.where(fits).withColumn("score", F.col("_n") + F.when(own, TITLE_WEIGHT).otherwise(0)).drop("_titles", "_n")


def continuations(blocks: DataFrame, filing: str, section: str) -> DataFrame:
    """(filing, idx, more): rows of the next table within five blocks after each table, if it carries the statement on."""
    b = with_headings(blocks, filing)
    ahead = F.collect_list(F.struct("text", "rows", "heading")).over(_by(filing).rowsBetween(1, HEADING_BLOCKS + 1))
    long_before = lambda xs: F.exists(xs, lambda x: x["rows"].isNull() & (F.length(x["text"]) > HEADING_CHARS))
    at = F.array_position(F.transform(ahead, lambda x: x["rows"].isNotNull()), True)
    out = b.withColumn("_ahead", ahead).withColumn("_at", at.cast("int")).where("rows is not null and _at > 0")
    out = out.where(~long_before(F.slice("_ahead", 1, F.col("_at")))).withColumn("_t", F.get("_ahead", F.col("_at") - 1))
    labels = _labels(F.col("_t.rows"))
    titles = resolved_titles(statement_titles(_title_text(F.col("_t.heading"), F.col("_t.rows"))), labels, F.lit(section))
    fits = (F.array_contains(titles, section) | (F.size(titles) == 0)) & (_matched(section, labels) >= 2) & (numeric_cells(F.col("_t.rows")) >= LEAST_CELLS)
    return out.where(fits).select(filing, "idx", F.col("_t.rows").alias("more"))


def locate_statement(blocks: DataFrame, filing: str, section: str) -> DataFrame:
    """(filing, idx, heading, rows, scale, declared, share_scale): the best table of each filing, the earliest among equals,
    with the rows of its continuation."""
    best = table_scores(blocks, filing, section).groupBy(filing).agg(F.max_by(F.struct("idx", "heading", "rows"), F.struct("score", (-F.col("idx")).alias("i"))).alias("s")).select(filing, "s.*")
    titled = F.transform("heading", lambda h: statement_titles(h))
    mine = (lambda t: F.array_contains(t, "income") | F.array_contains(t, "comprehensive")) if section == "income" else (lambda t: F.array_contains(t, "balance"))
    at = F.array_position(F.transform(titled, mine), True).cast("int")
    inside = F.exists(F.slice("rows", 1, 6), lambda r: mine(statement_titles(F.array_join(r, " "))))
    heading = F.when(at > 0, F.slice("heading", F.greatest(at, F.lit(1)), F.size("heading"))).when(inside, F.expr("cast(array() as array<string>)")).otherwise(F.col("heading"))
    out = best.withColumn("heading", heading).join(continuations(blocks, filing, section), [filing, "idx"], "left")
    out = out.withColumn("_s", scales(_title_text(F.col("heading"), F.col("rows"), 6))).withColumn("rows", F.concat("rows", F.coalesce("more", F.expr("cast(array() as array<array<string>>)"))))
    return out.select(filing, "idx", "heading", "rows", "_s.scale", "_s.declared", F.coalesce(label_scale(F.col("rows")), "_s.share_scale").alias("share_scale"))


def _rendered() -> Column:
    return F.coalesce("text", F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n"))


def cover(blocks: DataFrame, filing: str) -> DataFrame:
    """(filing, cover): blocks until 5,000 characters are used, or a heading that ends the cover after 200."""
    b = blocks.withColumn("_r", _rendered()).withColumn("_used", F.coalesce(F.sum(F.length("_r")).over(_by(filing).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stop = (F.col("_used") >= COVER_CHARS) | ((F.col("_used") >= COVER_LEAST) & F.col("rows").isNull() & F.col("text").rlike(COVER_END))
    b = b.withColumn("_over", F.max(stop.cast("int")).over(_by(filing))).where("_over = 0")
    return b.groupBy(filing).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "_r"))), lambda x: x["_r"]), "\n").alias("cover"))


def auditor(blocks: DataFrame, filing: str) -> DataFrame:
    """(filing, auditor): short lines around each sentence on an auditor's tenure, each once, in order of first reach."""
    tenure = blocks.where(F.col("rows").isNull() & F.col("text").rlike(TENURE)).select(filing, F.col("idx").alias("_at"))
    reach = tenure.select(filing, "_at", F.explode(F.sequence(F.col("_at") - AUDIT_BEFORE, F.col("_at") + AUDIT_AFTER)).alias("idx"))
    near = reach.join(blocks.where("rows is null").select(filing, "idx", clean(F.col("text")).alias("text")), [filing, "idx"])
    near = near.where((F.length("text") > 0) & ((F.length("text") <= AUDIT_CHARS) | (F.col("idx") == F.col("_at"))))
    first = near.groupBy(filing, "text").agg(F.min(F.struct("_at", "idx")).alias("o"))
    return first.groupBy(filing).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n").alias("auditor"))


def lines_with_sections(texts: DataFrame, key: str, text: str, header: str = r"^\[(.+)\]$") -> DataFrame:
    """(key, line_no, line, section, offset): lines of a text, the last header above each, and where each starts."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    head = F.nullif(F.regexp_extract("line", header, 1), F.lit(""))
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).withColumn("offset", before)


def closest_numbers(lines: DataFrame, key: str, truth: str, unit: str, most: int = 3) -> DataFrame:
    """(key, line_no, printed, off, place): the printed numbers nearest a truth, page order among equals, at most three."""
    printed = F.explode(F.transform(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)), lambda s: F.replace(s, F.lit(","), F.lit("")).cast("double")))
    found = lines.select(key, "line_no", truth, unit, printed.alias("printed")).withColumn("off", F.abs(F.col("printed") * F.col(unit) - F.abs(F.col(truth))))
    place = F.row_number().over(Window.partitionBy(key).orderBy("off", "line_no"))
    return found.withColumn("place", place).where(F.col("place") <= most).select(key, "line_no", "printed", "off", "place")
