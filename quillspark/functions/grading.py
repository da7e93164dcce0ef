"""Field grading as column expressions: tolerances, misreadings by name, categorical folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NUMERIC_KINDS, PER_SHARE_TOLERANCE, RATIO_TOLERANCE, RELATIVE_TOLERANCE, SCALE_RATIOS

# What legal names end in without naming anyone.
LEGAL_SUFFIXES = ["llp", "llc", "lp", "pc", "pllc", "inc", "ltd", "plc", "sc", "ag", "gmbh"]


def printed_unit(kind: Column, scale: Column, share_scale: Column) -> Column:
    """The smallest step that a page prints: a cent, or one unit of its scale."""
    return F.when(kind == "per_share", F.lit(0.01)).when(kind == "share_count", F.coalesce(share_scale, scale)).otherwise(scale)


def tolerance(kind: Column, truth: Column, scale: Column, share_scale: Column) -> Column:
    """How far a numeric reading may lie from its truth: half a cent, or the larger of half a percent and half a unit."""
    wide = F.greatest(F.lit(RELATIVE_TOLERANCE) * F.abs(truth), printed_unit(kind, scale, share_scale) / 2)
    return F.when(kind == "per_share", F.lit(PER_SHARE_TOLERANCE)).otherwise(wide)


def nearer_distractor(predicted: Column, truth: Column, others: Column, unit: Column) -> Column:
    """Whether a distractor that prints differently from the truth is nearer the reading than the truth is."""
    return F.exists(others, lambda d: (F.rint(d / unit) != F.rint(truth / unit)) & (F.abs(predicted - d) < F.abs(predicted - truth)))


def number_miss(predicted: Column, truth: Column, allowed: Column) -> Column:
    """sign, scale or wrong_value for a number that is known to be wrong."""
    ratio = F.try_divide(predicted, truth)
    scaled = F.exists(F.array(*[F.lit(r) for r in SCALE_RATIOS]), lambda r: F.abs(ratio - r) <= RATIO_TOLERANCE * r)
    return F.when((truth != 0) & (F.abs(predicted + truth) <= allowed), "sign").when((truth != 0) & scaled, "scale").otherwise("wrong_value")


def normalise_name(value: Column) -> Column:
    """Lower case, ' and ' as ' & ', points and apostrophes gone, other punctuation as a space, legal suffixes off the end."""
    text = F.replace(F.lower(F.trim(value)), F.lit(" and "), F.lit(" & "))
    text = F.regexp_replace(text, "[.'’]", "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_&]+", " "))
    endings = "|".join(LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(text, rf"(?:(?:^| )(?:{endings}))+$", ""))


def grade_number(kind: Column, predicted: Column, truth: Column, scale: Column, share_scale: Column, others: Column) -> Column:
    """'correct' or the miss reason of a numeric field; others is an array of doubles, empty for none."""
    allowed = tolerance(kind, truth, scale, share_scale)
    agree = F.abs(predicted - truth) <= allowed
    near = nearer_distractor(predicted, truth, others, printed_unit(kind, scale, share_scale))
    other = F.exists(others, lambda d: F.abs(predicted - d) <= allowed)
    finite = ~(F.isnan(predicted) | predicted.isin(float("inf"), float("-inf")))
    return (
        F.when(truth.isNull() & predicted.isNull(), "correct").when(predicted.isNull(), "missing").when(truth.isNull(), "hallucinated").when(~finite, "malformed")
        .when(agree & near, "wrong_period").when(agree, "correct").when(other, "wrong_period").otherwise(number_miss(predicted, truth, allowed))
    )


def grade_text(kind: Column, predicted: Column, truth: Column, others: Column) -> Column:
    """'correct' or the miss reason of a date (as ISO text) or categorical field."""
    same = lambda a, b: F.when(kind == "date", a == b).otherwise(normalise_name(a) == normalise_name(b))
    return (
        F.when(truth.isNull() & predicted.isNull(), "correct").when(predicted.isNull(), "missing").when(truth.isNull(), "hallucinated")
        .when(same(predicted, truth), "correct").when(F.exists(others, lambda d: same(predicted, d)), "wrong_period").otherwise("wrong_value")
    )


def grade_field(kind: Column, p_num: Column, p_str: Column, t_num: Column, t_str: Column, scale: Column, share_scale: Column, distractors: Column, parsed: Column) -> Column:
    """'correct' or the miss reason of any field; an answer that didn't parse is malformed whatever the truth."""
    numbers = F.transform(F.filter(F.coalesce(distractors, F.array()), lambda d: d["num"].isNotNull()), lambda d: d["num"])
    texts = F.transform(F.filter(F.coalesce(distractors, F.array()), lambda d: d["str"].isNotNull()), lambda d: d["str"])
    return (
        F.when(~parsed, "malformed").when(kind.isin(NUMERIC_KINDS), grade_number(kind, p_num, t_num, scale, share_scale, numbers))
        .otherwise(grade_text(kind, p_str, t_str, texts))
    )
