"""Model answers: extraction of the JSON object, whole-object validation, canonical writing."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTRACTION, FIELDS, FISCAL_PERIODS

#: Fields that may not be negative (nor NaN).
NON_NEGATIVE = frozenset(["shares_diluted", "total_assets", "total_liabilities", "cash_and_equivalents"])
_NUMBER = re.compile(r"\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+)(?:[eE][+-]?\d+)?\s*|\s*[+-]?(?:inf|infinity|nan)\s*", re.I)


def candidate(text: Column) -> Column:
    """What lies between the first '{' and the last '}' of an answer, fences or prose around it or not; null without."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def _number(value: object, positive: bool) -> float:
    if isinstance(value, bool) or isinstance(value, int | float):
        out = float(value)
    elif isinstance(value, str) and _NUMBER.fullmatch(value):
        out = float(value.replace("_", ""))
    else:
        raise ValueError
    if positive and not out >= 0:
        raise ValueError
    return out


def _date(value: object) -> dt.date:
    if isinstance(value, str):
        m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?", value.strip())
        if m and not any(x and x.strip("0") for x in m.groups()[1:]):
            return dt.date.fromisoformat(m[1])
        if re.fullmatch(r"-?\d+(?:\.0+)?", value.strip()):
            return _date(float(value))
    if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value):
        seconds = value / 1000 if abs(value) > 2e10 else value
        if seconds % 86400 == 0:
            return dt.date(1970, 1, 1) + dt.timedelta(seconds=seconds)
    raise ValueError


def validate(text: str | None) -> dict | None:
    """The fifteen fields of an answer, or None: numbers may be written as text and dates as midnights, but an unknown key,
    a value of another kind or a negative where none can be rejects the whole object."""
    if text is None:
        return None
    text = text.strip()
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end <= start:
        return None
    try:
        found = json.loads(text[start : end + 1])
        if not isinstance(found, dict) or found.keys() - {f[0] for f in FIELDS}:
            return None
        out: dict = {}
        for name, kind, *_ in FIELDS:
            value = found.get(name)
            if value is None:
                out[name] = None
            elif kind == "date":
                out[name] = _date(value)
            elif kind == "categorical":
                if not isinstance(value, str) or name == "fiscal_period" and value not in FISCAL_PERIODS:
                    return None
                out[name] = value
            else:
                out[name] = _number(value, name in NON_NEGATIVE)
        return out
    except (ValueError, OverflowError, RecursionError):
        return None


def parse_extraction(text: Column | str) -> Column:
    """The validated answer as a struct of the fields; null where the whole object is rejected."""
    kinds = {"date": pa.date32(), "categorical": pa.string()}
    target = pa.struct([(n, kinds.get(k, pa.float64())) for n, k, *_ in FIELDS])

    @F.arrow_udf(EXTRACTION)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([validate(t) for t in column.to_pylist()], target)

    return parse(text)


def canonical(truth: Column) -> Column:
    """A truth struct as JSON text: every key in schema order, whole numbers without a fraction, ', ' and ': ' between."""
    parts = []
    for name, kind, *_ in FIELDS:
        v = truth[name]
        if kind == "categorical":
            shown = F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        elif kind == "date":
            shown = F.concat(F.lit('"'), F.date_format(v, "yyyy-MM-dd"), F.lit('"'))
        else:
            shown = F.when((F.rint(v) == v) & (F.abs(v) < 1e18), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))
        parts.append(F.concat(F.lit(f'"{name}": '), F.coalesce(F.when(v.isNotNull(), shown), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def fingerprint(*parts: Column) -> Column:
    """The sha256 of a prompt's parts."""
    return F.sha2(F.concat_ws("\n", *parts), 256)
