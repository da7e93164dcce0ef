"""Personal data by candidate gradient boosting, in DataFrame functions only.

Exact formats (base) are found by validated patterns. Beside them, high-recall generators propose spans of each kind, which
overlap within a kind too; boosted trees over format and context features score them, and those at or above their kind's calibrated
threshold are added where no base span and no better candidate overlaps. The trees are fitted on the driver, over
candidates of written examples (SAMPLE of them, made from seeded rules, true and false in equal parts; there are no labels of
personal data to learn from), and compiled into one column expression.

Repeated groups in the patterns are possessive, so that long runs of digits or labels are matched in loops, not by recursion;
the places of a text's matches are summed block by block. Generators look at the text with its base spans blanked out, window
by window, so time grows with a text's length and memory hardly.

Defined results: null and empty texts have no spans; very long texts, runs of digits and domains are read whole; repeated rows
each get their row; equal spans count once, and of equally good overlapping candidates the first, then the longest stays; input
columns named like a result give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import fresh, held, restored, with_results

KINDS = ("email", "ip", "card", "phone")
#: Written examples that the trees are fitted and calibrated on, and the precision that thresholds are set for.
SAMPLE, PRECISION = 4000, 0.99

# The four formats. Starts are held to where a leftmost match can start, which keeps the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall patterns of each kind, each tried at every place, so their matches overlap: cards by their number of digits,
#: phones by their number of digit groups.
WIDE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]|\.)[0-9]{1,3}){3}(?![0-9])"],
    "card": [rf"(?<![0-9])[0-9](?:[ ./-]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(13, 20)],
    "phone": [rf"(?<![0-9])[+(]?[0-9]{{1,15}}(?:[ ()./-]{{1,5}}[0-9]{{1,12}}){{{k}}}(?![0-9])" for k in range(15)],
}
_GATE = {"email": r"@|[(\[{]at[)\]}]", "ip": r"[0-9](?:\.|[(\[])", "card": r"[0-9][0-9 ./-]{11}", "phone": r"[0-9][ ().0-9/-]{6}"}
_ANY = "|".join(_GATE.values())
_WORDS = {"email": "mail|contact|write", "ip": "ip|addr|host|server", "card": "card|visa|credit|pay", "phone": "tel|phone|call|mobile|fax"}
_NEAR = 24
#: Matches to a block whose places are summed, and what base spans are blanked with: a letter of no pattern.
_BLOCK, _BLANK = 256, "\u2588"
_SPAN = "struct<start:int,end:int,kind:string,value:string>"
_EMPTY = f"cast(array() as array<{_SPAN}>)"
_CHOICE = f"struct<c:{_SPAN},odds:double>"
_CHOICES = f"cast(array() as array<{_CHOICE}>)"
#: Characters to a window whose candidates are scored together, and those after it that candidates may reach into: an e-mail
#: address has 254 at most, the other candidates fewer.
_WINDOW, _REACH = 1024, 256


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once."""
    return F.transform(F.array(value), of)[0]


def _pairs(found: Column, gaps: Column) -> Column:
    return F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value")))


def _places(pairs: Column, kind: str, first: Column, consuming: bool) -> Column:
    """(start, end, kind, value) of (gap, value) pairs in a row, from a first place on."""

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["gap"]
        b = a + F.length(p["value"])
        one = F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value"))
        return F.struct((b if consuming else a).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, F.struct(first.alias("at"), F.expr(_EMPTY).alias("out")), step, lambda acc: acc["out"])


def matches(text: Column, pattern: str, kind: str) -> Column:
    """The leftmost non-overlapping matches as (start, end, kind, value), in code points. Their places are running sums, block
    by block, as an array that grows one by one is copied each time."""

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["value"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda part, at: _places(part, kind, at, True)))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(_BLOCK)), lambda a: F.slice(p, a + 1, _BLOCK))
    pairs = _pairs(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    return _bound(pairs, lambda p: _bound(blocks(p), joined))


def overlapping(text: Column, pattern: str, kind: str) -> Column:
    """The match at each place of a window that has one, as matches() gives them."""
    t = F.concat(F.lit(" "), text)  # as split gives no empty part before a match at the start
    return _places(_pairs(F.regexp_extract_all(t, F.lit(f"(?=({pattern}))"), F.lit(1)), F.split(t, f"(?={pattern})", -1)), kind, F.lit(-1), False)


def _gated(text: Column, pattern: str, of: Column, empty: str = _EMPTY) -> Column:
    return F.when(text.rlike(pattern), of).otherwise(F.expr(empty))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    """Whether a string of a base format passes the format's check."""
    digits = _digits(value)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": F.length(digits).between(16, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


_BASE_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": BASE["card"], "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """The spans of the exact formats that pass their checks, by kind, then start."""
    passing = lambda kind: lambda s: _passes(kind, s["value"])
    return F.concat(*[F.filter(_gated(text, _BASE_GATE[k], matches(text, BASE[k], k)), passing(k)) for k in KINDS])


def _without(kind: str) -> Callable[[Column], Column]:
    def blank(gap: Column, value: Column) -> Column:
        return F.concat(gap, F.when(value.isNull(), "").when(_passes(kind, value), F.repeat(F.lit(_BLANK), F.length(value))).otherwise(value))

    def of(text: Column) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), F.split(text, BASE[kind], -1)
        return F.when(text.rlike(_BASE_GATE[kind]), F.array_join(F.zip_with(gaps, found, blank), "")).otherwise(text)

    return of


def blanked(text: Column) -> Column:
    """text with the base spans of each kind in turn blanked out, character for character."""
    for kind in KINDS:
        text = _bound(text, _without(kind))
    return text


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def candidates(text: Column) -> Column:
    """The spans that the generators propose; those of a kind overlap too."""
    found = {k: F.concat(*[overlapping(text, p, k) for p in WIDE[k]]) for k in KINDS}
    found["phone"] = F.filter(found["phone"], lambda s: F.length(_digits(s["value"])).between(7, 15))
    return F.concat(*[_gated(text, _GATE[k], found[k]) for k in KINDS])


def _features(text: Column, s: Column) -> list[Column]:
    v = s["value"]
    before = F.lower(F.substr(text, F.greatest(s["start"] - _NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(_NEAR))))
    after = F.substr(text, s["end"] + 1, F.lit(1))
    n = F.length(_digits(v))
    groups = F.split(v, "[^0-9]+")
    flags = [
        *(s["kind"] == k for k in KINDS),
        v.startswith("+"),
        v.contains("@"),
        v.contains("("),
        v.rlike(r"^\(?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{4}$|^\+?[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -]"),
        v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[^0-9]*){4}$"),
        v.rlike(r"^[0-9]{4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}$|^[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][0-9]{2,4}$"),
        F.call_function("luhn_check", _digits(v)),
        v.rlike(r"^[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"),
        v.rlike(r"[.)\]][ ]?[A-Za-z]{2,6}$"),
        v.rlike(r"^[3-6](?:[0-9]{12,18}|[0-9]{3}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{3})?)$") & F.call_function("luhn_check", _digits(v)),
        before.rlike(r"[a-z0-9_=#]$|[0-9][.,:/-]$"),
        after.rlike("[A-Za-z0-9_]"),
        before.rlike(r"[0-9][ ./()-]{1,3}$"),
        before.rlike(r"[+(]$"),
        F.substr(text, s["end"] + 1, F.lit(4)).rlike(r"^[ ./()-]{1,3}[0-9]"),
        v.rlike(r"^[^()]*+(?:\([^()]*+\)[^()]*+)*+$"),
        v.rlike(r"^(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$"),
        v.rlike(r"^(?:\+[0-9]{1,3}|00[0-9]{1,3}|1)[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-]?[0-9]{3,4}$"),
        before.rlike(r"(?:\+[0-9]{1,3}|(?<![0-9./-])00[0-9]{1,3}|(?<![0-9./-])1)[ .-]?\(?$"),
        *(before.rlike(w) for w in _WORDS.values()),
    ]
    return [F.length(v).cast("double"), n.cast("double"), F.size(groups).cast("double"), F.array_max(F.transform(groups, F.length)).cast("double"), *(f.cast("double") for f in flags)]


def proposed(text: Column, model: tuple[float, list[boosting.Node]], cuts: dict[str, float]) -> Column:
    """(c, odds) of the candidates at or above their kind's threshold. Window by window, so that neither the candidates of a long
    text nor their features are ever held together."""
    least = lambda c: functools.reduce(lambda e, k: F.when(c["kind"] == k, F.lit(cuts[k])).otherwise(e), KINDS, F.lit(99.0))

    def within(w: Column) -> Column:
        inside = lambda c: (c["start"] >= w["skip"]) & (c["start"] < w["end"]) & ~(w["goes_on"] & (c["end"] == F.length(w["text"])))
        points = F.transform(F.filter(candidates(w["text"]), inside), lambda c: F.struct(c.alias("c"), F.array(*_features(w["text"], c)).alias("f")))
        odds = F.transform(points, lambda p: F.struct(p["c"].alias("c"), boosting.compiled(model, lambda i: p["f"][i]).alias("odds")))
        moved = lambda c: F.struct((c["start"] + w["at"]).alias("start"), (c["end"] + w["at"]).alias("end"), c["kind"].alias("kind"), c["value"].alias("value"))
        return F.transform(F.filter(odds, lambda p: p["odds"] >= least(p["c"])), lambda p: F.struct(moved(p["c"]).alias("c"), p["odds"].alias("odds")).cast(_CHOICE))

    def windows(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            before = F.coalesce(F.right(F.get(parts, i - 1), F.lit(_NEAR)), F.lit(""))
            after = F.coalesce(F.left(F.get(parts, i + 1), F.lit(_REACH)), F.lit(""))
            skip = F.length(before)
            w = F.struct(F.concat(before, part, after).alias("text"), skip.alias("skip"), (skip + F.length(part)).alias("end"), (i * _WINDOW - skip).cast("int").alias("at"), (F.length(after) == _REACH).alias("goes_on"))
            return _bound(w, lambda w: _gated(w["text"], _ANY, within(w), _CHOICES))

        return F.flatten(F.transform(parts, one))

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_WINDOW}}}"), F.lit(0)), windows)


def _written(rng: random.Random) -> tuple[str, str, str, int, str, str]:
    """(text before, span, text after, truth, true number that follows it or nothing, kind) of one example."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeiounrstlhd") for _ in range(rng.randint(2, 8)))
    kind, true = rng.choice(KINDS), rng.random() < 0.5
    before, after = f"{word()} {word()} ", f" {word()} {word()}"
    hint = {"email": "mail: ", "ip": "ip: ", "card": "card: ", "phone": "tel: "}[kind]
    if rng.random() < (0.5 if true else 0.05):
        before += hint
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("{at}", ".")])
        span = f"{word()}.{digits(2)}{at}{word()}{digits(1)}{dot}{rng.choice(['com', 'org', 'net', 'example', 'de', 'fr'])}"
        if not true:
            span = f"{word()}{at}{digits(3)}{dot}{digits(2)}" if rng.random() < 0.5 else f"{word()}{at}{word()}{dot}{digits(5)}"
    elif kind == "ip":
        sep = rng.choice([".", "[.]", "(dot)", "[dot]"])
        span = sep.join(str(rng.randint(0, 255)) for _ in range(4))
        if not true:
            span = sep.join(str(rng.randint(256, 999)) for _ in range(4))
    elif kind == "card":
        n, sep = rng.choice([13, 15, 16, 16, 16, 19]), rng.choice(["", " ", "-", "."])
        total = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        valid = lambda d: (total(d[:-1]) + int(d[-1])) % 10 == 0
        card = lambda right: (d := "4" + digits(n - 2)) + str((-total(d) + (0 if right else rng.randint(1, 9))) % 10)
        split = lambda d: sep.join(d[i : i + 4] for i in range(0, n, 4))
        body = card(true)
        while not true and n == 19 and (valid(body[:16]) or valid(body[4:])):  # a false card has no true one in it
            body = card(true)
        span = split(body)
    else:
        a, b, c = digits(3), digits(3), digits(4)
        span = rng.choice([f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"00{digits(2)} {a} {b}{c}"])
        if not true:
            span = rng.choice([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", digits(9), digits(12), f"{digits(4)}.{digits(6)}", f"{digits(1)}-{digits(1)}-{digits(2)}-{digits(3)}"])
    if not true and rng.random() < 0.3:
        before, after = before.rstrip() + rng.choice(["x", "b7", "="]), rng.choice(["e", "f0", "_"]) + after
    second = ""
    if true and kind in ("phone", "card") and rng.random() < 0.5:  # other digits beside it, with which it must not run together
        other = lambda: rng.choice([f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", rng.choice("23456789"), *(rng.choice("23456789") + digits(n) for n in (1, 2, 3))])
        if rng.random() < 0.6:
            before += other() + " "
        if kind == "phone" and rng.random() < 0.4:
            second = f"{digits(3)}-{digits(3)}-{digits(4)}" if span[0] not in "+(" else f"({digits(3)}) {digits(3)}-{digits(4)}"
            after = f" {second}{after}"
        elif kind == "card" and rng.random() < 0.4:
            second = span if rng.random() < 0.5 else split(card(True))
            after = f" {second}{after}"
        elif rng.random() < 0.5:
            after = f" {other()}{after}"
    return before, span, after, int(true), second, kind


@functools.cache
def _model(session: int) -> tuple[tuple[float, list[boosting.Node]], dict[str, float]]:
    """(trees, log-odds threshold by kind), fitted on two thirds of the written examples and calibrated on the rest."""
    spark = SparkSession.active()
    rng = random.Random(session)
    rows = [(i, *x) for i, x in enumerate(_written(rng) for _ in range(SAMPLE))]
    df = spark.createDataFrame(rows, "id int, a string, s string, b string, y int, z string, kind string").coalesce(1)
    df = df.withColumn("text", F.concat("a", "s", "b")).withColumn("c", candidates(F.col("text")))
    scored = df.select("id", "y", "kind", F.length("z").alias("z"), F.length("a").alias("lo"), (F.length("a") + F.length("s")).alias("hi"), F.transform("c", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"), F.array(*_features(F.col("text"), s)).alias("f"))).alias("c"))
    data = [(r.id, c.k, c.f, int(r.y and c.k == r.kind and (c.a, c.b) in ((r.lo, r.hi), (r.hi + 1, r.hi + 1 + r.z))), c.a, c.b) for r in scored.collect() for c in r.c]
    x, y = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    kind, fold = np.array([d[1] for d in data]), np.array([d[0] % 3 for d in data])
    model = boosting.fit(x[fold < 2], y[fold < 2].astype(float), trees=50)
    odds, cuts = boosting.log_odds(model, x), {}
    best = np.zeros(len(data), dtype=bool)  # those that no better candidate of their example overlaps
    taken: dict[int, list[tuple[int, int]]] = {}
    for i in np.argsort(-odds, kind="stable").tolist():
        n, _, _, _, a, b = data[i]
        if all(a >= d or b <= c for c, d in taken.setdefault(n, [])):
            taken[n].append((a, b))
            best[i] = True
    for k in KINDS:
        held = (kind == k) & (fold == 2) & best
        order = np.argsort(-odds[held], kind="stable")
        good = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1) >= PRECISION
        cuts[k] = max(float(odds[held][order][np.flatnonzero(good)[-1]]), 0.0) if good.any() else 99.0
    return model, cuts


def find_personal_data(docs: DataFrame, text: str = "text", seed: int = 10) -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), n_spans and personal_data,
    the spans as an array."""
    model, cuts = _model(seed)
    tmp = {n: fresh(docs, f"_{n}") for n in ("text", "base", "blank", "scored", "all")}
    t, base, scored = (F.col(tmp[n]) for n in ("text", "base", "scored"))
    out = docs.withColumn(tmp["text"], F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(tmp["base"], base_spans(t)).withColumn(tmp["blank"], F.when(F.size(base) > 0, blanked(t)).otherwise(t))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    chosen = _gated(F.col(tmp["blank"]), _ANY, proposed(F.col(tmp["blank"]), model, cuts), _CHOICES)
    out = out.withColumn(tmp["scored"], F.array_sort(F.filter(chosen, lambda p: ~F.exists(base, lambda b: overlap(b, p["c"])))))
    kind = out.schema[tmp["scored"]].dataType
    rank = lambda p: F.struct(p["odds"], -p["c"]["start"], p["c"]["end"], p["c"]["kind"])

    def step(acc: Column, p: Column) -> Column:  # by start: the better of two that overlap stays
        none, last = F.lit(None).cast(kind.elementType), acc["last"]
        apart = last.isNull() | ~overlap(last["c"], p["c"])
        better = F.when(apart | (rank(p) > rank(last)), p).otherwise(last)
        kept = F.when(apart & last.isNotNull(), F.concat(acc["out"], F.array(last["c"]))).otherwise(acc["out"])
        return F.struct(kept.alias("out"), F.coalesce(better, none).alias("last"))

    start = F.struct(F.expr(_EMPTY).alias("out"), F.lit(None).cast(kind.elementType).alias("last"))
    won = F.aggregate(scored, start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]["c"]))))
    added = F.coalesce(won, F.expr(_EMPTY))
    ordered = lambda spans: F.concat(*[F.array_sort(_of_kind(spans, k)) for k in KINDS])
    out = out.withColumn(tmp["all"], ordered(F.concat(base, added)))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    result = F.struct(*count, F.sha2(said(base), 256).alias("base_sha256"), said(F.col(tmp["all"])).alias("spans"), F.size(tmp["all"]).cast("long").alias("n_spans"), F.col(tmp["all"]).alias("personal_data"))
    return with_results(out, result, [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "personal_data"]).drop(*tmp.values())


def redact_personal_data(docs: DataFrame, text: str = "text", seed: int = 10) -> DataFrame:
    """docs with every found span of the text column replaced by its kind in angle brackets; columns as they were."""
    found = find_personal_data(held(docs, _text=F.col(text)), "_text", seed)
    t, spans = F.col("_text"), F.array_sort(F.col("personal_data"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    return restored(found, docs.columns, **{text: F.when(F.size("personal_data") > 0, clean).otherwise(t)})
