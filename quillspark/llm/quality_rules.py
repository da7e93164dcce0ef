"""Quality rules: counts of symbols, repeated lines and repeated word windows, and bands of character n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of order ORDER over SYMBOLS symbols. No two code points look
alike to it: printable ASCII, line ends, tabs and the accented letters of OWN are one symbol each, and every other code point is
spelled by two to four symbols, its own number. Spark counts the n-grams of all documents: tasks send at most one row per distinct
n-gram. There are at most SYMBOLS ** ORDER of them (268 million; some 94,000 in sf0.1), which bounds the model whatever
the corpus. It is kept, broadcast and searched as arrays of sorted hashes with log probabilities and back-off weights.

Each language has its own lower and upper perplexity band, a robust interval around its median; the fewer documents it has,
the more the interval's width is that of all languages.

Defined results: null and empty texts have no words and fail the base rules; very long texts are read whole; null counts as a
language of its own; copies count once in model and bands, and repeated rows each get their row; input columns named like a
result give way to it; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, fresh, held, lean, mix64, resident, restored, with_results, written

ORDER, SYMBOLS = 4, 128
END, START, BLANK, LETTERS, LEAD = 0, 1, 2, 3, 117
#: Characters with a symbol of their own, in the symbols' order from BLANK on: blank, letters, capitals, digits, marks, others.
OWN = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\t\räöüßéèêàçáíóúñâîô"
#: Bytes worked on at a time; the arrays over them take some 100 bytes for each. Distinct n-grams a task holds at a time.
RUN, HELD = 1 << 18, 1 << 20
#: Words to a repeated window.
WINDOW = 8
#: Robust standard deviations from the median of log perplexity that are still kept, below and above. A text of n symbols
#: has them widened by sqrt(1 + SHORT / n), as short texts scatter more.
BELOW, ABOVE, SHORT = 5.0, 4.5, 400
#: Degrees of freedom of the spread within all languages beside a language's own, and the bands up to which they are broadcast.
PRIOR, MOST_BANDS = 30, 100_000
#: Column with the hash of a text, by which copies are told, and the copied hashes up to which they are broadcast.
CONTENT, COPIED = "_content", 1_000_000

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "log10_prob"]
_STATS = pa.struct([(n, pa.float64() if n == "log10_prob" else pa.int64()) for n in _FIELDS])
_STATS_DDL = "struct<" + ",".join(f"{n}:{'double' if n == 'log10_prob' else 'bigint'}" for n in _FIELDS) + ">"
_SPACE, _SYMBOL = b" \t\n\v\f\r", b"#*$%&|<>"


def _letters() -> np.ndarray:
    """Symbol of each code point below 0x180; LEAD for those that are spelled."""
    out = np.full(0x180, LEAD, dtype=np.int32)
    out[[ord(c) for c in OWN]] = BLANK + np.arange(len(OWN))
    return out


_LETTER = _letters()
#: (first code point, leading symbol, further symbols): 9 leads for 1,152 code points, then 16,384, then the rest.
_SPELLED = [(0, LEAD, 1), (9 * SYMBOLS, 126, 2), (9 * SYMBOLS + SYMBOLS**2, 127, 3)]


def symbols_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in a row, number of symbols of each code point)."""
    out = np.where(points < 0x180, _LETTER[np.minimum(points, 0x17F)], LEAD)
    size = np.ones(len(points), dtype=np.int64)
    spelled = np.flatnonzero(out == LEAD)
    if not len(spelled):
        return out, size
    own = points[spelled].astype(np.int64)
    kind = np.searchsorted([first for first, _, _ in _SPELLED], own, side="right") - 1
    size[spelled] = 2 + kind
    at = np.cumsum(size) - size
    whole = np.zeros(int(size.sum()), dtype=np.int32)
    whole[at] = out
    for k, (first, lead, more) in enumerate(_SPELLED):
        these = kind == k
        place, number = at[spelled[these]], own[these] - first
        whole[place] = lead + (number // SYMBOLS if k == 0 else 0)
        for j in range(more):
            whole[place + 1 + j] = number // SYMBOLS ** (more - 1 - j) % SYMBOLS
    return whole, size


def gram_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram numbers of all texts in a row, one for each symbol and one for each end, and where each text starts."""
    points = np.frombuffer("".join([t or "" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols, size = symbols_of(points)
    until = np.concatenate([[0], np.cumsum(size)])
    chars = np.cumsum([0, *(len(t or "") for t in texts)])
    n = np.diff(until[chars])
    begin = np.cumsum(n + ORDER) - (n + ORDER)
    row = np.full(int((n + ORDER).sum()), START, dtype=np.int32)
    body = np.arange(len(symbols)) + np.repeat(begin + ORDER - 1 - (np.cumsum(n) - n), n)
    row[body] = symbols
    row[begin + n + ORDER - 1] = END
    keys = row.copy()
    for j in range(1, ORDER):
        keys[j:] += row[:-j] * np.int32(SYMBOLS**j)
    inside = np.ones(len(row), dtype=bool)
    for j in range(ORDER - 1):
        inside[begin + j] = False
    return keys[inside], np.concatenate([[0], np.cumsum(n + 1)])


class Hashed:
    """Values by integer key: sorted hashes of the keys, and where the hashes of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix64(keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        heads = self.hashes >> self.shift
        self.begins = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.begins).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't held."""
        out = np.full(len(keys), -1, dtype=np.int32)
        hashes = mix64(keys.astype(np.uint64) + np.uint64(1))
        head = (hashes >> self.shift).astype(np.int64)
        at, end = self.begins[head], self.begins[head + 1]
        left = np.flatnonzero(at < end)
        for step in range(self.deepest):
            here = at[left] + np.int32(step)
            same = self.hashes[here] == hashes[left]
            out[left[same]] = here[same]
            left = left[~same]
            left = left[at[left] + step + 1 < end[left]]
        return out


@dataclass
class KneserNey:
    """log10 probabilities of grams by order (index 0: unigrams), and log10 back-off weights by their contexts."""

    grams: list[Hashed]
    contexts: list[Hashed]

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """The modified Kneser-Ney model of the highest-order counts. Lower orders count distinct left extensions, but where
        a gram begins at a text's start, which nothing extends, its occurrences."""
        order = np.argsort(keys)
        tables = [(keys[order].astype(np.int64), counts[order].astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            longer, c = tables[0]
            shorter, of = np.unique(longer % SYMBOLS**n, return_inverse=True)
            left = np.bincount(of, minlength=len(shorter)).astype(np.float64)
            first = shorter // SYMBOLS ** (n - 1) == START
            tables.insert(0, (shorter, np.where(first, np.bincount(of, weights=c, minlength=len(shorter)), left)))
        out = cls([], [])
        below, known = np.full(1, 1.0 / (SYMBOLS - 1)), np.zeros(1, np.int64)
        for n, (grams, c) in enumerate(tables, start=1):
            n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            cuts = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            cuts = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(cuts, start=1)]
            cut = np.select([c == 1, c == 2], cuts[:2], cuts[2])
            contexts, of = np.unique(grams // SYMBOLS, return_inverse=True)
            total = np.bincount(of, weights=c)
            weight = np.bincount(of, weights=cut) / total if len(of) else total
            lower = below[0] if n == 1 else below[np.searchsorted(known, grams % SYMBOLS ** (n - 1))]
            p = (c - cut) / total[of] + weight[of] * lower
            out.grams.append(Hashed(grams, np.log10(p)))
            out.contexts.append(Hashed(contexts, np.log10(weight)))
            below, known = p, grams
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram after those before it."""
        out, left = np.zeros(len(keys)), None
        for n in range(ORDER, 0, -1):
            own = keys if left is None else keys[left] % SYMBOLS**n
            at = self.grams[n - 1].find(own)
            seen = at >= 0
            if left is None:
                out[seen], left = self.grams[n - 1].values[at[seen]], np.arange(len(keys))
            else:
                out[left[seen]] += self.grams[n - 1].values[at[seen]]
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            at = self.contexts[n - 1].find(own // SYMBOLS)
            known = at >= 0
            out[left[known]] += self.contexts[n - 1].values[at[known]]
        out[left] -= np.log10(SYMBOLS - 1)
        return out


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct texts of docs as column text, null left out. Only texts whose hash occurs again are compared, so the
    others aren't shuffled; with more than COPIED such hashes all texts are."""
    given = docs.select(F.col(text).alias("text")).where("text is not null").withColumn(CONTENT, F.xxhash64("text"))
    copied = written(given.groupBy(CONTENT).agg(F.count("*").alias("n")).where("n > 1").select(CONTENT), "quality-copies")
    if copied.count() > COPIED:
        return given.select("text").distinct()
    once, again = (given.join(F.broadcast(copied), CONTENT, how).select("text") for how in ("left_anti", "left_semi"))
    return once.union(again.distinct())


def fit_language_model(docs: DataFrame, text: str = "text") -> KneserNey:
    """The model of the distinct texts of docs: copies count once, or a copied text would be far likelier than all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            grams, of = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return grams, np.bincount(of, weights=np.concatenate([n for _, n in kept])).astype(np.int64)

        for batch in batches:
            for _, run in by_bytes(batch.column(0), RUN):
                kept.append(np.unique(gram_keys(run)[0], return_counts=True))
                if sum(len(k) for k, _ in kept[1:]) > HELD:
                    kept = [summed()]
        if kept:
            grams, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(n)], names=["gram", "n"])

    bounded_batches(docs.sparkSession)
    found = distinct_texts(docs, text).mapInArrow(lean(count), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return KneserNey.of(found.column("gram").to_numpy(), found.column("n").to_numpy())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the list, the first included."""
    first: dict[tuple[bytes, ...], int] = {}
    edges = [0] * (len(words) + 1)
    for i, w in enumerate(zip(*(words[j:] for j in range(window)), strict=False)):
        if (k := first.setdefault(w, i)) != i:
            for at in {i, k}:
                edges[at] += 1
                edges[at + window] -= 1
    depth = n = 0
    for e in edges[:-1]:
        depth += e
        n += depth > 0
    return n


def _base(texts: list[str | None]) -> dict[str, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    words = [b.split() for b in raw]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    lines = [[x for x in b.split(b"\n") if x.strip(_SPACE)] for b in raw]
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t or "") - len(b) + len(b.translate(None, _SPACE)) for t, b in zip(texts, raw, strict=True)], dtype=np.int64),
        "n_symbols": np.array([len(b) - len(b.translate(None, _SYMBOL)) for b in raw], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.zeros(len(raw), dtype=np.int64),
    }
    total = int(n_words.sum())
    if total >= WINDOW:  # window hashes only tell which texts need an exact look
        h = mix64(np.fromiter((hash(w) for x in words for w in x), dtype=np.int64, count=total))
        rolled = np.zeros(total - WINDOW + 1, dtype=np.uint64)
        for j, f in enumerate(mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)):
            rolled += h[j : total - WINDOW + 1 + j] * f
        doc = np.repeat(np.arange(len(raw)), n_words)
        inside = doc[: total - WINDOW + 1] == doc[WINDOW - 1 :]
        of, rolled = doc[: total - WINDOW + 1][inside], rolled[inside] + mix64(doc[: total - WINDOW + 1][inside])
        order = np.argsort(rolled)
        twice = np.flatnonzero(np.diff(rolled[order]) == 0)
        for d in np.unique(of[order[twice]]).tolist():
            out["n_repeat_words"][d] = repeated_words(words[d])
    return out


def statistics(text: Column | str, model: Any) -> Column:
    """The base counts of each text, its n-gram count (code points and the end) and its log10 probability by the broadcast model."""
    name = uuid.uuid4().hex

    @F.arrow_udf(_STATS_DDL)
    @lean
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = resident(name, lambda: model.value)
        for column in batches:
            parts = []
            for _, texts in by_bytes(column, RUN):
                keys, starts = gram_keys(texts)
                found = _base(texts) | {"n_grams": np.diff(starts), "log10_prob": np.add.reduceat(own.log10(keys), starts[:-1])}
                parts.append(pa.StructArray.from_arrays([pa.array(found[n]) for n in _FIELDS], fields=list(_STATS)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _STATS)

    return count(text)


def with_statistics(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """docs plus the base counts, base_failed, n_grams and log_perplexity (log10, to a symbol)."""
    out = with_results(docs, statistics(F.col(text), docs.sparkSession.sparkContext.broadcast(model)), _FIELDS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("log_perplexity", -F.col("log10_prob") / F.col("n_grams")).drop("log10_prob")


def fit_bands(scored: DataFrame, lang: str = "lang", content: str = CONTENT) -> DataFrame:
    """_of, middle and spread of log_perplexity by language (null is one), over the distinct contents that pass the base rules,
    so that copies count once. content is the column that tells contents apart.

    Quartiles are exact, of values to four places. The middle is the language's own median however few its documents are. Its variance counts as its n - 1 degrees beside
    PRIOR of the variance within all languages, and the spread has the median's own error added, so few documents widen it."""
    own = scored.where(~F.col("base_failed")).select(F.col(lang).alias("_of"), content, "log_perplexity").distinct()
    counts = own.groupBy("_of", F.round("log_perplexity", 4).alias("x")).agg(F.count("*").alias("k"))  # some 50,000 values at most
    found = counts.groupBy("_of").agg(F.sum("k").alias("n"), F.expr("percentile(x, array(0.25D, 0.5D, 0.75D), k)").alias("q"))
    found = written(found.select("_of", (F.col("n") - 1).alias("free"), F.col("q")[1].alias("middle"), F.pow((F.col("q")[2] - F.col("q")[0]) / 1.349, 2).alias("var")), "quality-bands")
    within = found.agg(F.coalesce(F.try_divide(F.sum(F.col("free") * F.col("var")), F.sum("free")), F.lit(0.0)).alias("within"))
    var = (F.col("free") * F.col("var") + PRIOR * F.col("within")) / (F.col("free") + PRIOR)
    spread = F.greatest(F.sqrt(var), F.lit(1e-3)) * F.sqrt(1 + math.pi / 2 / (F.col("free") + 1))
    return found.crossJoin(F.broadcast(within)).select("_of", "middle", spread.alias("spread"))


def with_kept(scored: DataFrame, bands: DataFrame, lang: str = "lang") -> DataFrame:
    """scored plus kept: whether a document passes the base rules and log_perplexity lies in the band of its language."""
    band, of = fresh(scored, "_band"), fresh(scored, "_of")
    bands = bands.select(F.col("_of").alias(of), F.struct("middle", "spread").alias(band))
    if bands.count() <= MOST_BANDS:
        bands = F.broadcast(bands)
    out = scored.join(bands, F.col(lang).eqNullSafe(F.col(of)), "left")
    middle, reach = F.col(band)["middle"], F.col(band)["spread"] * F.sqrt(1 + SHORT / F.col("n_grams"))
    inside = F.col("log_perplexity").between(middle - BELOW * reach, middle + ABOVE * reach)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(band, of)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per document: key, lang, the base counts, base_failed, log_perplexity and kept."""
    model = fit_language_model(docs, text)
    scored = with_statistics(docs.select(key, lang, text).withColumn(CONTENT, F.xxhash64(text)), model, text)
    scored = written(scored.drop(text), "quality-rules")
    return with_kept(scored, fit_bands(scored, lang), lang).drop(CONTENT)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rejected ones, columns as they were. The scored rows are written once, for the bands and the filter."""
    model = fit_language_model(docs, text)
    given = held(docs, _lang=F.col(lang), _text=F.col(text), **{CONTENT: F.xxhash64(text)})
    scored = written(with_statistics(given, model, "_text").drop("_text"), "quality-scored")
    return restored(with_kept(scored, fit_bands(scored, "_lang"), "_lang").where("kept"), docs.columns)
