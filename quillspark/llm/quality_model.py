"""Quality classifier by a sparse rule ensemble over text statistics.

The statistics are built-in column expressions over whole texts. Boosted trees over a bounded sample of labelled training
rows give conjunctive rules, one for each path from a root; a lasso-weighted logistic model picks and weighs rules and
linear terms, and what it keeps is compiled into one column expression, so scoring is a plain projection.

Rows whose crc32(id as text) mod HELD is 0 are held out and never learned from; ids, labels, languages and sources are
no inputs of a score.

Defined results: null and empty texts have zero statistics and get that score; very long texts are read whole; a null id is not
held out; repeated rows each get their row, and of several texts of one labelled id one is learned from; with fewer than LEAST_LABELS labels of a kind every score is the training rate (0.5 without labels); an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import crc_bucket, fresh, with_results

#: Labelled rows that the model is fitted on at most: those of least hash.
SAMPLE = 12_000
HELD, THRESHOLD = 5, 0.3
#: Labels of each kind that rules need.
LEAST_LABELS = 5
TREES, DEPTH, PENALTIES = 40, 3, (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)

STATISTICS = ["log_chars", "log_words", "word_length", "distinct_share", "upper_share", "digit_share", "symbol_share", "mark_share", "stop_share", "line_words", "repeat_lines", "longest_word", "adjacent_share"]


def statistics(text: Column) -> list[Column]:
    """The statistics of a text, in the order of STATISTICS, as doubles."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    chars, n, n_lines = F.length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    matching = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return [
        F.log1p(chars),
        F.log1p(n),
        share(chars, n),
        share(F.size(F.array_distinct(words)), n),
        share(matching("[^A-ZÀ-ÖØ-Þ]+"), chars),
        share(matching("[^0-9]+"), chars),
        share(matching("[^#*$%&|<>]+"), chars),
        share(matching("[^!?]+"), chars),
        share(matching("[^.,;:]+"), chars),
        share(n, n_lines),
        share(n_lines - F.size(F.array_distinct(lines)), n_lines),
        F.coalesce(F.array_max(F.transform(words, F.length)).cast("double"), F.lit(0.0)),
        share(F.regexp_count(t, F.lit(r"(?<![^ \n])([^ \n]++)(?= \1(?![^ \n]))")), n),
    ]


@dataclass
class RuleModel:
    """A bias, weights of rules (conjunctions of (statistic, is above, cut)), and of clipped statistics (low, high, weight)."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]
    linear: list[tuple[int, float, float, float]]

    def column(self, stats: Column) -> Column:
        """The probability of quality as a column expression over an array of the statistics."""
        odds = F.lit(self.bias)
        for terms, weight in self.rules:
            holds = F.lit(True)
            for f, above, cut in terms:
                holds = holds & (stats[f] > cut if above else stats[f] <= cut)
            odds = odds + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        for f, low, high, weight in self.linear:
            odds = odds + F.lit(weight) * F.least(F.greatest(stats[f], F.lit(low)), F.lit(high))
        return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def paths(tree: boosting.Node) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conjunction of every path from the root to another node."""
    out, work = [], [(tree, ())]
    while work:
        node, terms = work.pop()
        if terms:
            out.append(tuple(sorted(terms)))
        if node.low is not None and node.high is not None:
            work += [(node.low, (*terms, (node.feature, False, node.cut))), (node.high, (*terms, (node.feature, True, node.cut)))]
    return out


def holds(terms: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in terms:
        out &= x[:, f] > cut if above else x[:, f] <= cut
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 300) -> np.ndarray:
    """Weights (the last a free bias) of an l1-penalised logistic model, by accelerated proximal gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    v = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(20):  # largest curvature by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / len(x) + 1e-6)
    w = np.zeros(x.shape[1], dtype=x.dtype) if start is None else start.astype(x.dtype)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - step * (x.T @ (p - y) / len(x))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 2) -> RuleModel:
    """The rule ensemble of labelled statistics; the penalty is the largest within 1 % of the best validation loss."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_LABELS:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(rate / (1 - rate))), [], [])
    rng = np.random.default_rng(seed)
    found: dict[tuple, None] = {}
    for _ in range(4):
        part = rng.random(len(y)) < 0.5
        for tree in boosting.fit(x[part], y[part], TREES // 4, DEPTH)[1] if part.sum() >= 20 else []:
            found |= dict.fromkeys(paths(tree))
    rules = [r for r in found if 0.002 <= holds(r, x).mean() <= 0.998]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.maximum(np.clip(x, low, high).std(axis=0), 1e-9)
    center = np.clip(x, low, high).mean(axis=0)
    columns = [holds(r, x).astype(np.float32) for r in rules]
    matrix = np.column_stack([*columns, *(0.4 * (np.clip(x, low, high) - center) / spread).T]).astype(np.float32)
    check = rng.random(len(y)) < 0.25
    best: list[tuple[float, float]] = []
    w = None
    for penalty in PENALTIES if check.any() and (~check).any() else PENALTIES[-1:]:
        w = lasso_logistic(matrix[~check], y[~check], penalty, w)
        odds = matrix[check] @ w[:-1] + w[-1]
        best.append((float(np.mean(np.logaddexp(0, odds) - y[check] * odds)), penalty))
    least = min(best)[0]
    w = lasso_logistic(matrix, y, max(p for loss, p in best if loss <= 1.01 * least)).astype(np.float64)
    slope = 0.4 * w[len(rules) : -1] / spread
    linear = [(i, float(low[i]), float(high[i]), float(s)) for i, s in enumerate(slope) if abs(s) > 1e-9]
    return RuleModel(float(w[-1] - (slope * center).sum()), [(r, float(v)) for r, v in zip(rules, w[: len(rules)], strict=True) if abs(v) > 1e-6], linear)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, held: int = HELD) -> RuleModel:
    """The model of at most sample labelled training rows of docs."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).where(crc_bucket(F.col("key"), held) != 0)
    chosen = rows.orderBy(F.xxhash64("key"), "key", "y").limit(sample)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "y", *[s.alias(n) for s, n in zip(statistics(F.col("text")), STATISTICS, strict=True)])
    table = found.groupBy("key").agg(F.min(F.struct("y", *STATISTICS)).alias("r")).select("r.*").toArrow()  # a row per label
    x = np.column_stack([table.column(n).to_numpy() for n in STATISTICS]) if len(table) else np.zeros((0, len(STATISTICS)))
    y = table.column("y").to_numpy() if len(table) else np.zeros(0)
    order = np.lexsort((*x.T[::-1], y))  # the same whatever order rows come in
    return fit_rules(x[order], y[order])


def score(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text", held: int = HELD, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus held_out, score (0 to 1, higher: quality likelier) and predicted (1 from threshold)."""
    tmp = fresh(docs, "_stats")
    out = docs.withColumn(tmp, F.array(*statistics(F.col(text))))
    p = model.column(F.col(tmp))
    held_out = F.coalesce(crc_bucket(F.col(key), held) == 0, F.lit(False))
    result = F.transform(F.array(p), lambda s: F.struct(held_out.alias("held_out"), s.alias("score"), F.when(s >= threshold, 1).otherwise(0).cast("int").alias("predicted")))[0]
    return with_results(out, result, ["held_out", "score", "predicted"]).drop(tmp)
