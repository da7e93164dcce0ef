"""Resampled intervals beside draws made one at a time, on both ways that they are made."""

from __future__ import annotations

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import draws, statistics
from quillspark.operators import evaluation as ev


def pick(seed: str, r: int, i: int) -> int:
    return int(hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("seed", ["x", "accuracy", "gap-left", "é", "s" * 52, "s" * 60])
def test_hashes_are_those_of_hashlib(seed):
    for resamples, most in ((np.arange(8, 13), 150), (np.array([0]), 1), (np.arange(95, 1005, 7), 12), (np.array([9999]), 11)):
        seen = []
        for some, found in draws.hashes(seed, resamples, most):
            seen += some.tolist()
            assert found.tolist() == [[pick(seed, r, i) for i in range(most)] for r in some.tolist()]
        assert seen == resamples.tolist()


def test_hashes_of_several_blocks():
    (_, found), *rest = draws.hashes("x", np.array([12]), 100_005)
    assert not rest and all(found[0, i] == pick("x", 12, i) for i in [*range(0, 100_005, 997), 9, 10, 9_999, 10_000, 99_999, 100_000, 100_004])


def groups() -> dict[tuple, list]:
    """Values in the order of their keys: sizes that occur once and twice, nulls, one value, only nulls."""
    rng = np.random.default_rng(3)
    some = lambda n: [None if x < 0.1 else round(float(x), 2) for x in rng.random(n)]
    return {("a", 1): some(40), ("a", 2): some(7), ("b", 1): some(40), ("b", 2): [0.5], ("c", 1): [None, None], ("c", 2): [3.0] * 9}


def frame(spark):
    rows = [(*by, k, v) for by, of in groups().items() for k, v in enumerate(of)]
    return spark.createDataFrame(rows[::-1], "g string, h int, k int, v double")


def expected(of: list, resamples: int, seed: str, statistic) -> tuple:
    values = [statistic([of[pick(seed, r, i) % len(of)] for i in range(len(of))]) for r in range(resamples)]
    values = [v for v in values if v is not None]
    return (statistic(of), *(np.percentile(values, [2.5, 97.5]) if values else (None, None)))


def mean(of: list) -> float | None:
    known = [v for v in of if v is not None]
    return sum(known) / len(known) if known else None


def rank(p: float):
    def of(values: list) -> float | None:
        known = sorted(v for v in values if v is not None)
        return known[max(1, math.ceil(p / 100 * len(known))) - 1] if known else None

    return of


@pytest.mark.parametrize("held", [statistics.HELD, 0])
def test_means_equal_single_draws(spark, monkeypatch, held):
    monkeypatch.setattr(statistics, "HELD", held)
    monkeypatch.setattr(statistics, "DRAWS", 1000)
    got = {(r.g, r.h): r for r in statistics.portable_bootstrap(frame(spark), ["g", "h"], "k", "v", 120, "s").collect()}
    assert got.keys() == groups().keys()
    for by, of in groups().items():
        assert got[by].n == len(of) and (got[by].point, got[by].low, got[by].high) == pytest.approx(expected(of, 120, "s", mean))


@pytest.mark.parametrize("held", [statistics.HELD, 0])
def test_percentiles_equal_single_draws(spark, monkeypatch, held):
    monkeypatch.setattr(statistics, "HELD", held)
    shares = {"p50": 50, "p99": 99, "p1": 1}
    found = statistics.portable_quantiles(frame(spark), ["g", "h"], "k", "v", shares, 120, "s").collect()
    assert len(found) == len(groups()) * len(shares)
    for r in found:
        of = groups()[(r.g, r.h)]
        assert r.n == len(of) and (r.point, r.low, r.high) == pytest.approx(expected(of, 120, "s", rank(shares[r.statistic])))


def test_an_unpaired_interval_equals_single_draws(spark):
    rows = frame(spark).where("g = 'a'")
    got = statistics.unpaired_interval(rows.where("h = 1"), rows.where("h = 2"), ["g"], "k", "v", 120, "s").first()
    left, right = groups()[("a", 1)], groups()[("a", 2)]
    sides = [[mean([of[pick(f"s-{name}", r, i) % len(of)] for i in range(len(of))]) for r in range(120)] for name, of in (("left", left), ("right", right))]
    gaps = [x - y for x, y in zip(*sides, strict=True) if x is not None and y is not None]
    assert (got.n, got.point) == (47, pytest.approx(mean(left) - mean(right)))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])))


def test_an_unpaired_interval_of_a_thousand_items_takes_seconds(spark):
    rows = spark.range(1000).select(F.lit("a").alias("g"), "id", (F.col("id") % 7).alias("v"))
    assert seconds(lambda: statistics.unpaired_interval(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["g"], "id", "v", 10_000, "s").collect()) < 20


def answers(spark, n: int):
    """(student, teacher) of n items with two fields each."""
    rows = spark.range(n).select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("field"), (F.col("id") % 2).cast("string").alias("predicted"))
    return rows.withColumn("correct", F.col("id") % 3 > 0), rows.withColumn("correct", (F.col("id") % 4 > 0) | (F.col("field") == "y"))


def test_an_inherited_share_equals_single_draws(spark):
    got = ev.inherited_interval(*answers(spark, 50), "id", ["id", "field"], 120, "s").first()
    wrong, both = [i % 4 == 0 for i in range(50)], [i % 12 == 0 for i in range(50)]
    drawn = [[pick("s", r, i) % 50 for i in range(50)] for r in range(120)]
    shares = [sum(both[i] for i in of) / max(1, sum(wrong[i] for i in of)) for of in drawn]
    assert (got.n, got.point) == (50, pytest.approx(sum(both) / sum(wrong)))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(shares, [2.5, 97.5])))


def test_an_inherited_share_of_a_thousand_items_takes_seconds(spark):
    assert seconds(lambda: ev.inherited_interval(*answers(spark, 1000), "id", ["id", "field"], 10_000, "s").collect()) < 20


def test_no_rows_give_no_interval(spark):
    none = frame(spark).where("k < 0")
    assert statistics.portable_bootstrap(none, ["g"], "k", "v", 50, "s").collect() == []


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def test_ten_thousand_resamples_of_a_thousand_items_take_seconds(spark):
    """Ten million draws; one row of a join for each took minutes."""
    rows = spark.range(1000).select(F.lit("a").alias("g"), "id", (F.col("id") % 7).alias("v"))
    assert seconds(lambda: statistics.portable_bootstrap(rows, ["g"], "id", "v", 10_000, "s").collect()) < 20
