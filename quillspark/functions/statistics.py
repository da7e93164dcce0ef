"""Intervals and the several quantiles that reports use, which aren't the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.sinks import written
from .draws import Samples, batch

Z95 = 1.959964
#: Numbers of samples that are broadcast (8 bytes each), draws that a task makes (some 0.2 microseconds each), and its resamples at least.
HELD, DRAWS, LEAST = 1 << 24, 1 << 22, 8


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least p percent of the values at or below it."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})")


def upper_median(value: str) -> Column:
    """sorted[n // 2], found by counting: exact, and summed per distinct value before any group is complete."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def wilson(count: Column, n: Column) -> Column:
    """struct(point, low, high): the 95 % score interval of a proportion, null without trials."""
    p = F.try_divide(count, n)
    centre = F.try_divide(p + F.try_divide(F.lit(Z95**2), 2 * n), 1 + F.try_divide(F.lit(Z95**2), n))
    half = F.try_divide(F.lit(Z95) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z95**2), 4 * n * n)), 1 + F.try_divide(F.lit(Z95**2), n))
    return F.struct(p.alias("point"), F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def drawn(df: DataFrame, by: list[str], order: str, resamples: int, seed: str) -> DataFrame:
    """The rows of each resample r of each group. Draw i of resample r is row md5('seed:r:i') mod n in the group's order, so any
    engine with md5 gives the same draws. Groups of one size have the same draws, which are made once for each size."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w).cast("int"))
    sizes = rows.select(F.col("_n").alias("n")).distinct().select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    draws = sizes.select("n", "i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "i")), 1, 8), 16, 10).cast("long")
    picks = draws.select(F.col("n").alias("_n"), "r", F.pmod(at, "n").cast("int").alias("_i"))
    return picks.join(rows, ["_n", "_i"]).drop("_n", "_i")


def resampled(df: DataFrame, by: list[str], order: str, columns: list[str], resamples: int, seed: str, shares: list[float] | None = None) -> DataFrame:
    """by, r and the sum of each column (double) over each resample of drawn(), or with shares the nearest rank of each share in
    the one column, q0 on. Up to HELD numbers are broadcast in their order, and tasks take resamples; more meet their draws in a join."""
    spark = df.sparkSession
    groups = df.groupBy(*by).agg(F.count("*").alias("_n"))
    names = columns if shares is None else [f"q{k}" for k in range(len(shares))]
    if (groups.agg(F.sum("_n")).first()[0] or 0) * len(columns) > HELD:
        found = [F.sum(c) for c in columns] if shares is None else [nearest_rank(columns[0], 100 * p) for p in shares]
        return drawn(df, by, order, resamples, seed).groupBy(*by, "r").agg(*[f.alias(n) for f, n in zip(found, names, strict=True)])
    keys = groups.orderBy(*by).toArrow()
    rows = df.orderBy(*by, order, *columns).select(*columns).toArrow()  # the columns settle ties of order
    counts, keys = keys.column("_n").to_numpy(), keys.drop_columns("_n")
    numbers, levels = [rows.column(c).combine_chunks() for c in columns], None
    if shares is None:
        numbers = [c.fill_null(0.0).to_numpy() for c in numbers]
    else:
        known = np.unique(numbers[0].drop_null().to_numpy())
        codes = np.searchsorted(known, numbers[0].to_numpy(zero_copy_only=False)).astype(np.uint32)
        codes[numbers[0].is_null().to_numpy(zero_copy_only=False)] = len(known)
        numbers, levels = [codes], pa.array([*known, None], pa.float64())
    held = spark.sparkContext.broadcast((Samples(counts, numbers), keys, levels))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, keys, levels = held.value
        for b in batches:
            of = b.column(0).to_numpy()
            found = samples.sums(seed, of) if shares is None else samples.quantiles(seed, of, levels, shares)
            yield from (batch(keys, group, r, values, names) for group, r, values in found)

    tasks = max(1, min(resamples // LEAST, int(counts.max(initial=0)) * resamples // DRAWS))
    schema = T.StructType([*(df.schema[b] for b in by), T.StructField("r", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return spark.range(0, resamples, 1, tasks).mapInArrow(draw, schema)


def _ends(values: DataFrame, by: list[str], value: Column) -> DataFrame:
    return values.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in (("low", 0.025), ("high", 0.975))])


def portable_interval(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], statistic: Column, resamples: int, seed: str) -> DataFrame:
    """by, n, point, low, high: a statistic of the named sums, and the 2.5 and 97.5 percentiles of its resampled values."""
    rows = written(df.select(*by, order, *[c.cast("double").alias(n) for n, c in sums.items()]), "interval")
    ends = _ends(resampled(rows, by, order, [*sums], resamples, seed), by, statistic)
    points = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return points.select(*by, "n", statistic.alias("point")).join(ends, by)


def _mean(value: str) -> tuple[dict[str, Column], Column]:
    """The sums and the statistic of a mean, which leaves nulls out."""
    return {"_sum": F.col(value), "_known": F.col(value).isNotNull()}, F.try_divide("_sum", "_known")


def portable_bootstrap(df: DataFrame, by: list[str], order: str, value: str, resamples: int, seed: str) -> DataFrame:
    """portable_interval of the mean of value."""
    return portable_interval(df, by, order, *_mean(value), resamples, seed)


def portable_quantiles(df: DataFrame, by: list[str], order: str, value: str, percents: dict[str, float], resamples: int, seed: str) -> DataFrame:
    """by, statistic (a name in percents), n, point, low, high: nearest-rank percentiles of value, all of the same resamples."""
    rows = written(df.select(*by, order, F.col(value).cast("double").alias("_v")), "interval")
    values = resampled(rows, by, order, ["_v"], resamples, seed, [p / 100 for p in percents.values()])
    listed = lambda of: F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), c.alias("m")) for n, c in of.items()])).alias("_s")
    ends = _ends(values.select(*by, listed({n: F.col(f"q{k}") for k, n in enumerate(percents)})).select(*by, "_s.*"), [*by, "statistic"], F.col("m"))
    points = rows.groupBy(*by).agg(F.count("*").alias("n"), *[nearest_rank("_v", p).alias(f"q{k}") for k, p in enumerate(percents.values())])
    points = points.select(*by, "n", listed({n: F.col(f"q{k}") for k, n in enumerate(percents)}))
    return points.select(*by, "n", "_s.statistic", F.col("_s.m").alias("point")).join(ends, [*by, "statistic"])


def unpaired_interval(a: DataFrame, b: DataFrame, by: list[str], order: str, value: str, resamples: int, seed: str) -> DataFrame:
    """by, n, point, low, high of the mean of a less the mean of b, each resampled on its own."""
    sums, mean = _mean(value)
    sides = [written(df.select(*by, order, *[c.cast("double").alias(n) for n, c in sums.items()]), "interval") for df in (a, b)]
    means = [resampled(df, by, order, [*sums], resamples, f"{seed}-{name}").select(*by, "r", mean.alias(name)) for df, name in zip(sides, ("left", "right"), strict=True)]
    ends = _ends(means[0].join(means[1], [*by, "r"]), by, F.col("left") - F.col("right"))
    points = [df.groupBy(*by).agg(F.count("*").alias(f"_n{i}"), *[F.sum(c).alias(c) for c in sums]).select(*by, f"_n{i}", mean.alias(f"_v{i}")) for i, df in enumerate(sides)]
    return points[0].join(points[1], by).select(*by, (F.col("_n0") + F.col("_n1")).alias("n"), (F.col("_v0") - F.col("_v1")).alias("point")).join(ends, by)


def numpy_bootstrap(df: DataFrame, by: list[str], order: str, value: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """As portable_bootstrap, with numpy's default generator over each group's values in order. A group is one sample of
    an evaluation; resamples are drawn in blocks, so memory stays at the block's size."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values(order, kind="stable")[value].to_numpy(dtype=float)
        rng = np.random.default_rng(seed)
        block = max(1, (1 << 22) // max(1, len(v)))
        means = np.concatenate([v[rng.integers(0, len(v), size=(min(block, resamples - a), len(v)))].mean(axis=1) for a in range(0, resamples, block)])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([[*(group[b].iloc[0] for b in by), len(v), v.mean(), low, high]], columns=[*by, "n", "point", "low", "high"])

    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    return df.select(*by, order, value).groupBy(*by).applyInPandas(one, f"{kinds}, n bigint, point double, low double, high double")
