"""Report tables: fronts, tallies, coverage, crosstabs, anchors, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pareto_front(points: DataFrame, by: list[str], cost: str, gain: str) -> DataFrame:
    """Points that no other of their group dominates (cost no higher, gain no lower, one strictly); equal points all stay.

    First the best gain per distinct cost, then a running maximum over cheaper costs: a sort where a theta self-join would
    compare all pairs. The running window holds one row per distinct cost of a group.
    """
    best = points.where(F.col(cost).isNotNull() & F.col(gain).isNotNull()).groupBy(*by, cost).agg(F.max(gain).alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_top") > F.col("_before"))).select(*by, cost, F.col("_top").alias(gain))
    return points.join(front, [*by, cost, gain], "left_semi")


def tally(results: DataFrame, reason: str, detail: str) -> DataFrame:
    """(key, n): results by reason, or reason:detail where there is a detail, 'kept' for no reason."""
    key = F.when(F.col(reason).isNull(), "kept").when(F.col(detail).isNull(), F.col(reason)).otherwise(F.concat_ws(":", reason, detail))
    return results.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, n): non-null values of each column, counted in one pass and unpivoted."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["_n"], columns, "field", "filled").select("field", "filled", F.col("_n").alias("n"))


def crosstab(rows: DataFrame, down: str, across: str, values: list) -> DataFrame:
    """Counts of down by across, a column per given value, zero where there are none."""
    return rows.groupBy(down).pivot(across, values).count().fillna(0)


def extremes(rows: DataFrame, by: list[str], label: str, cost: str, gain: str, order: str) -> DataFrame:
    """(by, cheapest, best): labels of least cost and most gain; the first in order wins ties."""
    return rows.groupBy(*by).agg(F.min_by(label, F.struct(cost, order)).alias("cheapest"), F.min_by(label, F.struct(-F.col(gain), order)).alias("best"))


def seed_means(scores: DataFrame, by: list[str], item: str, seed: str, value: str, seeds: list) -> DataFrame:
    """(by, one column per seed, mean): means by seed, and the mean over items of each item's mean over seeds."""
    wide = scores.groupBy(*by).pivot(seed, seeds).agg(F.avg(value))
    whole = scores.groupBy(*by, item).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"))
    return wide.join(whole, by)


def beside(rows: DataFrame, variant: str, control: str, key: list[str], value: str) -> DataFrame:
    """Rows with a variant beside the control of the same key: (key, variant, value, control_value, delta), orphans kept."""
    base = rows.where(F.col(variant) == control).select(*key, F.col(value).alias("control_value"))
    out = rows.where(F.col(variant) != control).join(base, key, "left")
    return out.select(*key, variant, value, "control_value", (F.col(value) - F.col("control_value")).alias("delta"))


def one_factor_sweep(base: dict, options: dict[str, list], spark: object) -> DataFrame:
    """The base settings and each change of one factor, without repeats: (run, factor, *settings)."""
    rows, seen = [], set()
    for factor, changes in [("base", [None]), *options.items()]:
        for value in changes:
            made = base if factor == "base" else base | {factor: value}
            if (name := "-".join(f"{k}{v}" for k, v in made.items())) not in seen:
                seen.add(name)
                rows.append((name, factor, *made.values()))
    return spark.createDataFrame(rows, ["run", "factor", *base])  # type: ignore[attr-defined]


def above_limit(rows: DataFrame, length: str, limit: int) -> DataFrame:
    """(n, above, share): how many lengths would be cut at limit."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(length) > limit).alias("above"), F.avg((F.col(length) > limit).cast("double")).alias("share"))


def markdown_lines(rows: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """(place, line): a markdown table of text columns in the order of place, which counts from 1; the head is in places 0 and 1."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|---" * len(columns) + "|")], f"{place} int, line string")
    body = rows.select((F.col(place) + 1).cast("int").alias(place), F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))
    return head.unionByName(body)
