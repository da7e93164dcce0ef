"""Samples by keyed hash: strata in turn, few-shot picks, latest rows, resume sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import keyed_rank


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows, strata taking turns in order, each by keyed rank; turn is the row's place in its stratum.

    No stratum can give more than n rows, so the ranking keeps n of each (a group limit before the shuffle).
    """
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(keyed_rank(seed, key), key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def few_shot(pool: DataFrame, strata: list[str], key: str, length: str, k: int, seed: str) -> DataFrame:
    """k examples from the shorter half by median length, strata in turn; an error if there are fewer."""
    median = pool.agg(F.expr(f"percentile({length}, 0.5)").alias("_m"))
    out = round_robin(pool.crossJoin(F.broadcast(median)).where(F.col(length) <= F.col("_m")).drop("_m"), strata, key, k, seed)
    if out.count() < k:
        raise ValueError(f"fewer than {k} short examples")
    return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, with first_seen, the order of its first; sort by first_seen for log order.

    One aggregation, combined before its shuffle, so a key with a third of all rows costs no more than another.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_row"), F.min(order).alias("first_seen")).select("_row.*", "first_seen")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def unanswered(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Items without a successful answer in the log: what a resumed run still has to do."""
    return items.join(log.where(F.col("ok") & F.col("text").isNotNull()).select(key), key, "left_anti")


def set_aside(predictions: DataFrame, items: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(predictions of items in the build, number set aside); an error if all are set aside."""
    inside = predictions.join(items.select(key), key, "left_semi")
    aside = predictions.join(items.select(key), key, "left_anti").count()
    if aside and inside.isEmpty():
        raise ValueError("no prediction belongs to this build")
    return inside, aside
