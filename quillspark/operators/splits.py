"""Leak-free splits: pools by keyed rank inside strata, cutoffs by date, reports and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import keyed_rank
from ..functions.ranking import numbered
from ..schema import SPLITS


def assign_pools(filings: DataFrame, key: str, stratum: str, seed: str = "20270405", test: float = 0.2, validation: float = 0.1, rank: Column | None = None) -> DataFrame:
    """(stratum, key, pool): each company in one pool; in a stratum of n, the first round(n test) by rank are test (one at
    least, if n > 1), the next round(n validation) validation. Halves round to even. A rank given must be text whose order is its rank."""
    if not 0 < test < 1 or not 0 <= validation < 1 or test + validation >= 1:
        raise ValueError("the fractions must lie in (0, 1) and leave training data")
    companies = filings.select(stratum, key).distinct()
    companies = companies.withColumn("_rank", rank if rank is not None else keyed_rank(seed, key))
    ranked = numbered(companies, [stratum], F.substring("_rank", 1, 2), [F.col("_rank"), F.col(key)], "_i", "_n")
    n_test = F.when(F.col("_n") >= 2, F.greatest(F.bround(F.col("_n") * F.lit(test)), F.lit(1.0))).otherwise(F.bround(F.col("_n") * F.lit(test)))
    n_validation = F.bround(F.col("_n") * F.lit(validation))
    pool = F.when(F.col("_i") <= n_test, "test").when(F.col("_i") <= n_test + n_validation, "validation").otherwise("train")
    return ranked.select(stratum, key, pool.alias("pool"))


def assign_splits(filings: DataFrame, pools: DataFrame, key: str, filed: str, cutoff: str) -> DataFrame:
    """filings with split: test companies before or after the cutoff, others only up to it (null after: dropped)."""
    late = F.col(filed) > F.lit(cutoff).cast(filings.schema[filed].dataType)
    split = F.when(F.col("pool") == "test", F.when(late, "test_post_cutoff").otherwise("test_pre_cutoff")).when(~late, F.col("pool"))
    return filings.join(pools.select(key, "pool"), key).withColumn("split", split)


def split_report(assigned: DataFrame, key: str) -> DataFrame:
    """(split, filings, companies), zero-filled over all splits; rows after the cutoff count as 'dropped_after_cutoff'."""
    names = assigned.sparkSession.createDataFrame([(s,) for s in [*SPLITS, "dropped_after_cutoff"]], "split string")
    found = assigned.groupBy(F.coalesce("split", F.lit("dropped_after_cutoff")).alias("split")).agg(F.count("*").alias("filings"), F.countDistinct(key).alias("companies"))
    return F.broadcast(names).join(found, "split", "left").fillna(0, ["filings", "companies"])


def leaks(assigned: DataFrame, key: str) -> DataFrame:
    """(key, pools): companies in more than one pool; empty when the split is sound."""
    pool = F.when(F.col("split").startswith("test"), "test").otherwise(F.col("split"))
    return assigned.where("split is not null").groupBy(key).agg(F.countDistinct(pool).alias("pools")).where("pools > 1")


def check_no_leakage(assigned: DataFrame, key: str) -> None:
    """Raises with the first leaking company."""
    if found := leaks(assigned, key).take(1):
        raise ValueError(f"{key} {found[0][0]} is in {found[0][1]} pools")


def require_splits(rows: DataFrame, allowed: list[str], column: str = "split") -> DataFrame:
    """rows, or an error if any is outside the allowed splits."""
    if wrong := rows.where(~F.col(column).isin(allowed) | F.col(column).isNull()).select(column).take(1):
        raise ValueError(f"split {wrong[0][0]!r} may not enter here")
    return rows


def size_bands(rows: DataFrame, key: str, value: str, bounds: list[float], names: list[str]) -> DataFrame:
    """(key, median, band): each company's interpolated median and the first band whose bound lies above it."""
    median = rows.groupBy(key).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))
    band = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        band = F.when(F.col("median") < bound, name).otherwise(band)
    return median.withColumn("band", F.when(F.col("median").isNull(), "unknown").otherwise(band))


def first_companies(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """All rows of the n companies of least keyed rank: a top-n of distinct companies, joined back."""
    chosen = rows.select(key).distinct().orderBy(keyed_rank(seed, key), key).limit(n)
    return rows.join(chosen, key, "left_semi")


def nested_volumes(rows: DataFrame, key: str, sizes: list[int], seed: str) -> DataFrame:
    """(volume, key): for each size the rows of least keyed rank, so smaller volumes lie in larger ones.

    Only the largest volume is ranked, so the ranking window never holds more than that many rows."""
    largest = rows.select(key).orderBy(keyed_rank(seed, key), key).limit(max(sizes))
    if (n := largest.count()) < max(sizes):
        raise ValueError(f"{max(sizes)} rows are asked for, but there are {n}")
    ranked = largest.withColumn("_i", F.row_number().over(Window.orderBy(keyed_rank(seed, key), key)))
    return ranked.select(F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("_i") <= s)).alias("volume"), key)
