"""Places of rows inside groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], place: str, total: str) -> DataFrame:
    """rows with their place (from 1) in the order of their group, and the group's size.

    bucket must not fall where the order rises, such as a rank's leading digits. Rows are sorted bucket by bucket, so a group
    is dealt over as many tasks as it has buckets; only the counts of buckets are summed along a group.
    """
    held = rows.withColumn("_bucket", bucket)
    counts = held.groupBy(*by, "_bucket").agg(F.count("*").alias("_k"))
    along, whole = Window.partitionBy(*by).orderBy("_bucket"), Window.partitionBy(*by)
    counts = counts.select(*by, "_bucket", (F.sum("_k").over(along) - F.col("_k")).alias("_before"), F.sum("_k").over(whole).alias(total))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"c.{b}")) for b in [*by, "_bucket"]]
    joined = held.withColumn("_inside", inside).alias("r").join(counts.alias("c"), same)
    return joined.select("r.*", (F.col("_inside") + F.col("_before")).alias(place), F.col(f"c.{total}")).drop("_bucket", "_inside")
