"""Selection of the fact that answers a field for a report, and of the distractors beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BANDS, MAX_DISTRACTORS, SLACK_DAYS


def _bands(spark: object) -> DataFrame:
    return spark.createDataFrame([(p, *b) for p, b in BANDS.items()], "fiscal_period string, target int, low int, high int")  # type: ignore[attr-defined]


def candidates(facts: DataFrame, reports: DataFrame, fields: DataFrame) -> DataFrame:
    """Facts of a report for each field's concepts: accession, field, kind, concept_ord, the fact, period columns, matched.

    Facts meet reports by accession, and the field dimension (15 rows) by concept. A fact matches if it ends within the
    slack of the period's end and is an instant (for money, where the concept has one at all), a cover fact, or of a
    duration in the fiscal period's band.
    """
    dim = fields.select("field_ord", "field", "kind", F.posexplode("concepts").alias("concept_ord", "concept"))
    joined = facts.join(reports.select("accession", "period_end", "fiscal_period"), "accession").join(F.broadcast(dim), "concept").join(F.broadcast(_bands(facts.sparkSession)), "fiscal_period")
    days = F.datediff("end", "start")
    own = Window.partitionBy("accession", "field", "concept_ord")
    out = joined.withColumn("days", days).withColumn("_instants", (F.col("kind") == "monetary") & F.max(F.col("start").isNull()).over(own))
    ends = F.abs(F.datediff("end", "period_end")) <= SLACK_DAYS
    fits = F.when(F.col("_instants"), F.col("start").isNull()).when(F.col("concept").startswith("dei:"), F.lit(True)).otherwise(F.coalesce(F.col("days").between(F.col("low"), F.col("high")), F.lit(False)))
    return out.withColumn("matched", ends & fits).drop("_instants")


def _nearness() -> list:
    """Order of matches: duration nearest the target (zero days count as on target), end nearest, filed first, input order (then value)."""
    days = F.when(F.col("days").isNull() | (F.col("days") == 0), F.col("target")).otherwise(F.col("days"))
    return [F.abs(days - F.col("target")), F.abs(F.datediff("end", "period_end")), F.col("filed"), F.col("ordinal"), F.col("num_value"), F.col("str_value")]


def select_facts(found: DataFrame) -> DataFrame:
    """One row per (accession, field): the chosen fact (null columns if none matched) and up to four distractors.

    The first concept with a match wins; distractors are its other facts, then those of earlier concepts that missed, or
    all near misses if nothing matched, in input order and cut to four.
    """
    by = ["accession", "field"]
    won = Window.partitionBy(*by)
    place = F.row_number().over(Window.partitionBy(*by, "concept_ord", "matched").orderBy(*_nearness()))
    out = found.withColumn("_won", F.min(F.when(F.col("matched"), F.col("concept_ord"))).over(won)).withColumn("_place", place)
    chosen = F.col("matched") & (F.col("concept_ord") == F.col("_won")) & (F.col("_place") == 1)
    reach = F.col("_won").isNull() | (F.col("concept_ord") <= F.col("_won"))
    out = out.where(reach).withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    first = F.when(F.col("concept_ord") == F.col("_won"), 0).otherwise(1)
    order = Window.partitionBy(*by, "_chosen").orderBy(first, "concept_ord", "ordinal", "num_value", "str_value")
    out = out.withColumn("_rank", F.row_number().over(order)).where(F.col("_chosen") | (F.col("_rank") <= MAX_DISTRACTORS))
    other = F.when(~F.col("_chosen"), F.struct("_rank", F.struct(F.col("num_value").alias("num"), F.col("str_value").alias("str")).alias("value")))
    pick = lambda c: F.max(F.when(F.col("_chosen"), F.col(c))).alias(c)
    # at most four are left of each, so the arrays are bounded
    return out.groupBy(*by, "kind").agg(*[pick(c) for c in ("concept", "num_value", "str_value", "ordinal", "start", "end", "filed")], F.transform(F.array_sort(F.collect_list(other)), lambda x: x["value"]).alias("others"))


def period_matches(found: DataFrame) -> DataFrame:
    """(accession, field, concept_ord, ...): the best match of every concept, in order of preference."""
    place = F.row_number().over(Window.partitionBy("accession", "field", "concept_ord").orderBy(*_nearness()))
    return found.where("matched").withColumn("_place", place).where("_place = 1").drop("_place")


def with_neighbours(selected: DataFrame, neighbours: DataFrame) -> DataFrame:
    """selected with a neighbouring line's chosen value before the distractors, and those equal to the truth removed after
    the cut."""
    near = neighbours.select("accession", "field", F.struct(F.col("num_value").alias("num"), F.col("str_value").alias("str")).alias("_near"), F.col("ordinal").isNotNull().alias("_has"))
    out = selected.join(near, ["accession", "field"], "left")
    others = F.when(F.coalesce("_has", F.lit(False)), F.concat(F.array("_near"), F.col("others"))).otherwise(F.col("others"))
    differs = F.filter(others, lambda o: ~(o["num"].eqNullSafe(F.col("num_value")) & o["str"].eqNullSafe(F.col("str_value"))))
    return out.withColumn("others", differs).drop("_near", "_has")


def truth(selected: DataFrame) -> DataFrame:
    """(accession, fields map of field to struct(num, str), distractors map of field to array)."""
    value = F.struct("field", F.struct(F.col("num_value").alias("num"), F.col("str_value").alias("str")))
    return selected.groupBy("accession").agg(F.map_from_entries(F.collect_list(value)).alias("fields"), F.map_from_entries(F.collect_list(F.when(F.size("others") > 0, F.struct("field", "others")))).alias("distractors"))
