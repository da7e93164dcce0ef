"""Graded runs: checks, joins of answers with truth, paired comparisons, summaries of runs and of load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import nearest_rank
from ..schema import MISS_REASONS


def grade_run(predictions: DataFrame, items: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(answers joined with their items, number of failed calls); an orphan prediction is an error, a failed call isn't a miss."""
    if orphan := predictions.join(items.select(key), key, "left_anti").take(1):
        raise ValueError(f"a prediction has no item: {orphan[0][key]}")
    answered = F.col("ok") & F.col("text").isNotNull()
    return predictions.where(answered).join(items, key), predictions.where(~F.coalesce(answered, F.lit(False))).count()


def item_scores(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, accuracy, exact, n_correct, n_fields) of each item from its field outcomes."""
    return outcomes.groupBy(*by).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.bool_and("correct").alias("exact"), F.count_if("correct").alias("n_correct"), F.count("*").alias("n_fields"))


def field_report(outcomes: DataFrame) -> DataFrame:
    """(field, n, accuracy, misses map of reason to count): grouped twice, so no group's rows are ever collected."""
    by_reason = outcomes.groupBy("field", "reason").agg(F.count("*").alias("k"), F.count_if("correct").alias("good"))
    entry = F.when(F.col("reason").isNotNull(), F.struct((-F.col("k")).alias("o"), "reason", "k"))
    misses = F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["reason"], e["k"])))
    return by_reason.groupBy("field").agg(F.sum("k").alias("n"), (F.sum("good") / F.sum("k")).alias("accuracy"), misses.alias("misses"))


def failure_table(outcomes: DataFrame) -> DataFrame:
    """(reason, n, per_1000): every miss reason, absent ones at zero, per 1,000 fields."""
    names = outcomes.sparkSession.createDataFrame([(i, r) for i, r in enumerate(MISS_REASONS)], "reason_ord int, reason string")
    total = outcomes.agg(F.count("*").alias("_total"))
    found = outcomes.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return names.join(found, "reason", "left").crossJoin(F.broadcast(total)).select("reason_ord", "reason", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 1000 / F.col("_total")).alias("per_1000"))


def paired_differences(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, delta): a minus b; an error if their keys differ."""
    full = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full_outer")
    if full.where("_a is null or _b is null").take(1):
        raise ValueError("the runs don't answer the same items")
    return full.select(*key, (F.col("_a") - F.col("_b")).alias("delta"))


def inherited_errors(student: DataFrame, teacher: DataFrame, key: list[str]) -> DataFrame:
    """(teacher_errors, repeated, share): teacher errors that the student repeats with the same answer, null equal to null."""
    t = teacher.where("not correct").select(*key, F.col("predicted").alias("_t"))
    both = t.join(student.select(*key, "predicted", "correct"), key)
    repeated = F.count_if(~F.col("correct") & F.col("predicted").eqNullSafe(F.col("_t")))
    return both.agg(F.count("*").alias("teacher_errors"), repeated.alias("repeated"), (repeated / F.greatest(F.count("*"), F.lit(1))).alias("share"))


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if both := a.select(key).intersect(b.select(key)).take(1):
        raise ValueError(f"{both[0][0]} is on both sides; compare them paired")


def differing_keys(a: DataFrame, b: DataFrame, keys: list[str], on: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep (columns of a) and differing: which manifest keys differ, null equal to null, between rows a and b that on matches."""
    left, right = a.alias("a"), b.alias("b")
    joined = left.join(right, on)
    return joined.select(*[F.col(f"a.{c}") for c in keep], F.filter(F.array(*[F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in keys]), lambda k: k.isNotNull()).alias("differing"))


def complete_runs(runs: DataFrame, wanted: DataFrame, run: str, key: str) -> DataFrame:
    """(run) of the runs that answer every wanted item: counts compared, no run-by-item cross."""
    n = wanted.select(key).distinct().agg(F.count("*").alias("_n"))
    have = runs.join(wanted.select(key).distinct(), key, "left_semi").groupBy(run).agg(F.countDistinct(key).alias("_have"))
    return have.join(F.broadcast(n), F.col("_have") == F.col("_n")).select(run)


def load_summary(timings: DataFrame, by: list[str], warmup: float) -> DataFrame:
    """(by, requests, errors, window_s, requests_per_second, tokens_per_second, ttft and e2e percentiles in ms).

    Requests sent before the first plus warmup are cut; failures count as errors and as nothing served."""
    start = timings.groupBy(*by).agg(F.min("sent_at").alias("_t0"))
    kept = timings.join(start, by).where(F.col("sent_at") >= F.col("_t0") + F.lit(warmup))
    ttft, e2e = (F.col("first_token_at") - F.col("sent_at")) * 1000, (F.col("done_at") - F.col("sent_at")) * 1000
    kept = kept.withColumn("ttft", F.when(F.col("ok"), ttft)).withColumn("e2e", F.when(F.col("ok"), e2e))
    window = F.max("done_at") - F.min("sent_at")
    return kept.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"), window.alias("window_s"),
        F.try_divide(F.count_if("ok").cast("double"), window).alias("requests_per_second"),
        F.try_divide(F.sum(F.when(F.col("ok"), F.col("output_tokens"))).cast("double"), window).alias("tokens_per_second"),
        *[nearest_rank(c, p).alias(f"{c}_p{p}_ms") for c in ("ttft", "e2e") for p in (50, 99)],
    )


def run_summary(graded: DataFrame, predictions: DataFrame, recosted: DataFrame | None = None) -> DataFrame:
    """(graded, failed, accuracy, exact, usd_per_1000, tokens, p50_ms, p99_ms) of a run; recomputed costs override recorded."""
    if recosted is not None:
        predictions = predictions.join(recosted.select("ledger_id", F.col("usd").alias("_usd")), "ledger_id", "left").withColumn("cost_usd", F.coalesce("_usd", "cost_usd")).drop("_usd")
    calls = predictions.agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), (F.avg("cost_usd") * 1000).alias("usd_per_1000"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), nearest_rank("latency_ms", 50).alias("p50_ms"), nearest_rank("latency_ms", 99).alias("p99_ms"), F.array_join(F.array_sort(F.collect_set("price_list")), ", ").alias("price_lists"))
    return graded.agg(F.count("*").alias("graded"), F.avg("accuracy").alias("accuracy"), F.avg(F.col("exact").cast("double")).alias("exact")).crossJoin(F.broadcast(calls))
