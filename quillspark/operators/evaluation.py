"""Evaluations as tables: run summaries, verdicts, audits, gates, serving costs, distilled training rows, recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import costing, statistics
from ..functions.statistics import nearest_rank
from ..schema import FIELDS

# Formats in their order, the margin of a verdict, what a sweep starts from, audit verdicts.
FORMATS = ["bf16", "awq", "gptq", "gguf-q4_k_m", "gguf-q8_0"]
MARGIN, QUOTED_UTILISATION, SERVING_CONCURRENCY = 0.01, 0.5, 32
SWEEP_BASE = {"rank": "16", "rate": "1e-4", "volume": "all"}
VERDICTS = ["ok", "wrong"]
RUN_NAME = r"^([^-]+)-r(\d+)-lr([0-9.]+(?:e-?\d+)?)-n(\d+|all)-s(\d+)-e(\d+)(-.+)?$"
RUN_PARTS = ["size", "rank", "rate", "volume", "seed", "epochs", "suffix"]


def run_parts(name: Column) -> Column:
    """struct of RUN_PARTS of a training run's name; all null where it isn't one, suffix null without one."""
    is_run = name.rlike(RUN_NAME)
    return F.struct(*[F.when(is_run, F.nullif(F.regexp_extract(name, RUN_NAME, i + 1), F.lit(""))).alias(n) for i, n in enumerate(RUN_PARTS)])


def run_class(name: Column) -> Column:
    """'ablation' for a run with a suffix, 'scaling' for one on part of the training rows, 'main' for another, null for no run."""
    p = run_parts(name)
    return F.when(p["size"].isNull(), F.lit(None)).when(p["suffix"].isNotNull(), "ablation").when(p["volume"] != "all", "scaling").otherwise("main")


def control_of(name: Column) -> Column:
    """The name of the run that an ablation changes one thing of; null for other runs."""
    return F.when(run_class(name) == "ablation", F.regexp_extract(name, r"^([^-]+-r\d+-lr[0-9.]+(?:e-?\d+)?-n(?:\d+|all)-s\d+-e\d+)", 1))


def sweep_variant(name: Column) -> Column:
    """struct(varied, value): the one factor that a sweep's run changes from its base; nulls for runs that aren't in the sweep."""
    p = run_parts(name)
    changed = [p[k] != v for k, v in SWEEP_BASE.items()]
    n = sum((c.cast("int") for c in changed), F.lit(0))
    inside = p["suffix"].isNull() & (p["seed"] == "0") & (p["epochs"] == "1") & (n <= 1)
    varied = F.when(n == 0, "Base recipe").when(changed[0], "Adapter rank").when(changed[1], "Learning rate").otherwise("Training filings")
    value = F.when(n == 0, "rank 16, 1e-4, every filing").when(changed[0], p["rank"]).when(changed[1], p["rate"]).otherwise(F.format_number(p["volume"].cast("bigint"), 0))
    return F.struct(F.when(inside, varied).alias("varied"), F.when(inside, value).alias("value"))


def run_summaries(calls: DataFrame, by: list[str]) -> DataFrame:
    """One row per run of its calls (ok, accuracy, exact, parsed, costed, cached, cost_usd, price_list, tokens, latency_ms,
    ttft_ms): counts, means, cost per 1,000 costed calls, spend of the graded ones, price lists, percentiles."""
    answered = F.col("ok") & F.col("accuracy").isNotNull()
    cost = F.when(F.col("costed"), F.col("cost_usd"))
    out = calls.groupBy(*by).agg(
        F.count_if(answered).alias("graded"), F.count_if(~answered).alias("failed"), F.count_if("cached").alias("cached_calls"), F.avg(F.when(answered, F.col("accuracy"))).alias("accuracy"),
        F.avg(F.when(answered, F.col("exact").cast("double"))).alias("exact"), F.avg(F.when(answered, (~F.col("parsed")).cast("double"))).alias("unparseable"), (F.avg(cost) * 1000).alias("usd_per_1000"),
        F.count_if(~F.col("costed")).alias("uncosted_calls"), F.array_join(F.array_sort(F.collect_set("price_list")), ", ").alias("price_lists"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), nearest_rank("latency_ms", 50).alias("p50_ms"), nearest_rank("latency_ms", 99).alias("p99_ms"), nearest_rank("ttft_ms", 50).alias("ttft_p50_ms"),
    )
    return out.withColumn("spend", F.coalesce(F.col("usd_per_1000") / 1000 * F.col("graded"), F.lit(0.0)))


def cheapest_first(summaries: DataFrame, run: str, cost: str) -> DataFrame:
    """summaries with place: by cost, uncosted runs last, ties by name. A report's runs are few."""
    return summaries.withColumn("place", F.row_number().over(Window.orderBy(F.col(cost).asc_nulls_last(), run)))


def anchors(summaries: DataFrame, run: str, cost: str, gain: str) -> DataFrame:
    """(cheapest, best): the costed run of least cost and the run of most accuracy, the first by name among equals."""
    return summaries.agg(F.min_by(run, F.when(F.col(cost).isNotNull(), F.struct(cost, run))).alias("cheapest"), F.min_by(run, F.struct(-F.col(gain), run)).alias("best"))


def accuracy_by_item(outcomes: DataFrame, by: list[str], item: str, field: str | None = None) -> DataFrame:
    """(by, item, v): the share of correct fields of each item, or whether one field is."""
    rows = outcomes if field is None else outcomes.where(F.col("field") == field)
    return rows.groupBy(*by, item).agg(F.avg(F.col("correct").cast("double")).alias("v"))


def format_verdicts(outcomes: DataFrame, run: str, form: str, item: str, resamples: int, seed: str, margin: float = MARGIN) -> DataFrame:
    """(run, format, format_ord, n, point, low, high, ships, worst_field, worst_delta): each format beside the reference format of
    its run, over the same items; without a reference all but run and format are null. Different items are an error."""
    named = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col(form)).cast("int").alias("format_ord")
    key = [run, item, "field"]
    base = outcomes.where(F.col(form) == FORMATS[0]).select(*key, F.col("correct").cast("double").alias("_base"))
    others = outcomes.where(F.col(form) != FORMATS[0]).select(*key, form, F.col("correct").cast("double").alias("_own"))
    have = base.select(run).distinct().withColumn("_has", F.lit(True))
    judged = others.join(have, run, "left_semi").join(base, key, "left")
    back = base.join(others.select(run, form).distinct(), run).join(others, [*key, form], "left_anti")
    if judged.where("_base is null").take(1) or back.take(1):
        raise ValueError("a format and its reference answer different items")
    judged = judged.withColumn("d", F.col("_own") - F.col("_base"))
    deltas = judged.groupBy(run, form, item).agg(F.avg("d").alias("v"))
    fields = judged.groupBy(run, form, "field").agg(F.avg("d").alias("d")).groupBy(run, form).agg(F.min_by("field", F.struct("d", "field")).alias("worst_field"), F.min("d").alias("worst_delta"))
    found = statistics.portable_bootstrap(deltas, [run, form], item, "v", resamples, seed).withColumn("ships", F.col("low") > -margin).join(fields, [run, form])
    return others.select(run, form).distinct().withColumn("format_ord", named).join(found, [run, form], "left")


def run_deltas(outcomes: DataFrame, run: str, item: str, pairs: DataFrame, resamples: int, seed: str) -> DataFrame:
    """pairs (run, control) with n, point, low, high of the paired accuracy difference; nulls where the control is missing."""
    scores = accuracy_by_item(outcomes, [run], item)
    both = pairs.join(scores, run).join(scores.select(F.col(run).alias("control"), item, F.col("v").alias("_c")), ["control", item])
    rows = both.select(run, "control", item, (F.col("v") - F.col("_c")).alias("v"))
    return pairs.join(statistics.portable_bootstrap(rows, [run, "control"], item, "v", resamples, seed), [run, "control"], "left")


def inherited_interval(student: DataFrame, teacher: DataFrame, item: str, key: list[str], resamples: int, seed: str) -> DataFrame:
    """(n, point, low, high): of the teacher's errors the share that the student repeats with the same answer, resampled by item.
    n counts items; a teacher without errors is an error."""
    both = teacher.select(*key, (~F.col("correct")).alias("_wrong"), F.col("predicted").alias("_t")).join(student.select(*key, "predicted", "correct"), key)
    same = F.col("_wrong") & ~F.col("correct") & F.col("predicted").eqNullSafe(F.col("_t"))
    items = both.groupBy(item).agg(F.count_if("_wrong").cast("double").alias("e"), F.count_if(same).cast("double").alias("i")).withColumn("g", F.lit("all"))
    if not items.where("e > 0").take(1):
        raise ValueError("the teacher made no errors")
    return statistics.portable_interval(items, ["g"], item, {c: F.col(c) for c in "ei"}, F.col("i") / F.greatest("e", F.lit(1.0)), resamples, seed).drop("g")


def measured_levels(levels: DataFrame, concurrency: int = SERVING_CONCURRENCY) -> DataFrame:
    """The levels at one concurrency that were measured and not retried."""
    return levels.where((F.col("concurrency") == concurrency) & F.col("rps").isNotNull() & ~F.col("retried"))


def self_hosted_costs(levels: DataFrame, utilisation: float = QUOTED_UTILISATION) -> DataFrame:
    """levels plus usd_per_1000 and its low and high: the low end of a cost is the high end of its rate."""
    per = lambda rate: costing.usd_per_call(F.col("usd_per_hour"), F.col(rate), F.lit(utilisation)) * 1000
    return levels.withColumn("usd_per_1000", per("rps")).withColumn("usd_low", per("rps_high")).withColumn("usd_high", per("rps_low"))


def serving_rows(levels: DataFrame, tested: DataFrame, accuracies: DataFrame, api_usd_per_call: float) -> DataFrame:
    """Every load-tested (run, format, gpu) with its cost, break-even volume, accuracy and delta to its run's reference format."""
    costs = self_hosted_costs(measured_levels(levels))
    be = costing.break_even(F.col("usd_per_hour"), F.col("rps"), F.lit(api_usd_per_call), F.lit(0.0), F.lit(QUOTED_UTILISATION))
    own = accuracies.select("run", "format", "accuracy")
    base = accuracies.where(F.col("format") == FORMATS[0]).select("run", F.col("accuracy").alias("_base"))
    out = tested.join(costs.withColumn("volume", be["volume"]), ["run", "format", "gpu"], "left").join(own, ["run", "format"], "left").join(base, "run", "left")
    return out.withColumn("delta", F.when(F.col("format") != FORMATS[0], F.col("accuracy") - F.col("_base"))).drop("_base")


def audit_report(sheet: DataFrame) -> DataFrame:
    """(audited, pending, wrong, point, low, high, first_pending) of a verdict sheet; an unknown verdict or field, or a wrong one
    that names no field, is an error."""
    verdict = F.lower(F.trim("verdict"))
    done = F.coalesce(verdict != "", F.lit(False))
    named = F.filter(F.split(F.trim(F.coalesce("wrong_fields", F.lit(""))), r"\s+"), lambda f: f != "")
    unknown = F.exists(named, lambda f: ~f.isin([f[0] for f in FIELDS]))
    if bad := sheet.where(done & (~verdict.isin(VERDICTS) | unknown | ((verdict == "wrong") & (F.size(named) == 0)))).select("n").take(1):
        raise ValueError(f"row {bad[0][0]} of the sheet isn't a valid verdict")
    out = sheet.agg(F.count_if(done).alias("audited"), F.count_if(~done).alias("pending"), F.count_if(done & (verdict == "wrong")).alias("wrong"), F.min(F.when(~done, F.col("n"))).alias("first_pending"))
    return out.withColumn("_w", statistics.wilson(F.col("wrong"), F.col("audited"))).select("audited", "pending", "wrong", "first_pending", "_w.point", "_w.low", "_w.high")


def audit_fields(sheet: DataFrame) -> DataFrame:
    """(field, n): how often each field is named by a wrong verdict."""
    wrong = sheet.where(F.lower(F.trim("verdict")) == "wrong")
    return wrong.select(F.explode(F.split(F.trim("wrong_fields"), r"\s+")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def gate_sides(outcomes: DataFrame, calls: DataFrame, label: str) -> DataFrame:
    """(label, suite, items, correct, ungradeable_items, calls, latency_p50_ms, cost_usd, uncosted_calls): one suite per field; a failed
    call is ungradeable in all. The verdict of each item is the outcomes table itself, joined to this one by suite."""
    counts = calls.groupBy(label).agg(
        F.count_if(~F.col("ok")).alias("ungradeable_items"), F.count("*").alias("calls"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE ok)").alias("latency_p50_ms"),
        F.coalesce(F.sum(F.when(F.col("costed"), F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"), F.count_if(F.col("ok") & ~F.col("costed")).alias("uncosted_calls"),
    )
    suites = outcomes.groupBy(label, F.lower("field").alias("suite")).agg(F.count("*").alias("items"), F.count_if("correct").alias("correct"))
    return suites.join(counts, label)


def distilled(examples: DataFrame, answers: DataFrame, key: str = "item_id") -> DataFrame:
    """examples with another run's answers as the targets of the training rows; those it didn't answer go, validation stays."""
    out = examples.join(answers.select(key, F.col("answer").alias("_answer")), key, "left")
    train = F.col("split") == "train"
    return out.where(~train | F.col("_answer").isNotNull()).withColumn("assistant", F.when(train, F.col("_answer")).otherwise(F.col("assistant"))).drop("_answer")


def steps(examples: Column, volume: Column, batch: Column, epochs: Column) -> Column:
    """Optimiser steps: partial last batches count; a null volume takes every example."""
    return F.ceil(F.least(examples, F.coalesce(volume, examples)) / batch) * epochs


def training_plan(configs: DataFrame, examples: int, seconds_per_step: float) -> DataFrame:
    """configs (volume, batch, epochs, save_steps) plus steps, checkpoints (that of step 1 included) and hours of one GPU."""
    n = steps(F.lit(examples), F.col("volume"), F.col("batch"), F.col("epochs"))
    out = configs.withColumn("steps", n.cast("bigint"))
    return out.withColumn("checkpoints", 1 + F.floor(F.col("steps") / F.col("save_steps")).cast("bigint")).withColumn("gpu_hours", F.col("steps") * seconds_per_step / 3600)


def checkpoint_step(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)$", 1), F.lit("")).cast("bigint")


def resume_steps(checkpoints: DataFrame, run: str) -> DataFrame:
    """(run, latest, step): the newest complete checkpoint of each run, and the step to go on from, 0 without one."""
    step = F.when(F.col("complete"), checkpoint_step(F.col("name")))
    return checkpoints.groupBy(run).agg(F.max_by("name", step).alias("_name"), F.max(step).alias("_step")).select(run, F.when(F.col("_step").isNotNull(), F.col("_name")).alias("latest"), F.coalesce("_step", F.lit(0)).cast("bigint").alias("step"))


def loss_tokens(labels: Column) -> Column:
    """How many labels of a row count towards the loss."""
    return F.size(F.filter(labels, lambda x: x != -100))


def mean_tokens(timings: DataFrame, by: list[str], warmup: float) -> DataFrame:
    """(by, mean_input, mean_output) of the successful requests after the warm-up."""
    start = timings.groupBy(*by).agg(F.min("sent_at").alias("_t0"))
    kept = timings.join(start, by).where(F.col("ok") & (F.col("sent_at") >= F.col("_t0") + F.lit(warmup)))
    return kept.groupBy(*by).agg(F.avg("input_tokens").alias("mean_input"), F.avg("output_tokens").alias("mean_output"))


def schema_lines(fields: DataFrame, choices: dict[str, list[str]]) -> DataFrame:
    """(field_ord, line): the fields as a prompt lists them."""
    kinds = F.when(F.col("kind") == "date", "string, YYYY-MM-DD").when(F.col("kind") == "categorical", "string").otherwise("number")
    for name, values in choices.items():
        kinds = F.when(F.col("field") == name, "one of " + ", ".join(values)).otherwise(kinds)
    return fields.select("field_ord", F.concat(F.lit("  "), "field", F.lit(" ("), kinds, F.lit(", or null)")).alias("line"))


def messages(system: Column, examples: Column, user: Column) -> Column:
    """The chat messages of a prompt: system text, example turns (struct(user, assistant)) in order, then the input."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = F.flatten(F.transform(examples, lambda e: F.array(turn("user", e["user"]), turn("assistant", e["assistant"]))))
    return F.concat(F.array(turn("system", system)), shots, F.array(turn("user", user)))
