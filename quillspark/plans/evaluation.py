"""Registered queries of evaluations: intervals, verdicts, summaries, audits, gates, serving, training rows. The labelled documents
stand in for graded items, and events for calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics, text
from ..operators import evaluation as ev
from ..operators import runs, splits
from .queries import _query, table

_MAIN, _SMALL = "7b-r16-lr1e-4-nall-s0-e1", "3b-r8-lr1e-4-nall-s0-e1"
RUNS = [
    (0, _MAIN, "bf16"), (1, _MAIN, "awq"), (2, _MAIN, "gguf-q4_k_m"), (3, "7b-r16-lr1e-4-n1000-s0-e1", "bf16"), (4, "7b-r16-lr1e-4-n1000-s1-e1", "bf16"),
    (5, f"{_MAIN}-distill", "bf16"), (6, _SMALL, "awq"), (7, "7b-r64-lr1e-4-nall-s0-e1", "bf16"), (8, f"{_SMALL}-long", "bf16"), (9, "frontier", "bf16"),
]
_RUNS_SQL = "(values " + ", ".join(f"({k}, '{r}', '{f}')" for k, r, f in RUNS) + ") r(k, run, format)"
_OUT_SQL = f"select k, run, format, doc_id item_id, 'f' || j field, ((doc_id * 7 + j * 3 + k * 13 + quality * 5) % (9 + k)) > 1 correct from labels, (select unnest(range(5)) j), {_RUNS_SQL}"


def _runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "k int, run string, format string")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    fields = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")
    rows = table(spark, d, "labels").select("doc_id", "quality", fields).crossJoin(F.broadcast(_runs(spark)))  # ten runs
    at = (F.col("doc_id") * 7 + F.col("j") * 3 + F.col("k") * 13 + F.col("quality") * 5) % (9 + F.col("k"))
    return rows.select("k", "run", "format", F.col("doc_id").alias("item_id"), F.concat(F.lit("f"), F.col("j").cast("string")).alias("field"), (at > 1).alias("correct"))


def _boot(rows: str, by: str, resamples: int, seed: str, statistic: str) -> str:
    """SQL of portable_interval: rows has the columns by, o (order) and those of statistic."""
    same = " and ".join(f"a.{b} = b.{b}" for b in by.split(", "))
    cols = ", ".join(f"a.{b}" for b in by.split(", "))
    return f"""with v as materialized (select *, row_number() over (partition by {by} order by o) - 1 i, count(*) over (partition by {by}) n from ({rows})),
  d as materialized (select n, r, ('0x' || substr(md5('{seed}:' || r || ':' || i), 1, 8))::ubigint % n j from (select n, unnest(range(n)) i from (select distinct n from v)), (select unnest(range({resamples})) r)),
  m as (select {by}, r, {statistic} m from v join d on v.n = d.n and v.i = d.j group by {by}, r),
  e as (select {by}, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high from m group by {by}), p as (select {by}, count(*) n, {statistic} point from v group by {by})
  select {cols}, a.n, round(a.point, 6) point, round(b.low, 6) low, round(b.high, 6) high from p a join e b on {same}"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


_SCORES_SQL = f"select item_id o, avg(correct::int) v from ({_OUT_SQL}) where k = 0 group by 1"


@_query(_boot(f"select 'all' field, * from ({_SCORES_SQL}) union all select 'f1', item_id, correct::int::double from ({_OUT_SQL}) where k = 0 and field = 'f1'", "field", 10_000, "accuracy", "avg(v)"))
def accuracy_interval_by_filing(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all fields and over one, resampled by filing."""
    base = _outcomes(spark, d).where("k = 0")
    scores = [ev.accuracy_by_item(base, [], "item_id", f).withColumn("field", F.lit(f or "all")) for f in (None, "f1")]
    return _rounded(statistics.portable_bootstrap(scores[0].unionByName(scores[1]), ["field"], "item_id", "v", 10_000, "accuracy"), "point", "low", "high")


_DELTA_SQL = f"""select a.run, a.format, a.item_id o, avg(a.correct::int - b.correct::int) v from ({_OUT_SQL}) a join (select * from ({_OUT_SQL}) where format = 'bf16') b on a.run = b.run and a.item_id = b.item_id and a.field = b.field where a.format <> 'bf16' group by 1, 2, 3"""
_WORST_SQL = f"""select run, format, arg_min(field, (d, field)) worst_field, round(min(d), 6) worst_delta from (select a.run, a.format, a.field, avg(a.correct::int - b.correct::int) d from ({_OUT_SQL}) a
  join (select * from ({_OUT_SQL}) where format = 'bf16') b on a.run = b.run and a.item_id = b.item_id and a.field = b.field where a.format <> 'bf16' group by 1, 2, 3) group by 1, 2"""


@_query(f"""select r.run, r.format, list_position(['bf16', 'awq', 'gptq', 'gguf-q4_k_m', 'gguf-q8_0'], r.format)::int format_ord, n, point, low, high, low > -0.01 ships, worst_field, worst_delta
  from {_RUNS_SQL} left join ({_boot(_DELTA_SQL, 'run, format', 10_000, 'quantised', 'avg(v)')}) i on r.run = i.run and r.format = i.format left join ({_WORST_SQL}) w on r.run = w.run and r.format = w.format where r.format <> 'bf16'""")
def quantisation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """J13, J7, A9, A24, O6, A23's worst field: formats beside their reference, orphans with nulls."""
    return _rounded(ev.format_verdicts(_outcomes(spark, d), "run", "format", "item_id", 10_000, "quantised"), "point", "low", "high", "worst_delta")


_PAIRS = [(5, f"{_MAIN}-distill", _MAIN), (8, f"{_SMALL}-long", _SMALL)]
_PAIR_SQL = f"select a.run, b.run control, a.o, a.v - b.v v from (select run, item_id o, avg(correct::int) v from ({_OUT_SQL}) where k in (5, 8) group by 1, 2) a join (select run, item_id o, avg(correct::int) v from ({_OUT_SQL}) where k in (0, 3, 4, 7, 9) group by 1, 2) b on a.o = b.o and a.run like b.run || '-%'"


@_query(f"""select p.run, p.control, n, point, low, high from (values ('{_PAIRS[0][1]}', '{_PAIRS[0][2]}'), ('{_PAIRS[1][1]}', '{_PAIRS[1][2]}')) p(run, control)
  left join ({_boot(_PAIR_SQL, 'run, control', 10_000, 'ablation', 'avg(v)')}) i on p.run = i.run and p.control = i.control""")
def ablations_beside_control(spark: SparkSession, d: str) -> DataFrame:
    """Ablations beside the run that their name without the suffix names, which may be missing."""
    named = _runs(spark).where("format = 'bf16'").withColumn("control", ev.control_of(F.col("run")))
    pairs = named.where("control is not null").select("run", "control")
    return _rounded(ev.run_deltas(_outcomes(spark, d).where("format = 'bf16'"), "run", "item_id", pairs, 10_000, "ablation"), "point", "low", "high")


_NAMES = [r for _, r, _ in RUNS] + ["7b-r16-lr2e-4-nall-s0-e1", "7b-r16-lr2e-4-n500-s0-e1", "7b-r16-lr1e-4-nall-s1-e1", "x-r1"]
_RX = r"^([^-]+)-r(\d+)-lr([0-9.]+(?:e-?\d+)?)-n(\d+|all)-s(\d+)-e(\d+)(-.+)?$"


@_query(f"""select run, kind, control, case when inside then case changed when 0 then 'Base recipe' else case when rank <> '16' then 'Adapter rank' when rate <> '1e-4' then 'Learning rate' else 'Training filings' end end end varied,
  case when inside then case changed when 0 then 'rank 16, 1e-4, every filing' else case when rank <> '16' then rank when rate <> '1e-4' then rate else format('{{:,}}', volume::bigint) end end end as value from (
  select *, case when not ok then null when suffix <> '' then 'ablation' when volume <> 'all' then 'scaling' else 'main' end kind, case when suffix <> '' then left(run, length(run) - length(suffix)) end control,
  (rank <> '16')::int + (rate <> '1e-4')::int + (volume <> 'all')::int changed, ok and suffix = '' and seed = '0' and epochs = '1' and (rank <> '16')::int + (rate <> '1e-4')::int + (volume <> 'all')::int <= 1 inside from (
  select run, regexp_matches(run, '{_RX}') ok, regexp_extract(run, '{_RX}', 2) rank, regexp_extract(run, '{_RX}', 3) rate, regexp_extract(run, '{_RX}', 4) volume, regexp_extract(run, '{_RX}', 5) seed, regexp_extract(run, '{_RX}', 6) epochs, regexp_extract(run, '{_RX}', 7) suffix
  from (select distinct unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) run)))""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    """What a run's name says it is, and the one thing that it changes."""
    run = F.col("run")
    v = ev.sweep_variant(run)
    return spark.createDataFrame([(n,) for n in dict.fromkeys(_NAMES)], "run string").select("run", ev.run_class(run).alias("kind"), ev.control_of(run).alias("control"), v["varied"].alias("varied"), v["value"].alias("value"))


_SIDE_SQL = "select 'all' g, doc_id o, toxic::double v from labels where quality = {0}"


def _side_means(name: str, quality: int) -> str:
    return f"""{name}v as (select *, row_number() over (order by o) - 1 i, count(*) over () n from ({_SIDE_SQL.format(quality)})), {name}m as (select r, avg(v.v) m from (select r, i, ('0x' || substr(md5('gap-{name}:' || r || ':' || i), 1, 8))::ubigint % n j from {name}v, (select unnest(range(10000)) r)) x join {name}v v on v.i = x.j group by 1)"""


@_query(f"""with {_side_means('left', 1)}, {_side_means('right', 0)} select 'all' g, (select count(*) from labels where quality in (0, 1)) n, round((select avg(v) from leftv) - (select avg(v) from rightv), 6) point,
  round(quantile_cont(a.m - b.m, 0.025), 6) low, round(quantile_cont(a.m - b.m, 0.975), 6) high from leftm a join rightm b using (r)""")
def unpaired_delta_interval(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over different filings, each resampled on its own."""
    rows = table(spark, d, "labels").withColumn("g", F.lit("all"))
    a, b = rows.where("quality = 1"), rows.where("quality = 0")
    runs.require_disjoint(a, b, "doc_id")
    return _rounded(statistics.unpaired_interval(a, b, ["g"], "doc_id", "toxic", 10_000, "gap"), "point", "low", "high")


_TWO_SQL = f"select t.item_id o, count(*) filter (not t.correct)::double err, count(*) filter (not t.correct and not s.correct and t.item_id % 3 = s.item_id % 3)::double rep from (select * from ({_OUT_SQL}) where k = 9) t join (select * from ({_OUT_SQL}) where k = 5) s using (item_id, field) group by 1"


@_query(f"select n, point, low, high from ({_boot(f'select 1 g, * from ({_TWO_SQL})', 'g', 10_000, 'inherited', 'sum(rep) / greatest(sum(err), 1)')})")
def inherited_interval(spark: SparkSession, d: str) -> DataFrame:
    """The share of a teacher's errors that its student repeats, resampled by filing."""
    out = _outcomes(spark, d).withColumn("predicted", F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 3).cast("string")))
    found = ev.inherited_interval(out.where("k = 5"), out.where("k = 9"), "item_id", ["item_id", "field"], 10_000, "inherited")
    return _rounded(found, "point", "low", "high")


_LATENCY_SQL = "select quality, doc_id o, ((doc_id * 37) % 1009)::double v, toxic from labels"


@_query(f"""select quality, 'p50' statistic, n, point, low, high from ({_boot(_LATENCY_SQL, 'quality', 2_000, 'latency', 'quantile_disc(v, 0.5)')}) union all
  select quality, 'p99', n, point, low, high from ({_boot(_LATENCY_SQL, 'quality', 2_000, 'latency', 'quantile_disc(v, 0.99)')}) union all
  select quality, 'rate', n, point, low, high from ({_boot(_LATENCY_SQL, 'quality', 2_000, 'latency', 'avg(toxic)')})""")
def percentile_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles and a rate with bootstrap intervals."""
    rows = table(spark, d, "labels").select("quality", "doc_id", ((F.col("doc_id") * 37) % 1009).cast("double").alias("v"), "toxic")
    ranks = statistics.portable_quantiles(rows, ["quality"], "doc_id", "v", {"p50": 50, "p99": 99}, 2_000, "latency")
    rate = statistics.portable_bootstrap(rows, ["quality"], "doc_id", "toxic", 2_000, "latency").withColumn("statistic", F.lit("rate"))
    return _rounded(ranks.unionByName(rate).select("quality", "statistic", "n", "point", "low", "high"), "point", "low", "high")


@_query(_boot("select role, conv_id * 100 + turn o, length(text)::double v from conversations", "role", 2_000, "length", "avg(v)"))
def mean_interval_by_role(spark: SparkSession, d: str) -> DataFrame:
    """A16's mean by group."""
    rows = table(spark, d, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("o"), F.length("text").alias("v"))
    return _rounded(statistics.portable_bootstrap(rows, ["role"], "o", "v", 2_000, "length"), "point", "low", "high")


_CALL_SQL = """select user_id % 7 run, event_type <> 'error' ok, case when event_id % 9 > 0 then (event_id % 16) / 15.0 end accuracy, event_id % 16 = 15 exact, event_id % 11 > 0 parsed, user_id % 7 > 0 and event_id % 5 > 0 costed, event_id % 3 = 0 cached,
  value / 1000 cost_usd, case when event_id % 2 = 0 then 'list-' || (event_id % 3) end price_list, event_id % 400 input_tokens, event_id % 70 output_tokens, value latency_ms, case when event_id % 4 > 0 then value / 3 end ttft_ms from events"""
_SUM_SQL = f"""select run, count(*) filter (a) graded, count(*) filter (not a) failed, count(*) filter (cached) cached_calls, round(avg(accuracy) filter (a), 6) accuracy, round(avg(exact::int) filter (a), 6) exact, round(avg((not parsed)::int) filter (a), 6) unparseable,
  round(avg(cost_usd) filter (costed) * 1000, 6) usd_per_1000, count(*) filter (not costed) uncosted_calls, coalesce(array_to_string(list_sort(list(distinct price_list) filter (price_list is not null)), ', '), '') price_lists, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens,
  quantile_disc(latency_ms, 0.5) p50_ms, quantile_disc(latency_ms, 0.99) p99_ms, quantile_disc(ttft_ms, 0.5) ttft_p50_ms, round(coalesce(avg(cost_usd) filter (costed) * count(*) filter (a), 0), 6) spend
  from (select *, ok and accuracy is not null a from ({_CALL_SQL})) group by 1"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("run"), (F.col("event_type") != "error").alias("ok"), F.when(e % 9 > 0, (e % 16) / 15.0).alias("accuracy"), (e % 16 == 15).alias("exact"), (e % 11 > 0).alias("parsed"), ((F.col("user_id") % 7 > 0) & (e % 5 > 0)).alias("costed"),
        (e % 3 == 0).alias("cached"), (F.col("value") / 1000).alias("cost_usd"), F.when(e % 2 == 0, F.concat(F.lit("list-"), (e % 3).cast("string"))).alias("price_list"), (e % 400).alias("input_tokens"), (e % 70).alias("output_tokens"),
        F.col("value").alias("latency_ms"), F.when(e % 4 > 0, F.col("value") / 3).alias("ttft_ms"),
    )


@_query(_SUM_SQL)
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Everything that runs' calls say, by run."""
    return _rounded(ev.run_summaries(_calls(spark, d), ["run"]), "accuracy", "exact", "unparseable", "usd_per_1000", "spend")


@_query(f"select row_number() over (order by usd_per_1000 nulls last, run)::int place, run, usd_per_1000, accuracy from ({_SUM_SQL})")
def runs_cheapest_first(spark: SparkSession, d: str) -> DataFrame:
    """The runs of a report in order, uncosted ones last."""
    out = _rounded(ev.run_summaries(_calls(spark, d), ["run"]), "usd_per_1000", "accuracy")
    return ev.cheapest_first(out.select("run", "usd_per_1000", "accuracy"), "run", "usd_per_1000").select("place", "run", "usd_per_1000", "accuracy")


@_query(f"select (select run from ({_SUM_SQL}) where usd_per_1000 is not null order by usd_per_1000, run limit 1) cheapest, (select run from ({_SUM_SQL}) order by accuracy desc, run limit 1) best")
def report_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest costed run and the most accurate one."""
    return ev.anchors(_rounded(ev.run_summaries(_calls(spark, d), ["run"]), "usd_per_1000", "accuracy"), "run", "usd_per_1000", "accuracy")


@_query(f"select row_number() over (order by acc, field)::int place, field, round(acc, 6) accuracy from (select field, avg(correct::int) acc from ({_OUT_SQL}) where k = 0 group by 1)")
def fields_worst_first(spark: SparkSession, d: str) -> DataFrame:
    """Fields by accuracy, worst first, schema order among equals."""
    from pyspark.sql.window import Window

    report = runs.field_report(_outcomes(spark, d).where("k = 0").withColumn("reason", F.when(~F.col("correct"), "wrong_value")))
    return report.withColumn("place", F.row_number().over(Window.orderBy("accuracy", "field"))).select("place", "field", F.round("accuracy", 6).alias("accuracy"))


_LEVEL_SQL = """select 'r' || (s_suppkey % 20) run, (['bf16', 'awq', 'gguf-q4_k_m'])[(s_suppkey % 3 + 1)::int] format, 'gpu' || (s_suppkey % 2) gpu, s_suppkey, case when s_suppkey % 5 = 0 then 8 else 32 end concurrency, s_suppkey % 11 = 0 retried,
  case when s_suppkey % 13 > 0 then 0.5 + (s_suppkey % 17) / 4.0 end rps, case when s_suppkey % 13 > 0 then 0.4 + (s_suppkey % 17) / 4.0 end rps_low, case when s_suppkey % 13 > 0 then 0.7 + (s_suppkey % 17) / 4.0 end rps_high, 0.4 + (s_suppkey % 7) / 10.0 usd_per_hour from supplier"""
_ACC_SQL = "select 'r' || n run, f format, (n * 7 + length(f)) % 100 / 100.0::double accuracy from (select unnest(range(20)) n), (select unnest(['bf16', 'awq', 'gguf-q4_k_m']) f) where n % 6 > 0 or f <> 'bf16'"
_BE = "case when g <= c * 0.004 then 1 when c * 0.004 > g then greatest(1, ceil(0 / (c * 0.004 - g))) end"


@_query(f"""with l as ({_LEVEL_SQL}), m as (select *, usd_per_hour * 730.5 g, rps * 3600 * 730.5 * 0.5 c from l where concurrency = 32 and rps is not null and not retried), a as ({_ACC_SQL})
  select l.s_suppkey, l.run, l.format, l.gpu, round(m.usd_per_hour / (m.rps * 1800) * 1000, 6) usd_per_1000, round(m.usd_per_hour / (m.rps_high * 1800) * 1000, 6) usd_low, round(m.usd_per_hour / (m.rps_low * 1800) * 1000, 6) usd_high,
  round(greatest(({_BE}) * g / 0.004, (({_BE}) - 1) * c), 2) volume, a.accuracy, case when l.format <> 'bf16' then round(a.accuracy - b.accuracy, 6) end delta
  from l left join m using (s_suppkey) left join a on a.run = l.run and a.format = l.format left join (select * from a where format = 'bf16') b on b.run = l.run""")
def serving_table(spark: SparkSession, d: str) -> DataFrame:
    """Load tests beside their accuracy and their run's reference, with inverted cost intervals and break-even."""
    k = F.col("s_suppkey")
    forms = F.element_at(F.array(F.lit("bf16"), F.lit("awq"), F.lit("gguf-q4_k_m")), (k % 3 + 1).cast("int"))
    rate = lambda add: F.when(k % 13 > 0, add + (k % 17) / 4.0)
    levels = table(spark, d, "supplier").select(
        F.concat(F.lit("r"), (k % 20).cast("string")).alias("run"), forms.alias("format"), F.concat(F.lit("gpu"), (k % 2).cast("string"), F.lit("-"), k.cast("string")).alias("gpu"), k, F.when(k % 5 == 0, 8).otherwise(32).alias("concurrency"),
        (k % 11 == 0).alias("retried"), rate(F.lit(0.5)).alias("rps"), rate(F.lit(0.4)).alias("rps_low"), rate(F.lit(0.7)).alias("rps_high"), (0.4 + (k % 7) / 10.0).alias("usd_per_hour"),
    )
    names = spark.range(20).select(F.col("id").alias("n"), F.explode(F.array(F.lit("bf16"), F.lit("awq"), F.lit("gguf-q4_k_m"))).alias("format")).where("n % 6 > 0 or format <> 'bf16'")
    accuracies = names.select(F.concat(F.lit("r"), F.col("n").cast("string")).alias("run"), "format", ((F.col("n") * 7 + F.length("format")) % 100 / 100.0).alias("accuracy"))
    out = ev.serving_rows(levels.drop("s_suppkey"), levels.select("run", "format", "gpu", "s_suppkey"), accuracies, 0.004)
    out = out.withColumn("gpu", F.regexp_extract("gpu", "^(gpu[01])", 1))
    return out.select("s_suppkey", "run", "format", "gpu", *[F.round(c, 6).alias(c) for c in ("usd_per_1000", "usd_low", "usd_high")], F.round("volume", 2).alias("volume"), "accuracy", F.round("delta", 6).alias("delta"))


_SHEET_SQL = """select doc_id n, source split, case doc_id % 7 when 0 then '' when 1 then 'wrong' when 2 then ' Wrong ' else 'ok' end verdict, case when doc_id % 7 in (1, 2) then case when doc_id % 2 = 0 then 'revenue  net_income' else ' eps_basic' end else '' end wrong_fields from documents"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 7
    verdict = F.when(k == 0, "").when(k == 1, "wrong").when(k == 2, " Wrong ").otherwise("ok")
    fields = F.when(k.isin(1, 2), F.when(F.col("doc_id") % 2 == 0, "revenue  net_income").otherwise(" eps_basic")).otherwise("")
    return table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.col("source").alias("split"), verdict.alias("verdict"), fields.alias("wrong_fields"))


@_query(f"""select audited, pending, wrong, first_pending, round(p, 6) point, round(greatest(0, (p + z / (2 * audited)) / (1 + z / audited) - 1.959964 * sqrt(p * (1 - p) / audited + z / (4 * audited * audited)) / (1 + z / audited)), 6) low,
  round(least(1, (p + z / (2 * audited)) / (1 + z / audited) + 1.959964 * sqrt(p * (1 - p) / audited + z / (4 * audited * audited)) / (1 + z / audited)), 6) high from (select *, wrong / audited p, 1.959964::double * 1.959964 z from (
  select count(*) filter (trim(verdict) <> '') audited, count(*) filter (trim(verdict) = '') pending, count(*) filter (lower(trim(verdict)) = 'wrong') wrong, min(n) filter (trim(verdict) = '') first_pending from ({_SHEET_SQL})))""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """Progress and error rate of a verdict sheet."""
    return _rounded(ev.audit_report(_sheet(spark, d)), "point", "low", "high")


@_query(f"select f field, count(*) n from (select unnest(regexp_split_to_array(trim(wrong_fields), '\\s+')) f from ({_SHEET_SQL}) where lower(trim(verdict)) = 'wrong') group by 1")
def audit_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that wrong verdicts name."""
    return ev.audit_fields(_sheet(spark, d))


@_query(f"""select run, suite, items, correct, ungradeable_items, calls, latency_p50_ms, round(cost_usd, 6) cost_usd, uncosted_calls from (select run, field suite, count(*) items, count(*) filter (correct) correct from (select k::bigint run, field, correct from ({_OUT_SQL})) group by 1, 2)
  join (select run, count(*) filter (not ok) ungradeable_items, count(*) calls, quantile_disc(latency_ms, 0.5) filter (ok) latency_p50_ms, coalesce(sum(cost_usd) filter (costed), 0) cost_usd, count(*) filter (ok and not costed) uncosted_calls from ({_CALL_SQL}) group by 1) using (run)""")
def gate_sides(spark: SparkSession, d: str) -> DataFrame:
    """A suite per field of each side, with the counters of its calls."""
    out = _outcomes(spark, d).select(F.col("k").cast("bigint").alias("run"), "field", "correct")
    return _rounded(ev.gate_sides(out, _calls(spark, d), "run"), "cost_usd").select("run", "suite", "items", "correct", "ungradeable_items", "calls", "latency_p50_ms", "cost_usd", "uncosted_calls")


_EXAMPLES_SQL = "select doc_id item_id, case when doc_id % 4 = 0 then 'validation' else 'train' end split, source assistant from documents"


@_query(f"select item_id, split, case when split = 'train' then 'quality ' || quality else assistant end assistant from ({_EXAMPLES_SQL}) left join labels on doc_id = item_id where split <> 'train' or quality is not null")
def distilled_targets(spark: SparkSession, d: str) -> DataFrame:
    """Another run's answers as training targets."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train").alias("split"), F.col("source").alias("assistant"))
    answers = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"))
    return ev.distilled(docs, answers).select("item_id", "split", "assistant")


@_query("select count(*) n, round(avg((quality = toxic)::int), 6) agreement from labels")
def token_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two runs give the same token."""
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("agreement"))


@_query("""select p_partkey, steps, 1 + steps // 50 checkpoints, round(steps * 2.5 / 3600, 6) gpu_hours from (select p_partkey, (ceil(least(5154, coalesce(case when p_partkey % 3 > 0 then p_size * 100 end, 5154)) / (1 + p_partkey % 16)) * (1 + p_partkey % 2))::bigint steps from part)""")
def training_plan(spark: SparkSession, d: str) -> DataFrame:
    """Steps, checkpoints and GPU hours of recipes."""
    k = F.col("p_partkey")
    configs = table(spark, d, "part").select(k, F.when(k % 3 > 0, F.col("p_size") * 100).alias("volume"), (1 + k % 16).alias("batch"), (1 + k % 2).alias("epochs"), F.lit(50).alias("save_steps"))
    return ev.training_plan(configs, 5154, 2.5).select("p_partkey", "steps", "checkpoints", F.round("gpu_hours", 6).alias("gpu_hours"))


@_query("""select o_custkey, case when max(s) is not null then 'checkpoint-' || max(s) end latest, coalesce(max(s), 0)::bigint step from (select o_custkey, case when o_orderstatus = 'F' and o_orderkey % 5 > 0 then o_orderkey end s from orders) group by 1""")
def resume_steps(spark: SparkSession, d: str) -> DataFrame:
    """The newest complete checkpoint of each run."""
    name = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string"))).otherwise("final")
    return ev.resume_steps(table(spark, d, "orders").select("o_custkey", name.alias("name"), (F.col("o_orderstatus") == "F").alias("complete")), "o_custkey")


@_query("select l_orderkey, count(*) filter (l_linenumber % 3 > 0) n from lineitem group by 1")
def loss_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Labels that count towards the loss. An order's lines are at most seven."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber")).otherwise(-100)).alias("labels"))
    return rows.select("l_orderkey", ev.loss_tokens(F.col("labels")).cast("bigint").alias("n"))


@_query("""with t as (select user_id % 4 concurrency, epoch(ts) sent, event_type <> 'error' ok, 100 + event_id % 900 input_tokens, user_id % 50 output_tokens, value from events),
  m as (select concurrency, avg(input_tokens) mi, avg(output_tokens) mo from t join (select concurrency, min(sent) t0 from t group by 1) using (concurrency) where ok and sent >= t0 + 3600 group by 1)
  select concurrency, round(mi, 6) mean_input, round(mo, 6) mean_output, round(2.0 / (1.5 * 1800) * 0.25 / mi * 1e6, 6) input_rate, round(2.0 / (1.5 * 1800) * 0.75 / mo * 1e6, 6) output_rate from m""")
def overlay_prices(spark: SparkSession, d: str) -> DataFrame:
    """Mean tokens after the warm-up, and the rates that make a mean call cost its rent."""
    from ..functions import costing

    sent = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timing = table(spark, d, "events").select((F.col("user_id") % 4).alias("concurrency"), sent.alias("sent_at"), (F.col("event_type") != "error").alias("ok"), (100 + F.col("event_id") % 900).alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"))
    means = ev.mean_tokens(timing, ["concurrency"], 3600)
    rates = costing.per_million_rates(costing.usd_per_call(F.lit(2.0), F.lit(1.5), F.lit(0.5)), costing.prefill_share(F.lit(25.0), F.lit(100.0)), F.col("mean_input"), F.col("mean_output"))
    return means.select("concurrency", F.round("mean_input", 6).alias("mean_input"), F.round("mean_output", 6).alias("mean_output"), F.round(rates["input"], 6).alias("input_rate"), F.round(rates["output"], 6).alias("output_rate"))


@_query("""select conv_id, count(*) + count(*) filter (role = 'user') n_messages, max(length(text)) longest from conversations where role in ('user', 'assistant') group by 1""")
def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """JS5, F19: the chat messages of a prompt whose example turns are a conversation's user turns with an answer each."""
    said = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("r"), "text"))).alias("t"))  # a conversation's turns are few
    users = F.transform(F.filter("t", lambda x: x["r"] == "user"), lambda x: F.struct(x["text"].alias("user"), F.lit("ok").alias("assistant")))
    answers = F.transform(F.filter("t", lambda x: x["r"] == "assistant"), lambda x: F.struct(F.lit("assistant").alias("role"), x["text"].alias("content")))
    made = F.filter(ev.messages(F.lit("s"), users, F.lit("u")), lambda m: (m["role"] != "system") & ~((m["role"] == "user") & (m["content"] == "u")))
    every = F.concat(made, answers)
    return turns.select("conv_id", F.size(every).cast("bigint").alias("n_messages"), F.array_max(F.transform(every, lambda m: F.length(m["content"]))).cast("bigint").alias("longest"))


@_query("select field_ord::int field_ord, '  ' || field || ' (' || kind || ', or null)' line from (values " + ", ".join(f"({i}, '{f}', '{k}')" for i, f, k in [
    (0, "period_end", "string, YYYY-MM-DD"), (1, "fiscal_period", "one of FY, Q1, Q2, Q3, Q4"), (2, "revenue", "number"), (3, "cost_of_revenue", "number"), (4, "operating_income", "number"), (5, "net_income", "number"), (6, "eps_basic", "number"), (7, "eps_diluted", "number"),
    (8, "shares_diluted", "number"), (9, "total_assets", "number"), (10, "total_liabilities", "number"), (11, "cash_and_equivalents", "number"), (12, "stockholders_equity", "number"), (13, "auditor_name", "string"), (14, "state_of_incorporation", "string")]) + ") t(field_ord, field, kind)")
def prompt_schema(spark: SparkSession, d: str) -> DataFrame:
    """JS5: the fields as a prompt lists them."""
    from ..schema import FISCAL_PERIODS, field_dim

    return ev.schema_lines(field_dim(spark), {"fiscal_period": FISCAL_PERIODS})


@_query("""select role, volume, doc_id from (select role, volume, doc_id, row_number() over (partition by role order by md5(role || ':' || doc_id), doc_id) i from documents, (values ('monitor', 32), ('calibration', 128)) r(role, volume) where doc_id % 4 > 0) where i <= volume""")
def fixed_subsets(spark: SparkSession, d: str) -> DataFrame:
    """The monitor's and the calibration's rows, from training rows only, each by a seed of its own."""
    rows = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train"))
    train = splits.require_splits(rows.where("split = 'train'"), ["train"])
    parts = [splits.nested_volumes(train, "doc_id", [n], role).select(F.lit(role).alias("role"), F.col("volume").cast("int").alias("volume"), "doc_id") for role, n in (("monitor", 32), ("calibration", 128))]
    return parts[0].unionByName(parts[1])


def _percents(value: Column) -> list[Column]:
    return [text.percent(value).alias("pct"), text.signed_percent(value).alias("signed"), text.volume(value * 1e6).alias("thousands")]


@_query("select l_orderkey, l_linenumber, format('{:.1f}%', l_discount * 100) pct, format('{:+.1f}%', l_discount * 100) signed, format('{:,.0f}k', l_discount * 1000) thousands from lineitem")
def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Percentages and thousands as reports print them."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_percents(F.col("l_discount")))


@_query(f"""select row_number() over (order by size, list_position(['Base recipe', 'Adapter rank', 'Learning rate', 'Training filings'], varied), number)::int place, run, varied from (
  select run, regexp_extract(run, '{_RX}', 1) size, case when (rank <> '16')::int + (rate <> '1e-4')::int + (volume <> 'all')::int = 0 then 'Base recipe' when rank <> '16' then 'Adapter rank' when rate <> '1e-4' then 'Learning rate' else 'Training filings' end varied,
  case when rank <> '16' then rank::double when rate <> '1e-4' then rate::double when volume <> 'all' then volume::double else 0 end number from (
  select run, regexp_extract(run, '{_RX}', 2) rank, regexp_extract(run, '{_RX}', 3) rate, regexp_extract(run, '{_RX}', 4) volume from (select distinct unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) run)
  where regexp_matches(run, '{_RX}') and regexp_extract(run, '{_RX}', 7) = '' and regexp_extract(run, '{_RX}', 5) = '0' and regexp_extract(run, '{_RX}', 6) = '1') where (rank <> '16')::int + (rate <> '1e-4')::int + (volume <> 'all')::int <= 1)""")
def sweep_points(spark: SparkSession, d: str) -> DataFrame:
    """The runs of a sweep by size, factor and value."""
    from pyspark.sql.window import Window

    run = F.col("run")
    rows = spark.createDataFrame([(n,) for n in dict.fromkeys(_NAMES)], "run string").select("run", ev.run_parts(run)["size"].alias("size"), ev.sweep_variant(run).alias("v")).where("v.varied is not null")
    order = F.array_position(F.array(*[F.lit(x) for x in ("Base recipe", "Adapter rank", "Learning rate", "Training filings")]), F.col("v.varied"))
    number = F.when(F.col("v.varied") != "Base recipe", F.replace(F.col("v.value"), F.lit(","), F.lit("")).cast("double")).otherwise(0.0)
    return rows.select(F.row_number().over(Window.orderBy("size", order, number)).alias("place"), "run", F.col("v.varied").alias("varied"))


@_query("select 'base' factor, '7b-16-1e-4-all' run union all select 'rank', '7b-8-1e-4-all' union all select 'rank', '7b-64-1e-4-all' union all select 'rate', '7b-16-5e-5-all' union all select 'rate', '7b-16-2e-4-all' union all select 'volume', '7b-16-1e-4-1000' union all select 'volume', '7b-16-1e-4-2500'")
def one_factor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One factor at a time from a base recipe, which is there once."""
    from ..operators.reports import one_factor_sweep as sweep

    out = sweep({"size": "7b", "rank": "16", "rate": "1e-4", "volume": "all"}, {"rank": ["8", "16", "64"], "rate": ["5e-5", "1e-4", "2e-4"], "volume": ["1000", "2500", "all"]}, spark)
    return out.select("factor", F.concat_ws("-", "size", "rank", "rate", "volume").alias("run"))


@_query(f"select run, accuracy, usd_per_1000 from ({_SUM_SQL})")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    """The results as JSON lines, as a page reads them."""
    out = _rounded(ev.run_summaries(_calls(spark, d), ["run"]), "accuracy", "usd_per_1000")
    lines = out.select(F.to_json(F.struct("run", F.struct("accuracy", "usd_per_1000").alias("shares"))).alias("line"))
    return lines.select(F.from_json("line", "run bigint, shares struct<accuracy:double,usd_per_1000:double>").alias("r")).select("r.run", "r.shares.*")


@_query("select user_id % 4 concurrency, count(*) n from events group by 1")
def load_levels(spark: SparkSession, d: str) -> DataFrame:
    """A load record that is written anew after each level."""
    import uuid

    from ..sources.sinks import shared_dir, write_levels

    place = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("concurrency"), "event_id")
    for most in (1, 3):
        write_levels(rows.where(F.col("concurrency") <= most), place)
    return spark.read.schema("event_id bigint, concurrency bigint").json(place).groupBy("concurrency").agg(F.count("*").alias("n"))


@_query("select count(*) answered, count(distinct c_custkey) items from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run that stopped half way goes on with the items that its log lacks."""
    import uuid

    from ..operators.sampling import unanswered
    from ..sources.sinks import append_log, shared_dir

    place, schema = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", "c_custkey bigint, ok boolean, text string"
    items = table(spark, d, "customer").where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.col("c_custkey").cast("bigint").alias("c_custkey"))
    answer = lambda rows: rows.select("c_custkey", F.lit(True).alias("ok"), F.lit("x").alias("text"))
    append_log(answer(items.where("c_custkey % 2 = 0")), place)
    append_log(answer(unanswered(items, spark.read.schema(schema).json(place), "c_custkey")), place)
    log = spark.read.schema(schema).json(place)
    return log.agg(F.count("*").alias("answered"), F.countDistinct("c_custkey").alias("items"))


@_query(_boot(f"select 'n1000' volume, item_id o, avg(correct::int) v from ({_OUT_SQL}) where k in (3, 4) group by 2", "volume", 10_000, "scaling", "avg(v)"))
def scaling_interval(spark: SparkSession, d: str) -> DataFrame:
    """Each filing scored as the mean of the seeds on it, resampled by filing."""
    rows = ev.accuracy_by_item(_outcomes(spark, d).where("k in (3, 4)"), [], "item_id").withColumn("volume", F.lit("n1000"))
    return _rounded(statistics.portable_bootstrap(rows, ["volume"], "item_id", "v", 10_000, "scaling"), "point", "low", "high")


@_query(f"select place, line from (select 0 place, '| run | accuracy | usd |' line union all select 1, '|---|---|---|' union all select 1 + row_number() over (order by usd_per_1000 nulls last, run)::int, '| ' || run || ' | ' || format('{{:.1f}}%', accuracy * 100) || ' | ' || coalesce(format('{{:,.2f}}', usd_per_1000), 'not costed') || ' |' from ({_SUM_SQL}))")
def report_table(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a markdown table of runs, cheapest first."""
    from ..operators.reports import markdown_lines

    out = ev.cheapest_first(_rounded(ev.run_summaries(_calls(spark, d), ["run"]), "usd_per_1000", "accuracy"), "run", "usd_per_1000")
    shown = out.select("place", F.col("run").cast("string").alias("run"), text.percent(F.col("accuracy")).alias("accuracy"), F.when(F.col("usd_per_1000").isNotNull(), F.format_string("%,.2f", "usd_per_1000")).otherwise("not costed").alias("usd"))
    return markdown_lines(shown, "place", ["run", "accuracy", "usd"])
