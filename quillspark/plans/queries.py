"""Registered queries: each applies an operator to whole tables that stand in for its records, beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import costing, grading, hashing, statistics, text
from ..sources.sinks import shared_dir
from ..operators import facts, reports, runs, sampling, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BAND_SQL = "select o_custkey, median(o_totalprice) med from orders group by 1"
_STRATA_SQL = f"select o_custkey, case when med < 100000 then 'small' when med < 200000 then 'mid' else 'large' end stratum from ({_BAND_SQL})"
_POOL_SQL = f"""select stratum, o_custkey, case when i <= case when n >= 2 then greatest(round_even(n * 0.2, 0), 1) else round_even(n * 0.2, 0) end then 'test'
  when i <= case when n >= 2 then greatest(round_even(n * 0.2, 0), 1) else round_even(n * 0.2, 0) end + round_even(n * 0.1, 0) then 'validation' else 'train' end pool
  from (select stratum, o_custkey, row_number() over (partition by stratum order by md5('20270405:' || o_custkey), o_custkey) i, count(*) over (partition by stratum) n from ({_STRATA_SQL}))"""
_SPLIT_SQL = f"""select o.o_orderkey, o.o_custkey, case when pool = 'test' then case when o_orderdate > timestamp '1998-01-01' then 'test_post_cutoff' else 'test_pre_cutoff' end
  when o_orderdate <= timestamp '1998-01-01' then pool end split from orders o join ({_POOL_SQL}) p using (o_custkey)"""


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return splits.size_bands(table(spark, d, "orders"), "o_custkey", "o_totalprice", [100_000, 200_000], ["small", "mid", "large"])


def _pools(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_pools(_bands(spark, d).withColumnRenamed("band", "stratum"), "o_custkey", "stratum")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "orders"), _pools(spark, d), "o_custkey", "o_orderdate", "1998-01-01").select("o_orderkey", "o_custkey", "split")


@_query(f"select o_custkey, round(med, 3) median, case when med < 100000 then 'small' when med < 200000 then 'mid' else 'large' end band from ({_BAND_SQL})")
def size_band(spark: SparkSession, d: str) -> DataFrame:
    """A3, C20."""
    return _bands(spark, d).select("o_custkey", F.round("median", 3).alias("median"), "band")


@_query(_POOL_SQL)
def split_pools(spark: SparkSession, d: str) -> DataFrame:
    """W1."""
    return _pools(spark, d)


@_query(_SPLIT_SQL)
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    """P4."""
    return _assigned(spark, d)


@_query(f"""select s.split, coalesce(filings, 0) filings, coalesce(companies, 0) companies from (select unnest(['train', 'validation', 'test_pre_cutoff', 'test_post_cutoff', 'dropped_after_cutoff']) split) s
  left join (select coalesce(split, 'dropped_after_cutoff') split, count(*) filings, count(distinct o_custkey) companies from ({_SPLIT_SQL}) group by 1) c using (split)""")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return splits.split_report(_assigned(spark, d), "o_custkey")


@_query(f"select o_custkey, count(distinct case when split like 'test%' then 'test' else split end) pools from ({_SPLIT_SQL}) where split is not null group by 1 having count(distinct case when split like 'test%' then 'test' else split end) > 1")
def split_leak_check(spark: SparkSession, d: str) -> DataFrame:
    """U5, U6."""
    return splits.leaks(_assigned(spark, d), "o_custkey")


@_query("""select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from (select distinct o_custkey from orders) order by md5('select:' || o_custkey), o_custkey limit 50)""")
def select_companies_topn(spark: SparkSession, d: str) -> DataFrame:
    """W2, C19."""
    return splits.first_companies(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 50, "select")


@_query("""select v.volume, doc_id from (select doc_id, row_number() over (order by md5('train:' || doc_id), doc_id) i from documents) r join (select unnest([25, 50, 100]) volume) v on i <= v.volume""")
def nested_volume(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return splits.nested_volumes(table(spark, d, "documents"), "doc_id", [25, 50, 100], "train")


_TURN_SQL = "row_number() over (partition by lang, source order by md5('{0}:' || doc_id), doc_id)"


@_query(f"select lang, source, doc_id, turn from (select lang, source, doc_id, {_TURN_SQL.format('audit')}::int turn from documents) order by turn, lang, source limit 60")
def audit_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return sampling.round_robin(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 60, "audit")


@_query(f"""select lang, source, doc_id, n_chars, turn from (select lang, source, doc_id, n_chars, {_TURN_SQL.format('example')}::int turn from documents where n_chars <= (select median(n_chars) from documents)) order by turn, lang, source limit 4""")
def fewshot_pick(spark: SparkSession, d: str) -> DataFrame:
    """W4."""
    return sampling.few_shot(table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "doc_id", "n_chars", 4, "example")


@_query("select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) i from lineitem) where i = 1")
def index_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """W17."""
    return sampling.first_seen(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", ["l_orderkey", "l_linenumber"])


_LATEST_SQL = "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type, min(event_id) first_seen from events group by 1"


@_query(_LATEST_SQL)
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """W5, S10."""
    return sampling.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("text"))


@_query("select c_custkey from customer where c_custkey not in (select user_id from events where event_type <> 'error')")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """J17, U2."""
    return sampling.unanswered(table(spark, d, "customer").select("c_custkey"), _log(spark, d), "c_custkey")


@_query("select event_id, user_id c_custkey, (select count(*) from events where user_id not in (select c_custkey from customer where c_custkey % 3 > 0)) set_aside from events where user_id in (select c_custkey from customer where c_custkey % 3 > 0)")
def set_aside(spark: SparkSession, d: str) -> DataFrame:
    """J5, J4."""
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    inside, aside = sampling.set_aside(log, table(spark, d, "customer").where("c_custkey % 3 > 0"), "c_custkey")
    return inside.withColumn("set_aside", F.lit(aside).cast("long")).select("event_id", "c_custkey", "set_aside")


_CONCEPTS = ["NO", "AF", "RF"]
_FACT_SQL = """select l_orderkey accession, l_linenumber ordinal, ci concept_ord, l_extendedprice num_value, ends, days, abs(days - 91) near, abs(date_diff('day', pe, ends)) off, filed,
  abs(date_diff('day', pe, ends)) <= 7 and days between 60 and 120 matched
  from (select l.*, list_position(['NO', 'AF', 'RF'], l_returnflag || l_linestatus) - 1 ci, l_shipdate::date ends, (l_quantity * 3)::int as days, l_shipdate::date + (l_partkey % 5)::int filed, o_orderdate::date + 60 pe
  from lineitem l join orders on o_orderkey = l_orderkey) where ci is not null"""
_CHOSEN_SQL = f"""with f as ({_FACT_SQL}), w as (select *, min(case when matched then concept_ord end) over (partition by accession) won,
  row_number() over (partition by accession, concept_ord, matched order by near, off, filed, ordinal, num_value) place from f),
  c as (select *, coalesce(matched and concept_ord = won and place = 1, false) chosen from w where won is null or concept_ord <= won),
  r as (select *, row_number() over (partition by accession, chosen order by case when concept_ord = won then 0 else 1 end, concept_ord, ordinal, num_value) k from c)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    end = F.to_date("l_shipdate")
    fact = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("ordinal"), F.concat("l_returnflag", "l_linestatus").alias("concept"), F.col("l_extendedprice").alias("num_value"), F.lit(None).cast("string").alias("str_value"),
        F.date_sub(end, (F.col("l_quantity") * 3).cast("int")).alias("start"), end.alias("end"), F.col("l_orderkey").alias("accession"), F.date_add(end, (F.col("l_partkey") % 5).cast("int")).alias("filed"),
    )
    reports_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.date_add(F.to_date("o_orderdate"), 60).alias("period_end"), F.lit("Q1").alias("fiscal_period"))
    dim = spark.createDataFrame([(0, "price", "share_count", _CONCEPTS)], "field_ord int, field string, kind string, concepts array<string>")
    return facts.candidates(fact, reports_, dim)


@_query(f"{_CHOSEN_SQL} select accession, ordinal, round(num_value, 2) num_value from r where chosen")
def fact_select(spark: SparkSession, d: str) -> DataFrame:
    """W6, W7, J18, F3, F4, J1."""
    return facts.select_facts(_found(spark, d)).where("ordinal is not null").select("accession", "ordinal", F.round("num_value", 2).alias("num_value"))


@_query(f"{_CHOSEN_SQL} select accession, count(*) n_others, round(sum(num_value), 2) total from r where not chosen and k <= 4 group by 1")
def fact_distractors(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    values = F.transform("others", lambda o: o["num"])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return facts.select_facts(_found(spark, d)).where(F.size("others") > 0).select("accession", F.size("others").cast("long").alias("n_others"), F.round(total, 2).alias("total"))


@_query(f"with f as ({_FACT_SQL}) select accession, concept_ord::int concept_ord, ordinal from (select *, row_number() over (partition by accession, concept_ord order by near, off, filed, ordinal, num_value) i from f where matched) where i = 1")
def fact_period_matches(spark: SparkSession, d: str) -> DataFrame:
    """J20."""
    return facts.period_matches(_found(spark, d)).select("accession", F.col("concept_ord").cast("int").alias("concept_ord"), "ordinal")


_KIND_SQL = "case l_linenumber % 3 when 0 then 'per_share' when 1 then 'monetary' else 'share_count' end"
_READ_SQL = f"""select l_orderkey, l_linenumber, {_KIND_SQL} kind, case when l_linenumber = 6 then null else t end t, share,
  case l_linenumber when 1 then t when 2 then -t when 3 then t + 0.004 when 4 then t * 1000 when 5 then null when 6 then t else t * 1.21 end p, [t * 1.2, t * 1.004] others
  from (select *, l_extendedprice t, case when l_orderkey % 2 = 0 then 100.0 end share from lineitem)"""
_GRADE_SQL = f"""select l_orderkey, l_linenumber, case when t is null and p is null then 'correct' when p is null then 'missing' when t is null then 'hallucinated'
  when abs(p - t) <= allowed and len(list_filter(others, lambda d: round_even(d / unit, 0) <> round_even(t / unit, 0) and abs(p - d) < abs(p - t))) > 0 then 'wrong_period'
  when abs(p - t) <= allowed then 'correct' when len(list_filter(others, lambda d: abs(p - d) <= allowed)) > 0 then 'wrong_period'
  when t <> 0 and abs(p + t) <= allowed then 'sign'
  when t <> 0 and len(list_filter([1e-9, 1e-6, 1e-3, 1e-2, 1e-1, 1e1, 1e2, 1e3, 1e6, 1e9], lambda r: abs(p / t - r) <= 0.01 * r)) > 0 then 'scale' else 'wrong_value' end reason
  from (select *, case kind when 'per_share' then 0.01 when 'share_count' then coalesce(share, 1000.0) else 1000.0 end unit,
  case when kind = 'per_share' then 0.005 else greatest(0.005 * abs(t), case kind when 'share_count' then coalesce(share, 1000.0) else 1000.0 end / 2) end allowed from ({_READ_SQL}))"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("l_extendedprice"), F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "per_share").when(n % 3 == 1, "monetary").otherwise("share_count")
    p = F.when(n == 1, t).when(n == 2, -t).when(n == 3, t + 0.004).when(n == 4, t * 1000).when(n == 5, F.lit(None)).when(n == 6, t).otherwise(t * 1.21)
    share = F.when(F.col("l_orderkey") % 2 == 0, F.lit(100.0))
    truth = F.when(n != 6, t)
    reason = grading.grade_number(kind, p, truth, F.lit(1000.0), share, F.array(t * 1.2, t * 1.004))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    miss = F.when(F.col("reason") != "correct", F.col("reason"))
    return _graded(spark, d).select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), miss.isNull().alias("correct"), miss.alias("reason"))


@_query(_GRADE_SQL)
def grade_numeric(spark: SparkSession, d: str) -> DataFrame:
    """G1 to G6."""
    return _graded(spark, d)


@_query(f"select 'f' || l_linenumber field, reason, count(*) n from ({_GRADE_SQL}) where reason <> 'correct' group by 1, 2")
def grade_miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return runs.field_report(_outcomes(spark, d)).select("field", F.explode("misses").alias("reason", "n"))


@_query(f"""select r.reason_ord, r.reason, coalesce(n, 0) n, round(coalesce(n, 0) * 1000 / (select count(*) from lineitem), 6) per_1000 from
  (select unnest(range(7))::int reason_ord, unnest(['missing', 'hallucinated', 'wrong_period', 'sign', 'scale', 'malformed', 'wrong_value']) reason) r
  left join (select reason, count(*) n from ({_GRADE_SQL}) group by 1) g using (reason)""")
def failure_per_1000(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    return runs.failure_table(_outcomes(spark, d)).withColumn("per_1000", F.round("per_1000", 6))


@_query(f"select l_orderkey, round(avg((reason = 'correct')::int), 6) accuracy, bool_and(reason = 'correct') exact, count(*) filter (reason = 'correct') n_correct from ({_GRADE_SQL}) group by 1")
def item_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A6, G7."""
    return runs.item_scores(_outcomes(spark, d), ["l_orderkey"]).select("l_orderkey", F.round("accuracy", 6).alias("accuracy"), "exact", "n_correct")


_NAME_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({0})), ' and ', ' & '), '[.''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}_&]+', ' ', 'g')"


@_query("""select p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(trim(v)), ' and ', ' & '), '[.''’]', '', 'g'), '[^\\p{L}\\p{N}_&]+', ' ', 'g')), '(?:(?:^| )(?:llp|llc|lp|pc|pllc|inc|ltd|plc|sc|ag|gmbh))+$', '')) folded
  from (select p_partkey, p_name || ' and ' || p_brand || case p_partkey % 4 when 0 then ', L.L.P.' when 1 then ' Inc' when 2 then '''s Co. LLC PLC' else '' end v from part)""")
def normalise_name(spark: SparkSession, d: str) -> DataFrame:
    """G8."""
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, ", L.L.P.").when(k == 1, " Inc").when(k == 2, "'s Co. LLC PLC").otherwise("")
    return table(spark, d, "part").select("p_partkey", grading.normalise_name(F.concat("p_name", F.lit(" and "), "p_brand", tail)).alias("folded"))


@_query("select l.doc_id, quality - toxic delta from labels l")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """J6, J7, A9."""
    labels = table(spark, d, "labels")
    return runs.paired_differences(labels.select("doc_id", "quality"), labels.select("doc_id", F.col("toxic").alias("quality")), ["doc_id"], "quality")


_BOOT_SQL = """with v as (select g, i, n, v from (select g, v, row_number() over (partition by g order by k) - 1 i, count(*) over (partition by g) n from ({0}))),
  d as (select v.g, r, ('0x' || substr(md5('{1}:' || r || ':' || i), 1, 8))::ubigint % n j from v, (select unnest(range({2})) r)),
  m as (select d.g, r, avg(v.v) m from d join v on v.g = d.g and v.i = d.j group by 1, 2)
  select {3}, n, round(point, 6) point, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m join (select g, count(*) n, avg(v) point from v group by 1) using (g) group by all"""


@_query(_BOOT_SQL.format("select 'all' g, doc_id k, (quality - toxic)::double v from labels", "delta", 10_000, "g"))
def paired_delta_interval(spark: SparkSession, d: str) -> DataFrame:
    """A7, A8, A9 with portable draws."""
    rows = table(spark, d, "labels").select(F.lit("all").alias("g"), "doc_id", (F.col("quality") - F.col("toxic")).alias("v"))
    return statistics.portable_bootstrap(rows, ["g"], "doc_id", "v", 10_000, "delta").select("g", "n", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")])


@_query()
def mean_interval_numpy(spark: SparkSession, d: str) -> DataFrame:
    """A7 with numpy's generator, which SQL can't draw from; tests hold it against numpy."""
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    return statistics.numpy_bootstrap(rows, ["event_type"], "event_id", "value", 10_000)


@_query("""select count(*) teacher_errors, count(*) filter (toxic = 1 and quality = 0) repeated, round(count(*) filter (toxic = 1 and quality = 0) / greatest(count(*), 1), 6) share from labels where quality = 0""")
def inherited_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of inherited errors."""
    labels = table(spark, d, "labels")
    teacher = labels.select("doc_id", (F.col("quality") == 1).alias("correct"), F.lit("x").alias("predicted"))
    student = labels.select("doc_id", (F.col("toxic") == 0).alias("correct"), F.when(F.col("toxic") == 1, "x").alias("predicted"))
    return runs.inherited_errors(student, teacher, ["doc_id"]).withColumn("share", F.round("share", 6))


@_query("""select quality, n, round(p, 6) point, round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) low,
  round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) high
  from (select quality, count(*) n, avg(toxic) p, 1.959964::double * 1.959964 z2 from labels group by 1)""")
def wilson_rate(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    out = table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    w = statistics.wilson(F.col("k"), F.col("n"))
    return out.withColumn("w", w).select("quality", "n", *[F.round(f"w.{c}", 6).alias(c) for c in ("point", "low", "high")])


@_query("select event_type, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.99) p99, quantile_disc(value, 0.01) p1 from events group by 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return table(spark, d, "events").groupBy("event_type").agg(*[statistics.nearest_rank("value", p).alias(f"p{p}") for p in (50, 99, 1)])


_TIMING_SQL = "select user_id % 4 concurrency, epoch(ts) sent, epoch(ts) + value / 1000 first_at, epoch(ts) + value / 100 done, event_type <> 'error' ok, (user_id % 50) tok from events"


@_query(f"""with t as ({_TIMING_SQL}), k as (select t.* from t join (select concurrency, min(sent) t0 from t group by 1) using (concurrency) where sent >= t0 + 3600)
  select concurrency, count(*) requests, count(*) filter (not ok) errors, round(max(done) - min(sent), 3) window_s, round(count(*) filter (ok) / (max(done) - min(sent)), 9) requests_per_second,
  round(sum(case when ok then tok end) / (max(done) - min(sent)), 6) tokens_per_second, round(quantile_disc(case when ok then (first_at - sent) * 1000 end, 0.5), 1) ttft_p50_ms, round(quantile_disc(case when ok then (first_at - sent) * 1000 end, 0.99), 1) ttft_p99_ms,
  round(quantile_disc(case when ok then (done - sent) * 1000 end, 0.5), 1) e2e_p50_ms, round(quantile_disc(case when ok then (done - sent) * 1000 end, 0.99), 1) e2e_p99_ms from k group by 1""")
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    """A17, F16."""
    sent = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timing = table(spark, d, "events").select(
        (F.col("user_id") % 4).alias("concurrency"), sent.alias("sent_at"), (sent + F.col("value") / 1000).alias("first_token_at"), (sent + F.col("value") / 100).alias("done_at"),
        (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 50).alias("output_tokens"),
    )
    places = {"window_s": 3, "requests_per_second": 9, "tokens_per_second": 6} | dict.fromkeys(["ttft_p50_ms", "ttft_p99_ms", "e2e_p50_ms", "e2e_p99_ms"], 1)
    out = runs.load_summary(timing, ["concurrency"], 3600)
    return out.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in out.columns])


_BE_SQL = """select p_partkey, u, case when g + f <= c * a then 1 when c * a > g then greatest(1, ceil(f / (c * a - g))) end::bigint k, g, f, c, a
  from (select p_partkey, u, 730.5 * (0.2 + p_size / 25.0) g, 250.0 * (p_partkey % 3) f, 0.05 * (1 + p_partkey % 40) * 3600 * 730.5 * u c, p_retailprice / 1e6 a from part, (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]::double[]) u))"""


@_query(f"""select p_partkey, u utilisation, k gpus, round(greatest((k * g + f) / a, (k - 1) * c), 2) volume from ({_BE_SQL})""")
def break_even_curve(spark: SparkSession, d: str) -> DataFrame:
    """J22, C21 to C23."""
    part = table(spark, d, "part").crossJoin(F.broadcast(spark.createDataFrame([(u,) for u in (0.1, 0.3, 0.5, 0.7, 0.9)], "utilisation double")))
    be = costing.break_even(0.2 + F.col("p_size") / 25.0, 0.05 * (1 + F.col("p_partkey") % 40), F.col("p_retailprice") / 1e6, 250.0 * (F.col("p_partkey") % 3), F.col("utilisation"))
    return part.select("p_partkey", "utilisation", be.alias("b")).select("p_partkey", "utilisation", "b.gpus", F.round("b.volume", 2).alias("volume"))


@_query("""select p_partkey, round(greatest(1, ceil(p_retailprice * 1000 / (0.5 * 3600 * 730.5 * 0.5))) * 0.49 * 730.5 + 100, 4) monthly, round(0.49 / (0.5 * 3600 * 0.5) * 1000, 6) per_1000 from part""")
def monthly_staircase(spark: SparkSession, d: str) -> DataFrame:
    """C22, C21."""
    per_month = costing.capacity(F.lit(0.5), F.lit(0.5))
    monthly = costing.staircase(F.col("p_retailprice") * 1000, F.lit(0.49), per_month, F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", F.round(monthly, 4).alias("monthly"), F.round(costing.usd_per_call(F.lit(0.49), F.lit(0.5), F.lit(0.5)) * 1000, 6).alias("per_1000"))


@_query("""select s_suppkey, round(per_call, 9) per_call, round(per_call * share / mi * 1e6, 6) input, round(per_call * (1 - share) / mo * 1e6, 6) output, round(per_call, 9) mean_call
  from (select s_suppkey, (1 + s_suppkey % 5) / (2.0 * 3600 * 0.5) per_call, least(1, 0.1 + (s_suppkey % 11) / 10.0) share, 1000 + s_suppkey mi, 50 + s_suppkey % 7 mo from supplier)""")
def overlay_rates(spark: SparkSession, d: str) -> DataFrame:
    """C24, P9."""
    k = F.col("s_suppkey")
    per_call = costing.usd_per_call(1.0 + k % 5, F.lit(2.0), F.lit(0.5))
    share = costing.prefill_share(0.1 + (k % 11) / 10.0, F.lit(1.0))
    rates = costing.per_million_rates(per_call, share, 1000 + k, 50 + k % 7)
    return table(spark, d, "supplier").select("s_suppkey", F.round(per_call, 9).alias("per_call"), F.round(rates["input"], 6).alias("input"), F.round(rates["output"], 6).alias("output"), F.round(costing.call_cost(rates, 1000 + k, 50 + k % 7), 9).alias("mean_call"))


@_query("""select p_brand, p_partkey, p_retailprice, p_size from part p where not exists (select 1 from part q where q.p_brand = p.p_brand and q.p_retailprice <= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice < p.p_retailprice or q.p_size > p.p_size))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """J14, O8."""
    return reports.pareto_front(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", "p_size")


_SEEDS = [f"s{i}" for i in range(1, 8)]


@_query(f"""select w.*, round(mean, 6) mean from (select l_returnflag, {", ".join(f"round(avg(l_discount) filter (l_linenumber = {i}), 6) s{i}" for i in range(1, 8))} from lineitem group by 1) w
  join (select l_returnflag, avg(m) mean from (select l_returnflag, l_orderkey, avg(l_discount) m from lineitem group by 1, 2) group by 1) using (l_returnflag)""")
def scaling_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Every seed's mean, and the mean over items of each item's mean over seeds."""
    rows = table(spark, d, "lineitem").withColumn("seed", F.concat(F.lit("s"), F.col("l_linenumber").cast("string")))
    out = reports.seed_means(rows, ["l_returnflag"], "l_orderkey", "seed", "l_discount", _SEEDS)
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in (*_SEEDS, "mean")])


@_query("""select unnest(['value', 'props', 'late']) field, unnest([count(value), count(props), count(case when value > 20 then 1 end)]) filled, count(*) n from events""")
def coverage_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return reports.coverage(table(spark, d, "events").select("value", "props", F.when(F.col("value") > 20, 1).alias("late")), ["value", "props", "late"])


@_query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') "F", count(*) filter (o_orderstatus = 'O') "O", count(*) filter (o_orderstatus = 'P') "P" from orders group by 1""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    return reports.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@_query("""select case when event_type = 'view' then 'kept' when value < 10 then event_type else event_type || ':' || (user_id % 3) end key, count(*) n from events group by 1""")
def tally(spark: SparkSession, d: str) -> DataFrame:
    """A1, O5."""
    detail = F.when(F.col("value") >= 10, (F.col("user_id") % 3).cast("string"))
    return reports.tally(table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason"), detail.alias("detail")), "reason", "detail")


@_query("""select lang, quantile_disc(n_chars, 0.5) nearest, median(n_chars) interpolated, round(quantile_cont(n_chars, 0.95), 4) linear95, list_sort(list(n_chars))[(count(*) // 2 + 1)::bigint] upper, list_sort(list(n_chars))[(floor(count(*) * 0.95) + 1)::bigint] indexed95 from documents group by 1""")
def quantile_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Five quantiles that aren't the same. The last reads a value by its count below, over distinct values."""
    docs = table(spark, d, "documents")
    counts = docs.groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy("n_chars"))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(Window.partitionBy("lang")))
    indexed = ranked.where(F.col("upto") > F.floor(F.col("n") * F.lit(0.95))).groupBy("lang").agg(F.min("n_chars").alias("indexed95"))
    out = docs.groupBy("lang").agg(statistics.nearest_rank("n_chars", 50).alias("nearest"), F.expr("percentile(n_chars, 0.5)").alias("interpolated"), F.round(F.expr("percentile(n_chars, 0.95)"), 4).alias("linear95"), statistics.upper_median("n_chars").alias("upper"))
    return out.select("lang", F.col("nearest").cast("long").alias("nearest"), "interpolated", "linear95", F.col("upper").cast("long").alias("upper")).join(indexed, "lang")


@_query("""select conv_id, count(*) turns, max(case when role = 'system' then text end) system, arg_min(text, turn) filter (role = 'user') user_text, arg_max(text, turn) filter (role = 'assistant') assistant from conversations group by 1""")
def chat_examples(spark: SparkSession, d: str) -> DataFrame:
    """F19."""
    said = lambda role: F.when(F.col("role") == role, F.col("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system"), F.min_by("text", said("user")).alias("user_text"), F.max_by("text", said("assistant")).alias("assistant")
    )


@_query("""select event_type, count(*) calls, sum((props::json->>'k')::bigint)::bigint tokens, round(sum(case when event_type = 'error' then value else (props::json->>'k')::bigint * 0.25 + 2 end), 2) usd from events group by 1""")
def recost(spark: SparkSession, d: str) -> DataFrame:
    """JS4, J15: nested JSON priced anew; without a rate the recorded cost stays."""
    rates = spark.createDataFrame([(t, 0.25, 2.0) for t in ("click", "view", "purchase", "signup")], "event_type string, rate double, base double")
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"]).join(F.broadcast(rates), "event_type", "left")
    usd = F.coalesce(F.col("k") * F.col("rate") + F.col("base"), F.col("value"))
    return rows.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum(usd), 2).alias("usd"))


@_query("""select doc_id, len(v) n_numbers, coalesce(list_max(list_transform(v, lambda s: replace(s, ',', '')::double)), 0) largest from (select doc_id, regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?') v from documents)""")
def printed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """C2 over whole texts; the dash rule, which needs a lookahead, has its written examples."""
    found = F.regexp_extract_all("text", F.lit(text.NUMBER), F.lit(0))
    values = F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).cast("double"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.coalesce(F.array_max(values), F.lit(0.0)).alias("largest"))


@_query("""select p_brand, arg_min(p_name, (p_retailprice, p_partkey)) cheapest, arg_min(p_name, (-p_size, p_partkey)) best from part group by 1""")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """A23 by group."""
    return reports.extremes(table(spark, d, "part"), ["p_brand"], "p_name", "p_retailprice", "p_size", "p_partkey")


@_query("""select v.l_returnflag, v.l_linestatus, round(v.m, 6) m, round(c.m, 6) control_value, round(v.m - c.m, 6) delta from (select l_returnflag, l_linestatus, avg(l_quantity) m from lineitem group by 1, 2) v
  left join (select l_returnflag, avg(l_quantity) m from lineitem where l_linestatus = 'F' group by 1) c using (l_returnflag) where v.l_linestatus <> 'F'""")
def variants_beside_control(spark: SparkSession, d: str) -> DataFrame:
    """A variant beside the control of the same key."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    out = reports.beside(rows, "l_linestatus", "F", ["l_returnflag"], "m")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("m", "control_value", "delta")])


@_query("select source, count(*) n, count(*) filter (n_chars > 5000) above, round(avg((n_chars > 5000)::int), 6) share from documents group by 1")
def truncation_share(spark: SparkSession, d: str) -> DataFrame:
    """F18, C39."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 5000).alias("above"), F.round(F.avg((F.col("n_chars") > 5000).cast("double")), 6).alias("share"))


@_query("select o_custkey from (select o_custkey, count(distinct o_orderpriority) k from orders group by 1) where k = (select count(distinct o_orderpriority) from orders)")
def complete_runs(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    orders = table(spark, d, "orders")
    return runs.complete_runs(orders, orders.select("o_orderpriority").distinct(), "o_custkey", "o_orderpriority")


@_query("select o_orderkey, lower(sha256(o_comment)) digest, substr(lower(sha256(o_comment)), 1, 32) key from (select o_orderkey, o_orderpriority || ':' || o_orderkey o_comment from orders)")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """C17."""
    body = F.concat_ws(":", "o_orderpriority", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.sha2(body, 256).alias("digest"), hashing.cache_key(body).alias("key"))


@_query()
def company_fraction(spark: SparkSession, d: str) -> DataFrame:
    """blake2b, which SQL lacks; tests hold it against hashlib."""
    return table(spark, d, "customer").select("c_custkey", hashing.blake2b_fraction(20270405, F.col("c_custkey")).alias("fraction"))


@_query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SQL has no HTML parser; tests hold it against small pages."""
    from ..sources.markup import blocks

    return blocks(table(spark, d, "pages").select("page_id", "html")).select("page_id", "idx", F.coalesce("text", F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")).alias("shown"))


@_query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def stream_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Latest wins (W5) with the event log as a file stream, run to its end."""
    import uuid

    from ..streaming import logs

    base = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    logs.latest_by_key(logs.read_log(spark, d, schema, names="events.parquet"), "user_id", "event_id", f"{base}/out", f"{base}/state", f"latest_{uuid.uuid4().hex}")
    return logs.read_latest(spark, f"{base}/out").select("user_id", "event_id", "event_type")


@_query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows, batch or stream."""
    from ..streaming import logs

    events = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = logs.windowed(events, "t", ["event_type"], "value", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@_query("select doc_id, line_no, section, offs as \"offset\" from (select doc_id, line_no, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint offs, last_value(nullif(regexp_extract(line, '^([A-Z]{3,})', 1), '') ignore nulls) over (partition by doc_id order by line_no) section from (select doc_id, unnest(range(len(l)))::int line_no, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents)))")
def lines_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    from ..operators.statements import lines_with_sections

    out = lines_with_sections(table(spark, d, "documents"), "doc_id", "text", "^([A-Z]{3,})")
    return out.select("doc_id", "line_no", "section", F.col("offset").cast("long").alias("offset"))


@_query("select s_suppkey, (regexp_extract(v, '^(.+?)-(gguf-q4_k_m|gguf-q8_0|bf16|awq)$', 1)) run, regexp_extract(v, '^(.+?)-(gguf-q4_k_m|gguf-q8_0|bf16|awq)$', 2) format from (select s_suppkey, s_suppkey % 7 || 'b-r64-s' || s_suppkey || '-' || (['bf16', 'gguf-q4_k_m', 'awq'])[(s_suppkey % 3 + 1)::int] v from supplier)")
def served_names(spark: SparkSession, d: str) -> DataFrame:
    """C27, F14."""
    forms = F.element_at(F.array(F.lit("bf16"), F.lit("gguf-q4_k_m"), F.lit("awq")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    name = text.served_name(F.concat((F.col("s_suppkey") % 7).cast("string"), F.lit("b-r64-s"), F.col("s_suppkey").cast("string")), forms)
    parsed = text.parse_served_name(name, ["bf16", "awq", "gguf-q4_k_m", "gguf-q8_0"])
    return table(spark, d, "supplier").select("s_suppkey", parsed.alias("p")).select("s_suppkey", "p.run", "p.format")
