"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op6_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import score

    return score(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages")).drop("html")


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "personal_data")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: op4 in full, for tables whose document ids are unique.
OP4_SQL = f"""with d as (select doc_id, {_WORDS} w from documents), b as (select item_id::varchar item_id, {_WORDS} w from benchmark),
  bw as (select item_id, w, least(13, len(w)) k, unnest(range(len(w) - least(13, len(w)) + 1)) i from b where len(w) > 0),
  bk as (select distinct item_id, k, array_to_string(w[i + 1:i + k], ' ') s from bw), ks as (select distinct k from bk),
  dw as (select doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') s from (select doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) i from d, ks)),
  h as (select distinct doc_id, i, k from dw semi join bk using (k, s)), n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from h) group by 1),
  it as (select doc_id, list_sort(list(distinct item_id)) l from dw join bk using (k, s) group by 1)
  select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(l), 0)::bigint n_items, sha256(coalesce(array_to_string(l, ','), '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join n using (doc_id) left join it using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL}
