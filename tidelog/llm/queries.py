"""One query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import quality, url_filter
from tidelog.llm.decontamination import contaminated
from tidelog.llm.ngram_join import ngram_components
from tidelog.llm.packing import best_fit
from tidelog.llm.quality import host_quality
from tidelog.llm.recurrent_lm import lm_scores
from tidelog.llm.sstable import token_ids
from tidelog.llm.substring_dedup import substring_dedup
from tidelog.llm.suffix_dedup import suffix_dedup
from tidelog.llm.toxicity import toxicity
from tidelog.llm.url_filter import QUERY_RULES, url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), spark.createDataFrame(QUERY_RULES, "host string, path string, verdict string"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(_table(spark, sf_dir, "documents"))


def op6_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_best_fit_packing, op4_toxicity, op5_host_quality, op6_recurrent_lm, op7_url_filter, op8_decontamination, op9_token_ids, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op5_host_quality": quality.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL}
