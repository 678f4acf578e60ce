"""The registered queries of the training-data operators, with their whole tables and production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, jaccard, language, mixing, neighbours, packing, pfor, urls, warc, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_index(_table(spark, sf_dir, "documents"))


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op3_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op7_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_language_spans, op3_url_language_model, op4_warc_archives, op5_nn_descent, op6_wrapper_induction, op7_bayes_jaccard, op8_best_fit_packing, op9_curriculum_mix, op10_chunk_fingerprints)}
ORACLES = {"op9_curriculum_mix": mixing.ORACLE}
