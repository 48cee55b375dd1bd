"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, recurrent_lm, secrets, simhash, toxicity
from ledgerloom.llm.common import documents

#: Where the tokenizer file is on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_quality(documents(spark, sf_dir))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.lm_scores(documents(spark, sf_dir))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(documents(spark, sf_dir))


def op10_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_template_lines(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_weighted_mix, op3_compression_bands, op4_skip_chain_pii, op5_recurrent_lm, op6_subword_toxicity, op7_exact_dedup, op8_randomness_secrets, op9_simhash, op10_template_lines)}

ORACLES: dict[str, str] = {"op2_weighted_mix": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op10_template_lines": line_dedup.ORACLE}
