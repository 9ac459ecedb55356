"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, fingerprints, mixing, near, packing, substrings, tokens, toxicity, urls
from .common import read

BYTE_RANKS, WORD_BPE = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), BYTE_RANKS)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), urls.listed_hosts(spark))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(read(spark, sf_dir, "conversations"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_packing, op4_exact_dedup, op5_chat_formatting, op6_fingerprints, op7_near_dedup, op8_mixing, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": urls.ORACLE_SQL, "op4_exact_dedup": exact.ORACLE_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL}
