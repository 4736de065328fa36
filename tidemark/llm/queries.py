"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontam,
    language,
    merkle,
    mixing,
    neighbours,
    pii,
    secret_scan,
    simhash,
    spelling,
    token_files,
    tool_calls,
    toxicity,
    word_bpe,
)
from tidemark.llm.common import table


def tokenizer_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.tokenize(table(spark, folder, "documents"), tokenizer_file())


def op2_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = tool_calls.calls_of(table(spark, folder, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op2_orphan_results(spark: SparkSession, folder: str) -> DataFrame:
    return tool_calls.orphan_results(*tool_calls.calls_of(table(spark, folder, "conversations")))


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secret_scan.find_secrets(table(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted_languages(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, folder, "labels"))
    return mixing.mixed(table(spark, folder, "documents"), weights)


def op11_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return word_bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return merkle.manifest(table(spark, folder, "documents"), changed)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"), every=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_tool_calls": op2_tool_calls,
    "op2_orphan_results": op2_orphan_results,
    "op3_neighbours": op3_neighbours,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_personal_data": op6_personal_data,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_word_bpe": op11_word_bpe,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}
