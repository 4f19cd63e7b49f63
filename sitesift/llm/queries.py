"""Queries of the operators over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitesift.llm import (
    bpe, chat, decontaminate, lexical, licenses, linequality, neardup, negatives, oracles, packed, passages, quality, secrets, shards)
from sitesift.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL where it can express the query; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_secret_scan": oracles.SECRETS, "op5_chat_format": oracles.CHAT, "op7_near_duplicates": oracles.NEAR,
    "op12_hard_negatives": oracles.NEGATIVES, "op13_lexical_search": oracles.LEXICAL,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_digest(table(spark, folder, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeats(table(spark, folder, "documents"))


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_digest(table(spark, folder, "documents"))


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licence_digest(table(spark, folder, "documents"))


@query
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.conversation_digest(rows.union(extra))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_digest(table(spark, folder, "documents"))


@query
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digest(table(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(table(spark, folder, "documents"))


@query
def op10_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    written = packed.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.read(written)


@query
def op11_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return linequality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
