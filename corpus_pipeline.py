"""Corpus preparation: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
Rows are judged by their text, so nulls, repeated rows and further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm import bpe, decontaminate, neardup, quality, secrets
from sitesift.llm.shared import small_batches, stored, table


#: For a similarity of 0.8: 32 trees of 4 hashes miss (1 - 0.8^4)^32 = 5e-8 of the pairs.
NEAR = neardup.Forest(trees=32, step=4)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that the weighed votes call bad, go."""
    small_batches(spark)
    return quality.judge(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id."""
    return neardup.keep_one(docs, share=80, forest=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edit budget, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; no row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens, round_trip): token ids, and whether they decode to the text."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"),
                        bpe.both_ways("text", vocabulary, public_tokenizers.PATTERN).alias("coded"))
    same = F.col("coded.data") == F.encode("text", "UTF-8")
    return coded.select("doc_id", "source", "lang", "coded.ids", F.size("coded.ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: No SQL expresses the stages (iterated estimates, signatures, tokenizers); a test compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs
