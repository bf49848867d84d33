"""The queries of this folder's operators, with production parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftspark.llm import (
    conversation_trie, fingerprints, licenses, quality_rules, ranked_search, secret_scan, simhash, sql, substring_dedup,
    suffix_dedup, toxicity,
)
from siftspark.llm.packing import packed
from siftspark.llm.sentencepiece_codec import coded
from siftspark.llm.token_counts import token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"), window=13, digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels"), "quality"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES, TOKEN_LIMIT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), length=100, digests=True)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), PIECES, digests=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), WORDS, end_id=2, capacity=4096)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


HELD_OUT = "crc32(cast(doc_id AS string)) % 5 = 0"


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels").filter(f"NOT ({HELD_OUT})"), "toxic")
    return toxicity.scored(docs, model).selectExpr(
        "doc_id", f"{HELD_OUT} AS held_out", "score", "cast(score >= 0.5 AS int) AS predicted")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash, op2_substring_dedup, op3_quality_rules, op4_token_counts, op5_packing, op6_fingerprints,
        op7_secret_scan, op8_toxicity, op9_suffix_dedup, op10_sentencepiece, op11_conversation_trie,
        op12_ranked_search, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
