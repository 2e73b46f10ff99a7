"""Queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, fingerprints, licences, mixing, near_dedup, quality_crf, rules, sharding, token_counts, token_store
from .common import read_table

MIX_WEIGHTS = [3.0, 1.0, 2.0]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbour_edits(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_digests(spark, path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), 24)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests_only=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rules.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    names = {"words": "n_words", "word_chars": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeat": "n_repeat_words"}
    return rated.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], "base_failed", "kept")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_licence_scan": op2_licence_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_token_store": op5_token_store,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_bpe": op8_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op2_licence_scan": licences.oracle_sql(), "op10_quality_rules": rules.oracle_sql()}
