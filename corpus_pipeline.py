"""Five stages from raw documents to token ids: classify, rule out, dedupe, mix, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe_codec, mixing, near_dedup, quality_crf, rules
from quillspark.llm.common import read_table, staged
from quillspark.llm.queries import MIX_WEIGHTS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.classify(docs, read_table(spark, sf_dir, "labels"), keep_columns=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_rows(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, MIX_WEIGHTS, share=1.5, cap=2.0)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), packed=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("BPE encoding", bpe_encoding),
]

#: No SQL expresses the trained classifier, the dependent rounding or the merge loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i}")
    return docs
