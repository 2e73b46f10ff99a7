"""What the engine offers, as tables; playbooks from a directory; suggestions by token overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sanitize import scrub

ACTIONS = [
    ("filter", "Drop noise lines, collapse white space, cut to a budget"),
    ("compress", "Dense rewrite by detected type with an entity index"),
    ("compress_output", "Scrub command output by domain, keep head and tail"),
    ("summarize", "Summaries of conversations, file trees and outlines"),
    ("summarize_smart", "Summary focused on a query, heuristic without a model"),
    ("filter_relevant", "Lines that matter to a query"),
    ("prune_history", "Shrink chat histories by filler, summaries and tiers"),
    ("chunk", "Chunks with references"),
    ("resolve", "Content of a chunk reference"),
    ("count_tokens", "Token estimate"),
    ("stats", "Totals and percentiles of a call log"),
    ("cache_store", "Put payloads by key with expiry"),
    ("cache_get", "Payloads by key"),
    ("cache_invalidate", "Remove payloads"),
    ("sanitize", "Redact secrets and injected instructions"),
    ("rerank", "Rank candidates by BM25, vectors and outside scores"),
    ("brief", "Evidence from a directory for a task"),
    ("catalog", "This table"),
    ("help", "One row of this table"),
    ("playbooks", "Playbooks of a directory"),
    ("playbook", "One playbook, sanitised"),
    ("pack", "Zip archives of texts"),
    ("unpack", "Texts of zip archives"),
    ("llm_status", "Whether a model is configured"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "id string, summary string").withColumn("uri", F.concat(F.lit("cmp://skill/action/"), F.col("id")))


def help_for(spark: SparkSession, action: str) -> DataFrame:
    return catalog(spark).where(F.col("id") == action)


def llm_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(False, "no model configured")], "configured boolean, fallback_reason string")


def playbooks(spark: SparkSession, directory: str, builtin: DataFrame | None = None) -> DataFrame:
    """(id, name, description, tags, body) of *.md files; a file replaces a built-in of its id."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.md").withColumn("file", F.col("_metadata.file_name"))
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:(.*)$", 1)), F.lit(""))
    stem = F.regexp_replace("file", r"\.md$", "")
    tags = F.filter(F.split(F.coalesce(field("tags"), F.lit("")), r"[,\s\[\]]+"), lambda x: x != "")
    own = raw.select(F.coalesce(field("id"), stem).alias("id"), F.coalesce(field("name"), stem).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"), tags.alias("tags"), F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))
    if builtin is None:
        return own
    both = own.withColumn("_p", F.lit(0)).unionByName(builtin.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("_p"))).where("_r = 1").drop("_p", "_r")


def playbook(books: DataFrame, wanted: str) -> DataFrame:
    return books.where(F.col("id") == wanted).withColumn("body", scrub(F.col("body")))


def suggest(books: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Playbooks by how many query words (3 letters or more) their text contains; ties by id."""
    import re

    words = [w for w in re.split(r"[\W_]+", query.lower()) if len(w.encode()) > 2]
    blob = F.lower(F.concat_ws(" ", "id", "name", "description", F.array_join("tags", " ")))
    score = sum((blob.contains(w).cast("int") for w in words), F.lit(0))
    return books.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


