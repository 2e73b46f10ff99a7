"""Registered queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import gateway
from ..functions import text as tx
from ..operators import archive, brief, chunking, compression, filtering, history, output, ranking, sanitize, state, summarize
from ..sources import workspace
from . import noise

QUERY = "the onder thation edsher over"
NOW = 1706745600


def _table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


docs, events, talks, vectors, pages = (_table(n) for n in ("documents", "events", "conversations", "embeddings", "pages"))


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Documents and noisy documents (ids below zero), for operators that need both."""
    return docs(spark, d).select("doc_id", "text").unionByName(noise.documents(spark, d).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))


def per_text(source, **columns):
    return lambda s, d: source(s, d).select("doc_id", *[c.alias(n) for n, c in ((n, f() if callable(f) else f) for n, f in columns.items())])


def text_of_lines(fn):
    return per_text(noise.documents, content=lambda: tx.unlines(fn(tx.lines(F.col("text")))))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of calls: sizes and latencies from ids and values."""
    e = events(spark, d)
    before = (F.col("event_id") * 37 % 1000 + 10).cast("long")
    return e.select("event_id", F.col("event_type").alias("action"), "ts", before.alias("original_tokens"), (F.col("event_id") * 53 % 900).cast("long").alias("result_tokens"), (F.col("event_id") % 977 / 8.0).alias("latency_ms"))


def with_fillers(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 1, F.element_at(F.array(F.lit("ok"), F.lit(" Thanks! "), F.lit("ok?"), F.lit("okra")), (F.col("conv_id") % 4 + 1).cast("int"))).otherwise(F.col("text"))
    return talks(spark, d).select("conv_id", "turn", "role", said.alias("text"))


def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = mixed(spark, d).select("doc_id", F.posexplode(F.transform(tx.lines(F.col("text")), tx.trim)).alias("line_no", "line")).withColumn("level", summarize.heading_level(F.col("line")))
    return rows.where(F.col("level").isNotNull()).select("doc_id", "line_no", F.col("level").cast("long").alias("level"), F.regexp_replace(tx.trim(F.regexp_replace("line", "^#+", "")), ":+$", "").alias("title"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    both = ranking.min_max(ranking.bm25_scores(docs(spark, d), QUERY, keep=["doc_id"]), "bm25_score", "b").join(vectors(spark, d), F.col("doc_id") == F.col("vec_id"))
    one = vectors(spark, d).where("vec_id = 0").select(F.col("embedding").alias("q"))
    out = both.crossJoin(F.broadcast(one)).withColumn("score", F.round(0.55 * F.col("b") + 0.45 * (ranking.cosine(F.col("embedding"), F.col("q")) + 1) / 2, 6))
    return out.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(50)


def cache_gets(spark: SparkSession, d: str) -> DataFrame:
    puts = events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("content"), F.col("event_id").alias("put_at"))
    cache = state.cache_put(None, puts, NOW, 60).withColumn("expires_at", F.col("put_at") + F.when(F.col("key").cast("long") % 3 == 0, 0).otherwise(5000))
    users = events(spark, d).select(F.col("user_id").cast("string").alias("key")).distinct()
    keys = users.unionByName(users.select(F.concat("key", F.lit("x")).alias("key")))  # every other key was never put
    return state.cache_get(cache, keys, 12000).select("key", "content", "hit")


def stale(spark: SparkSession, d: str) -> DataFrame:
    files = events(spark, d).select("event_id", F.unix_timestamp("ts").alias("mtime"), F.when(F.col("event_type") == "view", "code").when(F.col("event_type") == "click", "doc").otherwise("other").alias("kind"))
    return brief.stale_docs(files).select("event_id", "mtime")


def ranked_items(spark: SparkSession, d: str) -> DataFrame:
    """The 24 best hits of a query, as ranked evidence items."""
    best = ranking.bm25(docs(spark, d), QUERY).orderBy(F.desc("bm25_score"), "doc_id").limit(24)
    rank = F.row_number().over(Window.orderBy(F.desc("bm25_score"), "doc_id"))
    return best.select("doc_id", "text", F.when(F.col("lang") == "en", "code").otherwise("doc").alias("kind"), rank.alias("rank"))


def packed(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 20).alias("archive_id"), F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")
    return archive.unpack(archive.pack(rows)).select("archive_id", "path", F.octet_length("text").cast("long").alias("bytes"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    parts = chunking.chunk(docs(spark, d)).select("doc_id", "chunk_id", "index", "content")
    wanted = docs(spark, d).select("doc_id", F.concat(F.lit("x/"), F.col("doc_id") % 3).alias("id"))
    return chunking.resolve(wanted, parts).select("doc_id", "id", "found")


QUERIES = {
    "count_tokens": lambda s, d: gateway.count_tokens(docs(s, d)).select("doc_id", "tokens", F.col("chars").cast("long").alias("chars"), F.col("bytes").cast("long").alias("bytes")),
    "token_totals_by_lang": lambda s, d: docs(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(tx.token_count(F.col("text"))).alias("tokens")),
    "signal_bypass": per_text(docs, bypassed=lambda: F.length(F.col("text")) < tx.BYPASS_CHARS),
    "lines_explode": lambda s, d: mixed(s, d).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")),
    "filter_documents": lambda s, d: filtering.filter_lines(docs(s, d)).select("doc_id", "content", F.col("metrics.original_tokens").alias("original_tokens"), F.col("metrics.result_tokens").alias("result_tokens"), F.col("lines_removed").cast("long").alias("lines_removed")),
    "filter_noise": lambda s, d: filtering.filter_lines(noise.documents(s, d), json=False).select("doc_id", "content", F.col("lines_removed").cast("long").alias("lines_removed")),
    "filter_keep_drop": lambda s, d: filtering.filter_lines(mixed(s, d), json=False, keep=["the", "["], drop=["^see", "tion"]).select("doc_id", "content"),
    "filter_collapse_ws": per_text(mixed, content=lambda: F.regexp_replace(tx.flat_lines(F.col("text")), rf"[{tx.WS}&&[^\n]]+", " ")),
    "filter_blank_runs": per_text(mixed, content=lambda: filtering.capped(filtering.right_trimmed(F.col("text")), 1)),
    "filter_boilerplate": lambda s, d: noise.lines(s, d).select("event_id", filtering.is_boilerplate(tx.trim_end(F.col("line"))).alias("noise")),
    "filter_truncate": per_text(docs, content=lambda: tx.truncate(F.col("text"), 100)),
    "densify_json": lambda s, d: events(s, d).select("event_id", filtering.densify_json(F.concat(F.lit(" "), F.col("props"), F.lit("\n"))).alias("content")),
    "sanitize_text": lambda s, d: sanitize.sanitize(mixed(s, d)).select("doc_id", "content", "redacted_count"),
    "sanitize_findings": lambda s, d: sanitize.sanitize(mixed(s, d)).select(F.explode("findings").alias("f")).groupBy("f.kind", "f.label").agg(F.sum("f.count").alias("n"), F.count(F.lit(1)).alias("docs")),
    "entities_extract": lambda s, d: compression.with_entity_index(mixed(s, d), "text").select("doc_id", F.array_join("entities", "·").alias("entities")),
    "entities_top": lambda s, d: compression.with_entity_index(mixed(s, d), "text").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(20),
    "dedupe_consecutive": text_of_lines(compression.squeeze_conversation),
    "dedupe_jaccard": text_of_lines(compression.fold_similar),
    "log_group": text_of_lines(compression.group_logs),
    "detect_type": per_text(mixed, kind=lambda: compression.detect_type(F.col("text"))),
    "code_squeeze": text_of_lines(compression.squeeze_code),
    "compress": lambda s, d: compression.compress(mixed(s, d)).select("doc_id", "content", "content_type", "bypassed"),
    "detect_domain": per_text(mixed, domain=lambda: output.detect_domain(F.col("text"))),
    "head_tail": per_text(mixed, content=lambda: output.head_tail(F.col("text"), 3, 2)),
    "git_context": text_of_lines(output.git_lines),
    "cargo_collapse": text_of_lines(output.cargo_lines),
    "npm_drop": text_of_lines(output.npm_lines),
    "docker_drop": text_of_lines(output.docker_lines),
    "kubectl_columns": text_of_lines(output.kubectl_lines),
    "rustc_drop": text_of_lines(output.rustc_lines),
    "pytest_drop": text_of_lines(output.pytest_lines),
    "gcc_drop": text_of_lines(output.gcc_lines),
    "compress_output": lambda s, d: output.compress_output(mixed(s, d)).select("doc_id", "domain", "content"),
    "first_sentence": per_text(mixed, sentence=lambda: tx.first_sentence(F.col("text"), 140)),
    "key_phrases": per_text(mixed, phrases=lambda: tx.unlines(summarize.key_phrases(F.col("text"), 6))),
    "outline_sections": outline_sections,
    "detect_mode": per_text(mixed, mode=lambda: summarize.detect_mode(F.col("text"))),
    "filetree_ext_counts": lambda s, d: pages(s, d).select(F.lower(F.regexp_extract("url", r"\.([^./]+)$", 1)).alias("ext")).groupBy("ext").agg(F.count(F.lit(1)).alias("n")),
    "summarize": lambda s, d: summarize.summarize(mixed(s, d)).select("doc_id", "mode", "summary"),
    "prune_remove": lambda s, d: history.prune_history(with_fillers(s, d), "remove").select("conv_id", "turn", "role", "text"),
    "prune_hybrid": lambda s, d: history.prune_history(with_fillers(s, d), "hybrid").select("conv_id", "turn", "role", "tier"),
    "prune_afm_tiers": lambda s, d: history.tiers(talks(s, d), 2, 3).groupBy("conv_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first")),
    "prune_budget": lambda s, d: history.within_budget(talks(s, d), 120).select("conv_id", "turn"),
    "bm25_rank": lambda s, d: ranking.bm25_scores(docs(s, d), QUERY, keep=["doc_id"]).select("doc_id", F.round("bm25_score", 6).alias("score")),
    "bm25_topk": lambda s, d: ranking.bm25_scores(docs(s, d), QUERY, keep=["doc_id"]).select("doc_id", F.round("bm25_score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25),
    "bm25_line_keep": lambda s, d: ranking.filter_relevant(mixed(s, d), "error disk E42 started").select("doc_id", "content", "lines_kept"),
    "technical_tokens": per_text(mixed, n=lambda: F.size(F.filter(ranking.tokens(F.col("text")), ranking.is_technical)).cast("long")),
    "cosine_topk": cosine_topk,
    "minmax_norm": lambda s, d: ranking.min_max(events(s, d).select("event_id", "value"), "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled")),
    "hybrid_rerank": hybrid,
    "chunk_semantic": lambda s, d: chunking.chunk(mixed(s, d)).select("doc_id", "index", "start_offset", "end_offset", "tokens"),
    "chunk_fixed": lambda s, d: chunking.chunk_fixed(docs(s, d)).select("doc_id", F.col("index").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), "content"),
    "resolve_chunk": resolved,
    "cache_ttl_get": cache_gets,
    "session_stats": lambda s, d: state.session_stats(calls(s, d)),
    "stats_by_action": lambda s, d: state.session_stats(calls(s, d), ["action"]),
    "latency_percentiles": lambda s, d: state.latency_percentiles(calls(s, d), "action"),
    "mtime_boost": lambda s, d: events(s, d).select("event_id", F.round(workspace.mtime_boost(F.unix_timestamp("ts"), F.lit(NOW)), 12).alias("boost")),
    "stale_median": stale,
    "per_source_cap": lambda s, d: brief.per_group_top(docs(s, d).select("doc_id", "source", "n_chars"), "source", 2, F.desc("n_chars"), F.asc("doc_id")),
    "evidence_budget": lambda s, d: brief.evidence(ranked_items(s, d), 2000).select("doc_id", "kind"),
    "pack_unpack": packed,
}
