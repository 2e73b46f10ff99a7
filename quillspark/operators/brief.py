"""Workspace briefing: rank files, filter their lines, chunk, rank again, pack evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.workspace import files, mtime_boost
from .catalog import suggest
from .chunking import chunk
from .ranking import bm25, keep_lines
from .sanitize import scrub

SHARES = {"code": 60, "doc": 25, "other": 15}
STALE_SECONDS = 7 * 86400


def stale_docs(df: DataFrame) -> DataFrame:
    """Docs older by 7 days than the upper median time of code files."""
    code = df.where("kind = 'code'").groupBy("mtime").agg(F.count(F.lit(1)).alias("n"))
    run = code.withColumn("to", F.sum("n").over(Window.orderBy("mtime").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(code.agg(F.sum("n").alias("all"))))
    median = run.agg(F.min(F.when(F.col("to") > F.floor(F.col("all") / 2), F.col("mtime"))).alias("median"))
    return df.where("kind = 'doc'").crossJoin(F.broadcast(median)).where(F.col("mtime") + STALE_SECONDS <= F.col("median")).drop("median")


def per_group_top(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def evidence(df: DataFrame, budget: int) -> DataFrame:
    """Items in rank order within 60/25/15 % of a token budget by kind; unused room is shared.

    An item that does not fit is cut if 40 tokens or more are left for it; if nothing fits,
    the first item is cut to the budget. A fold over the few ranked items: what is taken
    (rank and text) and what each kind has used.
    """
    caps = {"code": budget * 60 // 100, "doc": budget * 25 // 100}
    caps["other"] = budget - sum(caps.values())
    start = F.struct(F.array().cast("array<struct<rank:int,text:string>>").alias("out"), *[F.lit(0).cast("long").alias(k) for k in SHARES])

    def of_kind(x: Column, values) -> Column:
        return F.when(x["kind"] == "code", values("code")).when(x["kind"] == "doc", values("doc")).otherwise(values("other"))

    def step(acc: Column, x: Column) -> Column:
        free = F.greatest(F.lit(0).cast("long"), budget - acc["code"] - acc["doc"] - acc["other"])
        used, cap = of_kind(x, lambda k: acc[k]), of_kind(x, lambda k: F.lit(caps[k]))
        room = cap + free - used
        fits, skip = x["cost"] <= room, (used >= cap) & (free < x["cost"])
        text = F.when(fits, x["text"]).otherwise(tx.truncate(x["text"], room))
        take = ~skip & (fits | (room >= 40))
        cost = F.when(~take, F.lit(0).cast("long")).when(fits, x["cost"]).otherwise(tx.token_count(text))
        mine = lambda k: (x["kind"] == k) if k != "other" else ~x["kind"].isin("code", "doc")
        added = F.when(take, F.concat(acc["out"], F.array(F.struct(x["rank"].alias("rank"), text.alias("text"))))).otherwise(acc["out"])
        return F.struct(added.alias("out"), *[(acc[k] + F.when(mine(k), cost).otherwise(F.lit(0).cast("long"))).alias(k) for k in SHARES])

    cost = F.greatest(tx.token_count(F.col("text")), F.lit(1).cast("long"))
    items = df.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), cost.alias("cost")))).alias("_i"))
    packed = tx.once(items, "_t", F.aggregate("_i", start, step, lambda s: s["out"]))
    first = F.transform(F.slice("_i", 1, 1), lambda x: F.struct(x["rank"].alias("rank"), tx.truncate(x["text"], min(budget, 400)).alias("text")))
    taken = packed.select(F.explode(F.when(F.size("_t") > 0, F.col("_t")).otherwise(first)).alias("x")).select(F.col("x.rank").alias("_rank"), F.col("x.text").alias("_text"))
    out = df.join(F.broadcast(taken), F.col("rank").cast("int") == F.col("_rank"))
    return out.withColumn("text", F.col("_text")).drop("_rank", "_text")


def selected(spark: SparkSession, root: str, task: str, now: int, max_files: int = 40, max_file_bytes: int = 256 << 10, max_total_bytes: int = 2 << 20, extensions: list[str] | None = None, allowed_root: str | None = None) -> DataFrame:
    """The files of a task, at most ``max_files``, with file_score and ``raw`` text; text holds their relevant lines.

    Files are ranked by path and age first (the first eight if no path scores); the best
    are read within the byte budget, big ones by their windows, then ranked by content.
    """
    every = files(spark, root, extensions, max_file_bytes, task, allowed_root).withColumn("boost", mtime_boost(F.col("mtime"), F.lit(now)))
    ranked = bm25(every.drop("text"), task, "path").withColumn("path_score", F.col("bm25_score") + F.col("boost")).drop("bm25_score")
    order = Window.orderBy(F.desc("path_score"), "path")
    best = ranked.orderBy(F.desc("path_score"), "path").limit(max_files).withColumn("_at", F.row_number().over(order)).where((F.col("path_score") > 0) | (F.col("_at") <= 8))
    sized = best.withColumn("_sum", F.sum(F.least("bytes", F.lit(max_file_bytes))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    read = sized.where(F.col("_sum") <= max_total_bytes).select("path", "path_score").join(every, "path")
    scored = bm25(read, task).withColumn("file_score", F.col("bm25_score") + 0.15 * F.col("path_score") + F.col("boost")).drop("bm25_score")
    return keep_lines(scored.withColumn("raw", F.col("text")), task, "text", max_tokens=1600).withColumn("text", F.when(F.col("text") == "", F.col("raw")).otherwise(F.col("text")))


def evidence_of(lines: DataFrame, task: str, max_tokens: int, top_k: int) -> DataFrame:
    """Ranked excerpts of selected files: rank, path, kind, score, text; two a file, within the budget."""
    parts = chunk(lines, "text", "path", 320, 40).select("path", "index", F.col("content").alias("text")).join(lines.select("path", "kind", "file_score"), "path")
    hits = bm25(parts, task).withColumn("score", F.col("bm25_score"))
    order = [F.desc("score"), F.desc("file_score"), F.asc("path"), F.asc("index")]
    two = per_group_top(hits, "path", 2, F.desc("score"), F.asc("index")).orderBy(*order).limit(top_k)
    clipped = two.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("text", tx.truncate(F.col("text"), 400))
    return evidence(clipped, max(128, max_tokens) * 75 // 100).select("rank", "path", "kind", F.round("score", 3).alias("score"), "text")


def brief(spark: SparkSession, root: str, task: str, now: int, max_tokens: int = tx.DEFAULT_MAX_TOKENS, top_k: int = 12, **options) -> DataFrame:
    """Ranked, sanitised evidence for a task: rank, path, kind, score, text (options as of ``selected``)."""
    return evidence_of(selected(spark, root, task, now, **options), task, max_tokens, top_k).withColumn("text", scrub(F.col("text"))).orderBy("rank")


def _useful_line(t: Column) -> Column:
    fine = F.filter(F.transform(tx.lines(t), tx.trim), lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*)") & (x != "---"))
    return F.left(F.coalesce(F.get(fine, F.lit(0)), F.lit("")), F.lit(120))


def read_next(task: str, books: list[str]) -> list[str]:
    """What to open after a briefing: suggested playbooks, then actions that the task's words call for."""
    low = task.lower()
    says = lambda *words: any(w in low for w in words)
    skill = lambda a: f"- skill `{a}` → `cmp://skill/action/{a}` (or action=help id={a})"
    book = lambda b: f"- playbook `{b}` → `cmp://skill/playbook/{b}`"
    out = [f"{book(b)} (or action=playbook id={b})" for b in books] + [skill("brief")]
    if says("rank", "retriev", "chunk") or any("rerank" in b for b in books):
        out.append(skill("rerank"))
    if says("sanit", "untrusted", "secret", "ipi"):
        out += [skill("sanitize"), *([] if "sanitize-untrusted" in books else [book("sanitize-untrusted")])]
    if says("stat", "telemetry", "latency"):
        out.append(skill("stats"))
    if "workspace-brief" not in books:
        out.append(book("workspace-brief"))
    if "brief-then-rerank" in books or (says("brief") and says("rerank")):
        out.append(book("brief-then-rerank"))
    return list(dict.fromkeys(out))


def briefing(spark: SparkSession, root: str, task: str, now: int, max_tokens: int = tx.DEFAULT_MAX_TOKENS, top_k: int = 12, playbooks: DataFrame | None = None, **options) -> DataFrame:
    """One row: task, root, briefing, cache_key, sources, selected_files, metrics, backend, fallback_reason.

    The briefing has six headings (task, status, evidence, caveats, sources, read next) and
    is scrubbed as a whole. It is put together from at most ``max_files`` files and
    ``top_k`` excerpts; no model is called. The selected files, within ``max_total_bytes``,
    are used five times and so kept in memory; what is lost is computed again.
    """
    kept = selected(spark, root, task, now, **options).persist()
    found = evidence_of(kept, task, max_tokens, top_k)
    order = F.struct((-F.col("file_score")).alias("o"), "path")
    listed = lambda column, by: F.transform(F.array_sort(F.collect_list(F.struct(by.alias("by"), column.alias("x")))), lambda s: s["x"])
    first = found.groupBy("path").agg(F.min_by("text", "rank").alias("excerpt"))
    rows = kept.join(first, "path", "left").withColumn("seen", F.coalesce(F.nullif(_useful_line(F.col("excerpt")), F.lit("")), _useful_line(F.col("raw"))))
    about = F.format_string("- %s (%s, score %.2f)", "path", "kind", "file_score")
    about = F.when(F.col("seen") == "", about).otherwise(F.concat(about, F.lit(" — "), F.col("seen")))
    source = F.concat(F.format_string("- %s (score %.3f, %d bytes, %s", "path", "file_score", "bytes", "kind"), F.when(F.col("truncated"), ", truncated").otherwise(""), F.lit(")"))
    files_row = rows.agg(listed(about, order).alias("about"), listed(source, order).alias("listed"), listed(F.col("path"), order).alias("paths"), F.count(F.lit(1)).alias("selected_files"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("cut"), F.coalesce(F.sum(tx.token_count(F.col("raw"))), F.lit(0)).alias("tokens_in"))
    excerpt = F.concat(F.format_string("### %s (score %.3f)\n```\n", "path", "score"), F.col("text"), F.lit("\n```"))
    found_row = found.agg(F.array_join(listed(excerpt, F.col("rank")), "\n\n").alias("evidence"))
    old_row = stale_docs(kept.select("path", "kind", "mtime")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("- possibly stale: "), p, F.lit(" (older than selected code)"))), "\n").alias("stale"))
    books = [r["id"] for r in suggest(playbooks, task).collect()] if playbooks is not None else []  # three at most
    one = files_row.crossJoin(found_row).crossJoin(old_row)
    lines = lambda a: F.array_join(a, "\n")
    or_else = lambda c, other: F.when(c == "", other).otherwise(c)
    gaps = F.when(F.col("cut"), "- Some large files were window-truncated; open Read next paths for full context.").otherwise("- Confirm Status against primary sources before acting.")
    following = F.concat(F.transform(F.slice("paths", 1, 4), lambda p: F.concat(F.lit("- "), p)), F.array(*[F.lit(x) for x in read_next(task, books)]))
    text = F.concat(
        F.lit(f"## Task\n{task}\n\n## Status\n### Status\n"), lines(F.concat(F.array(F.lit(f"- Task focus: {task}")), F.slice("about", 1, 5))), F.lit("\n### Gaps\n"), gaps,
        F.lit("\n### Next\n- Read the top Sources paths, then implement against code not docs alone.\n\n## Evidence\n"), or_else(F.col("evidence"), F.lit("_no evidence_")),
        F.lit("\n\n## Caveats\n"), or_else(F.col("stale"), F.lit("- none")), F.lit("\n\n## Sources\n"), lines("listed"), F.lit("\n\n## Read next\n"), lines(following), F.lit("\n"),
    )
    done = tx.once(one, "briefing", scrub(text))
    out = tx.token_count(F.col("briefing"))
    saved = F.when((F.col("tokens_in") == 0) | (out >= F.col("tokens_in")), F.lit(0.0)).otherwise((F.col("tokens_in") - out) / F.col("tokens_in"))
    metrics = F.struct(F.col("tokens_in").alias("original_tokens"), out.alias("result_tokens"), saved.alias("reduction_ratio"))
    key = F.concat(F.lit("cache://brief/"), F.lower(F.lpad(F.hex(F.xxhash64("briefing")), 16, "0")))
    return done.select(F.lit(task).alias("task"), F.lit(root).alias("root"), "briefing", key.alias("cache_key"), F.col("paths").alias("sources"), "selected_files", metrics.alias("metrics"), F.lit("heuristic").alias("backend"), F.lit("no model configured").alias("fallback_reason"))
