"""Keyed payload cache with expiry, session statistics, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def cache_put(cache: DataFrame | None, rows: DataFrame, now: int, ttl: int | None = None, key: str = "key", content: str = "content") -> DataFrame:
    """The cache after puts (key, content, tokens, expires_at, put_at): the last put of a key wins."""
    new = rows.select(F.coalesce(F.col(key), F.concat(F.lit("cmp://cache/"), F.lower(F.hex(F.xxhash64(content))))).alias("key"), F.col(content).alias("content"), tx.token_count(F.col(content)).alias("tokens"), (F.lit(now + ttl) if ttl is not None else F.lit(None)).cast("long").alias("expires_at"), F.col("put_at") if "put_at" in rows.columns else F.lit(now).cast("long").alias("put_at"))
    every = new if cache is None else cache.unionByName(new)
    last = every.groupBy("key").agg(F.max_by(F.struct("content", "tokens", "expires_at", "put_at"), F.struct("put_at", "content")).alias("v"))
    return last.select("key", "v.*")


def cache_get(cache: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    out = keys.join(live, "key", "left")
    return out.select(*keys.columns, "content", "tokens", F.octet_length("content").alias("bytes"), F.col("content").isNotNull().alias("hit"))


def cache_invalidate(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return cache.limit(0) if keys is None else cache.join(keys.select("key"), "key", "left_anti")


def cache_evict(cache: DataFrame, max_bytes: int, now: int) -> DataFrame:
    """Expired entries go, then the oldest until the rest fits (a range-ordered running sum)."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    newest = Window.orderBy(F.desc("put_at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    return live.withColumn("_sum", F.sum(F.octet_length("content")).over(newest)).where(F.col("_sum") <= max_bytes).drop("_sum")


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile as the element at round((n - 1) p) of the sorted values, to 3 places."""
    at = F.floor((F.size(values) - 1) * p + 0.5).cast("int") + 1
    return F.round(F.element_at(F.sort_array(values), at), 3)


def session_stats(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens in and out, tokens saved (never negative for a call) and their ratio.

    A boolean column ``bypassed`` adds bypass_ratio; a column ``lazy`` (ad, full or follow:
    a short listing, a full load, a load of what was listed before) adds lazy_hit_rate.
    """
    g = calls.groupBy(*by) if by else calls.groupBy()
    saved = F.greatest(F.col("original_tokens") - F.col("result_tokens"), F.lit(0))
    share = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    extra = [share(F.col("bypassed"), F.lit(True)).alias("bypass_ratio")] if "bypassed" in calls.columns else []
    if "lazy" in calls.columns:
        extra.append(share(F.col("lazy") == "follow", F.col("lazy").isin("ad", "full")).alias("lazy_hit_rate"))
    out = g.agg(F.count(F.lit(1)).alias("calls"), F.sum("original_tokens").alias("original_tokens"), F.sum("result_tokens").alias("result_tokens"), F.sum(saved).alias("tokens_saved"), *extra)
    return out.withColumn("saved_ratio", F.when(F.col("original_tokens") > 0, F.round(F.col("tokens_saved") / F.col("original_tokens"), 6)).otherwise(0.0))


def latency_percentiles(calls: DataFrame, by: str, value: str = "latency_ms", sample: int | None = None) -> DataFrame:
    """p50, p95 and p99 by nearest rank, from value counts, so equal values never pile up in one task."""
    counts = calls.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    run = counts.withColumn("_to", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("_to") > F.floor((F.col("_all") - 1) * p + 0.5), F.col(value)))
    return run.groupBy(by).agg(F.max("_all").alias("n"), *[F.round(at(p), 3).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def audit_rows(calls: DataFrame) -> DataFrame:
    """Audit line of each call; errors that hint at a credential are masked, others cut to 200 characters."""
    hint = tx.ascii_lower(F.col("error")).rlike("key|token|secret|password|bearer")
    return calls.withColumn("error", F.when(hint, "[REDACTED]").otherwise(F.left("error", F.lit(200))))


def write_audit(calls: DataFrame, path: str) -> None:
    audit_rows(calls).write.mode("append").json(path)
