"""Pruning of chat histories: filler, older-turn summaries, recency tiers, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .summarize import summarize_text

#: Whole or leading words of filler turns (fixed values).
FILLERS = ["ok", "okay", "sure", "thanks", "thank you", "thx", "got it", "sounds good", "cool", "great", "nice", "yep", "yeah", "yes", "no problem", "np", "👍", "lgtm", "done", "continue", "go ahead", "please continue"]


def is_filler(t: Column) -> Column:
    x = tx.ascii_lower(tx.trim(F.coalesce(t, F.lit(""))))
    starts = F.lit(False)
    for f in FILLERS:
        starts = starts | x.startswith(f)
    return (x == "") | x.isin(FILLERS) | ((F.length(x) <= 12) & ~x.contains("?") & starts)


def rendered(role: Column, t: Column) -> Column:
    return F.concat(role, F.lit(": "), tx.trim(F.coalesce(t, F.lit(""))), F.lit("\n"))


def tiers(df: DataFrame, keep_last: int = 4, thematic: int | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add age (1 is the latest turn) and tier: critical, thematic, distant."""
    n = max(keep_last, 1)
    m = max(3 * n, 3) if thematic is None else thematic
    age = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return df.withColumn("age", age).withColumn("tier", F.when(F.col("age") <= n, "critical").when(F.col("age") <= n + m, "thematic").otherwise("distant"))


def within_budget(df: DataFrame, max_tokens: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Drop turns from the front until the rest fits; the last turn stays, cut to the budget if it alone is above it.

    Costs of single turns are summed from the end, so one sorted window decides.
    """
    total, age = tx.free(df, "budget_sum", "budget_age")
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    cost = tx.token_count(rendered(F.col("role"), F.col(text)))
    out = df.withColumn(total, F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(age, F.row_number().over(w))
    alone = (F.col(age) == 1) & (F.col(total) > max_tokens)
    return out.where((F.col(total) <= max_tokens) | (F.col(age) == 1)).withColumn(text, F.when(alone, tx.truncate(F.col(text), max_tokens)).otherwise(F.col(text))).drop(total, age)


def rendered_history(pruned: DataFrame, conv: str = "conv_id", turn: str = "turn", max_tokens: int | None = None) -> DataFrame:
    """Per conversation: rendered (its messages as "role: text" lines, cut to the budget if one is given) and distant_key (or null)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), rendered(F.col("role"), F.col("text")).alias("x"))))
    key = F.max(F.when(F.col("tier") == "distant", F.regexp_extract("text", r"ref=(cmp://afm/[0-9a-f]{16})", 1)))
    whole = F.array_join(F.transform(rows, lambda s: s["x"]), "")
    out = pruned.groupBy(conv).agg(whole.alias("rendered"), key.alias("distant_key"))
    return out.withColumn("rendered", tx.truncate(F.col("rendered"), max_tokens)) if max_tokens is not None else out


def distant_payloads(df: DataFrame, keep_last: int = 4, thematic: int | None = None, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(key, content) of what ``prune_history`` with afm replaces by references, to be put in the cache."""
    base = df.select(conv, turn, "role", F.col(text).alias("text")).where(~is_filler(F.col("text")))
    far = tiers(base, keep_last, thematic, conv, turn).where("tier = 'distant'")
    band = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), rendered(F.col("role"), F.col("text")).alias("x")))), lambda s: s["x"]), "")
    return far.groupBy(conv).agg(band.alias("content")).select(distant_key(F.col("content")).alias("key"), "content")


def distant_key(band: Column) -> Column:
    return F.concat(F.lit("cmp://afm/"), F.lower(F.lpad(F.hex(F.xxhash64(band)), 16, "0")))


def prune_totals(df: DataFrame, pruned: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """Per conversation: messages, dropped (filler turns), kept, original_tokens, result_tokens, rendered size."""
    cost = lambda c: F.sum(tx.token_count(rendered(F.col("role"), F.col(c))))
    before = df.groupBy(conv).agg(F.count(F.lit(1)).alias("messages"), F.count_if(is_filler(F.col(text))).alias("dropped"), cost(text).alias("original_tokens"))
    after = pruned.groupBy(conv).agg(F.count(F.lit(1)).alias("kept"), cost("text").alias("result_tokens"))
    return before.join(after, conv, "left").na.fill(0, ["kept", "result_tokens"])


def prune_history(df: DataFrame, strategy: str = "hybrid", keep_last: int = 4, thematic: int | None = None, max_tokens: int | None = None, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages (conv, turn, role, text, tier) after pruning by remove, compress, hybrid or afm.

    Older turns become one system turn a band, placed where the band began: a summary, or
    for distant turns a reference whose key is a hash of their text. The bands of a
    conversation are gathered by conversation only, never across them.
    """
    base = df.select(conv, turn, "role", F.col(text).alias("text"))
    if strategy != "compress":
        base = base.where(~is_filler(F.col("text")))
    if strategy == "remove":
        out = base.withColumn("tier", F.lit("kept"))
    else:
        if strategy == "afm":
            t = tiers(base, keep_last, thematic, conv, turn)
        else:
            t = tiers(base, keep_last, 1 << 30, conv, turn)
            t = t.withColumn("tier", F.when(F.col("age") <= keep_last, "critical").otherwise("thematic"))
        old = t.where(F.col("tier") != "critical").groupBy(conv, "tier").agg(F.min(turn).alias(turn), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), rendered(F.col("role"), F.col("text")).alias("x")))), lambda s: s["x"]), "").alias("band"))
        summary = summarize_text(F.col("band"), F.lit("conversation"), F.lit(2), F.lit(6), F.lit(512))
        heading = F.concat(F.lit("[thematic memory — "), F.col("n").cast("string"), F.lit(" turns compressed]\n")) if strategy == "afm" else F.lit("[earlier conversation summary]\n")
        key = distant_key(F.col("band"))
        far = F.concat(F.lit("[distant memory ref="), key, F.lit(" — "), F.col("n").cast("string"), F.lit(" turns omitted; resolve via action=cache_get or resolve]\npreview: "), F.left("band", F.lit(80)), F.lit("…"))
        old = old.select(conv, turn, F.lit("system").alias("role"), F.when(F.col("tier") == "distant", far).otherwise(F.concat(heading, tx.trim(summary))).alias("text"), "tier")
        out = old.unionByName(t.where(F.col("tier") == "critical").select(conv, turn, "role", "text", "tier"))
    return within_budget(out, max_tokens, conv, turn) if max_tokens is not None else out
