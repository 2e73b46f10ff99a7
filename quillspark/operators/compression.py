"""Dense compression: type detection, entities, near-duplicate folding, per-type rewrites."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .filtering import with_filtered

#: Entity patterns in order, and how many new ones of each are kept (fixed values).
ENTITIES = [
    (r"(?:[A-Za-z]:)?(?:/[\w.-]+)+(?:\.\w+)?", 12),
    (r"""https?://[^\s)>"']+""", 8),
    (r"\b(?:E[A-Z]+\d*|[45]\d{2})\b", 6),
    (r"\bv?\d+\.\d+\.\d+(?:[-+][\w.]+)?\b", 6),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 4),
]
MAX_ENTITIES, SIMILARITY = 24, 0.85
CODE_STARTS = ["fn ", "def ", "class ", "import ", "pub "]
LOG_PREFIX = r"^(?:\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*)?(?:\[[^\]]+\]\s*)?"
LONE_BRACKETS = ["{", "}", "};", "},", "(", ")", ");"]
NOTES = ["TODO", "FIXME", "NOTE"]
#: Keys of wide JSON objects that are kept before others (fixed values).
PRIORITY_KEYS = set("id node_id name full_name title subject summary description body message error errors status state number path file filename url html_url sha ref login type kind severity merged draft labels head base user created_at updated_at closed_at merged_at".split())


def any_of(tests) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def detect_type(t: Column) -> Column:
    head, a = tx.trim_start(t), tx.lines(t)
    loggy = F.filter(
        F.slice(a, 1, 20),
        lambda x: any_of(x.contains(f" {w} ") for w in ("ERROR", "WARN", "INFO")) | (x.startswith("[") & x.contains("]") & any_of(x.contains(w) for w in ("error", "warn", "info"))),
    )
    return (
        F.when(head.rlike(r"^[{\[]") & tx.json_value(head).isNotNull(), "json")
        .when(F.size(loggy) >= 3, "log")
        .when(F.exists(a, lambda x: any_of(tx.trim_start(x).startswith(s) for s in CODE_STARTS)), "code")
        .when(any_of(t.contains(s) for s in ("user:", "assistant:", "```")), "conversation")
        .otherwise("text")
    )


def with_entity_index(df: DataFrame, t: str, to: str = "entities") -> DataFrame:
    """Distinct entities in order of pattern, then of place; each pattern adds its cap of new ones."""
    out = df.withColumn(to, F.array().cast("array<string>"))
    for pattern, cap in ENTITIES:
        found = F.transform(F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"^[,;.)]+|[,;.)]+$", ""))
        new = F.array_except(F.filter(found, lambda x: F.octet_length(x) >= 3), F.col(to))
        out = tx.once(out, to, F.concat(F.col(to), F.slice(new, 1, cap)))
    return tx.once(out, to, F.slice(to, 1, MAX_ENTITIES))


def fold_similar(a: Column, threshold: float = SIMILARITY) -> Column:
    """Drop a line like the last kept one: equal, or with token sets of at least the similarity.

    The fold carries the last kept line's words and the indices kept, not the lines.
    """
    kind = "struct<kept:array<int>,line:string,last:array<string>>"

    def words(x: Column) -> Column:
        return F.filter(F.array_distinct(F.split(tx.ascii_lower(x), rf"[{tx.WS}]+")), lambda w: w != "")

    rows = F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"), words(x).alias("w")))

    def step(acc: Column, r: Column) -> Column:
        both = F.size(F.array_intersect(r["w"], acc["last"]))
        union = F.size(r["w"]) + F.size(acc["last"]) - both
        alike = (F.size(acc["last"]) > 0) & (F.size(r["w"]) > 0) & (both / F.greatest(union, F.lit(1)) >= threshold)
        same = F.coalesce(acc["line"] == r["x"], F.lit(False))
        return F.when(alike | same, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(r["i"])).alias("kept"), r["x"].alias("line"), r["w"].alias("last")))

    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("string").alias("line"), F.array().cast("array<string>").alias("last")).cast(kind)
    return F.transform(F.aggregate(rows, start, step, lambda s: s["kept"]), lambda i: F.get(a, i))


def log_bodies(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: tx.trim(F.regexp_replace(x, LOG_PREFIX, ""))), lambda x: x != "")


def group_logs(a: Column) -> Column:
    """Equal bodies once, in order of first sight, with their count if above 1.

    One sort puts equal bodies side by side; where a run starts, its first place and its
    length (up to the next start) are known.
    """
    held = F.array(F.array_sort(F.transform(log_bodies(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))

    def grouped(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda x, k: k), lambda k: (k == 0) | (F.get(s, k)["x"] != F.get(s, k - 1)["x"]))
        ends = F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(s)))
        runs = F.zip_with(at, ends, lambda k, e: F.struct(F.get(s, k)["i"].alias("i"), (e - k).alias("n"), F.get(s, k)["x"].alias("x")))
        return F.transform(F.array_sort(F.filter(runs, lambda r: r["n"] > 0)), lambda r: F.when(r["n"] > 1, F.concat(F.lit("×"), r["n"].cast("string"), F.lit(" "), r["x"])).otherwise(r["x"]))

    return F.flatten(F.transform(held, grouped))


def squeeze_code(a: Column) -> Column:
    """Without block comments (whole lines), line comments but notes and doc ones, and lone brackets.

    A block goes from a line that starts with /* to the first one that holds */, or to the
    end: one pattern over the text, as no line holds a line break.
    """
    t = F.concat(F.lit("\n"), tx.unlines(F.transform(a, tx.trim)))
    t = F.regexp_replace(t, r"\n/(?=\*)(?:[\s\S]*?\*/[^\n]*|[\s\S]*)", "")
    rows = F.when((F.size(a) == 0) | (t == ""), F.array().cast("array<string>")).otherwise(F.split(F.substring(t, F.lit(2), F.length(t)), "\n"))

    def keep(x: Column) -> Column:
        comment = x.startswith("//") | (x.startswith("#") & ~x.startswith("#!"))
        note = any_of(x.contains(n) for n in NOTES) | x.startswith("///") | x.startswith("//!")
        return F.when(comment, note).otherwise(~x.isin(LONE_BRACKETS))

    return F.filter(rows, keep)


def squeeze_conversation(a: Column) -> Column:
    t = F.filter(F.transform(a, tx.trim), lambda x: x != "")
    return F.filter(t, lambda x, i: (i == 0) | (x != F.coalesce(F.get(t, i - 1), F.lit(""))))


def _compact(v, depth: int = 0):
    if isinstance(v, list):
        cut = len(v) > 8 and depth > 0
        picked = [*v[:3], v[-1]] if cut else v
        out = [_compact(x, depth + 1) for x in picked]
        return [*out[:3], f"…(+{len(v) - 4} items)", out[3]] if cut else out
    if isinstance(v, dict):
        names = sorted(v)
        if len(names) > 20:
            names = sorted(names, key=lambda k: k.lower() not in PRIORITY_KEYS)[:15]
        out = {k: _compact(v[k], depth + 1) for k in names}
        return out | {"_truncated_keys": len(v) - len(names)} if len(v) > 20 else out
    if isinstance(v, str) and len(raw := v.encode()) > 240:
        return raw[:200].decode("utf-8", "ignore") + f"…(+{len(raw) - 200}c)"
    return v


@F.pandas_udf(T.StringType())
def compact_json(texts: pd.Series) -> pd.Series:
    """Recursive pruning of JSON texts, which no built-in expresses; other texts, and those nested too deep, stay.

    Spark runs this on every row, whatever condition is around it: give null for rows that
    do not need it, which cost nothing.
    """

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(_compact(json.loads(t.strip())), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except (ValueError, RecursionError):
            return t

    return texts.map(one)


def hard_truncate(t: Column, max_tokens: int) -> Column:
    """Cut at 95 % of the byte budget, at the last line break if that is past its half."""
    cut = tx.byte_floor(t, int(max_tokens * tx.CHARS_PER_TOKEN * 0.95))
    line = F.regexp_extract(cut, r"(?s)^(.*)\n", 1)
    short = F.when(cut.contains("\n") & (F.octet_length(line) > F.floor(F.octet_length(cut) / 2)), line).otherwise(cut)
    return F.when(tx.token_count(t) <= max_tokens, t).otherwise(F.concat(short, F.lit(f"\n…[truncated to ~{max_tokens} tokens]")))


def compress(df: DataFrame, text: str = "text", max_tokens: int = tx.DEFAULT_MAX_TOKENS, dedupe: bool = True, with_entities: bool = True, prefilter: bool = True, content_type: str = "auto", force: bool = False) -> DataFrame:
    """Add content, content_type, entities, bypassed and metrics; short texts pass unchanged unless forced."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, rows, b = tx.free(df, "work", "rows", "body")
    out = df.withColumn("bypassed", (F.length(t) < tx.BYPASS_CHARS) & F.lit(not force))
    work = F.when(F.col("bypassed"), F.lit("")).otherwise(t)  # bypassed texts cost nothing more
    out = with_filtered(out, work, w, json=content_type in ("auto", "json")) if prefilter else tx.once(out, w, work)
    out = tx.once(out, "content_type", F.when(F.col("bypassed"), F.lit(None)).otherwise(detect_type(F.col(w)) if content_type == "auto" else F.lit(content_type)))
    out = with_entity_index(out, w) if with_entities else out.withColumn("entities", F.array().cast("array<string>"))
    out = tx.once(out, rows, tx.lines(F.col(w)))
    out = tx.once(out, rows, fold_similar(F.col(rows))) if dedupe else out
    kind, a = F.col("content_type"), F.col(rows)
    body = F.when(kind == "log", tx.unlines(group_logs(a))).when(kind == "code", tx.unlines(squeeze_code(a))).when(kind == "conversation", tx.unlines(squeeze_conversation(a))).otherwise(tx.unlines(a))
    out = tx.once(out, b, body)
    out = tx.once(out, b, F.coalesce(compact_json(F.when(kind == "json", F.col(b))), F.col(b)))
    headed = F.when(F.size("entities") > 0, F.concat(F.lit("[entities: "), F.array_join("entities", " · "), F.lit("]\n"), F.col(b))).otherwise(F.col(b))
    out = tx.once(out, b, headed)
    out = tx.once(out, "content", F.when(F.col("bypassed"), t).otherwise(hard_truncate(F.col(b), max_tokens)))
    return out.withColumn("metrics", tx.metrics(t, F.col("content"))).drop(w, rows, b)
