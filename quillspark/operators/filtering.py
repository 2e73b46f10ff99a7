"""Line filter: escapes, boilerplate, drop and keep patterns, white space, blank runs, budget."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Terminal escapes, spinner glyphs, rule lines and package-manager noise (fixed values).
ANSI = r"\x1B(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[()][AB012])"
SPINNERS = ["|", "/", "-", "\\", "⠋", "⠙", "⠹", "⠸", "⠼", "⠴", "⠦", "⠧", "⠇", "⠏"]
RULE_LINE = r"^(?: *[-=*#_─═]){8,} *$"
NPM_NOISE = r"(?i)^(npm (warn|notice)|deprecated|using cache|added \d+ packages)"
#: A line somewhere that could be boilerplate: a text without one needs no look at single lines.
MAY_BE_NOISE = rf"(?im)^[{tx.WS}]*(?:[|/\\⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏*#_─═=-]|npm |deprecated|using cache|added \d)"


def strip_ansi(t: Column) -> Column:
    return tx.bound(t, lambda x: F.when(x.contains("\x1b"), F.regexp_replace(x, ANSI, "")).otherwise(x))


def densify_json(t: Column) -> Column:
    """Compact form with sorted keys if the whole trimmed text is JSON; only texts that could be are parsed."""
    may_be = lambda x: x.rlike(rf"^[{tx.WS}]*[{{\[\"0-9tfn-]") & F.right(tx.trim_end(x), F.lit(1)).rlike(r"[}\]\"0-9el]")
    return tx.bound(t, lambda x: F.when(may_be(x), F.coalesce(F.to_json(tx.json_value(tx.trim(x))), x)).otherwise(x))


def is_boilerplate(line: Column) -> Column:
    return (line != "") & (tx.trim(line).isin(SPINNERS) | line.rlike(RULE_LINE) | line.rlike(NPM_NOISE))


def usable(patterns: list[str] | None) -> list[str]:
    """Patterns that the engine that runs them (Java's) compiles; others are ignored."""
    out, spark = [], SparkSession.active() if patterns else None
    for p in patterns or []:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(p)
            out.append(p)
        except (Py4JJavaError, IllegalArgumentException):
            pass
    return out


def kept_lines(a: Column, boilerplate: bool = True, drop: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """Right-trimmed lines that are not boilerplate, match no drop and any keep pattern."""
    drop, keep = usable(drop), usable(keep)

    def fits(x: Column) -> Column:
        ok = ~is_boilerplate(x) if boilerplate else F.lit(True)
        for p in drop:
            ok = ok & ~x.rlike(p)
        if keep:
            hit = F.lit(False)
            for p in keep:
                hit = hit | x.rlike(p)
            ok = ok & hit
        return ok

    return F.filter(F.transform(a, tx.trim_end), fits)


def cap_blank(flat: Column, most: int = 1) -> Column:
    """Of a run of empty lines, leave the first ``most``."""
    if not most:
        return F.filter(flat, lambda x: x != "")
    return F.filter(flat, lambda x, i: (x != "") | (i < most) | F.exists(F.slice(flat, i - most + 1, most), lambda y: y != ""))


def right_trimmed(t: Column) -> Column:
    """All lines right-trimmed, with plain line breaks and none at the end, in one pass over the text."""
    return F.regexp_replace(tx.flat_lines(t), rf"[{tx.WS}&&[^\n]]++(?=\n|\z)", "")


def capped(t: Column, most: int = 1) -> Column:
    """``cap_blank`` for a whole text: a run of n empty lines is n + 1 line breaks."""
    if not most:
        return F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n"), r"\A\n|\n\z", "")
    padded = F.regexp_replace(F.concat(F.lit("\n"), t, F.lit("\n")), rf"\n{{{most + 2},}}", "\n" * (most + 1))
    return tx.bound(padded, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def with_filtered(df: DataFrame, source: Column, to: str, ansi: bool = True, collapse: bool = True, boilerplate: bool = True, json: bool = True, keep: list[str] | None = None, drop: list[str] | None = None, max_tokens: int | None = None, max_blank: int = 1) -> DataFrame:
    """Add the filtered text; each step is evaluated once a row.

    Single lines are looked at only where a pattern is given or some line may be boilerplate;
    trimming, white space and blank runs are passes over the whole text.
    """
    out = tx.once(df, to, strip_ansi(F.coalesce(source, F.lit(""))) if ansi else F.coalesce(source, F.lit("")))
    if json:
        out = tx.once(out, to, densify_json(F.col(to)))
    held = tx.unlines(kept_lines(tx.lines(F.col(to)), boilerplate, drop, keep))
    if not usable(drop) and not usable(keep):
        plain = right_trimmed(F.col(to))
        held = F.when(F.col(to).rlike(MAY_BE_NOISE), held).otherwise(plain) if boilerplate else plain
    out = tx.once(out, to, held)
    if collapse:
        out = tx.once(out, to, capped(F.regexp_replace(to, rf"[{tx.WS}&&[^\n]]+", " "), max_blank))
    return tx.once(out, to, tx.truncate(F.col(to), max_tokens)) if max_tokens is not None else out


def filter_lines(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Add content, metrics and lines_removed. One row in, one row out, no shuffle."""
    query, key = options.pop("query", None), options.pop("key", "doc_id")
    budget = options.get("max_tokens")
    if query and query.strip():
        options["max_tokens"] = None
    out = with_filtered(df, F.col(text), "content", **options)
    if query and query.strip():
        from .ranking import keep_lines

        out = keep_lines(out, query, "content", key, budget or tx.DEFAULT_MAX_TOKENS)
    return out.withColumn("metrics", tx.metrics(F.col(text), F.col("content"))).withColumn("lines_removed", F.greatest(F.size(tx.lines(F.col(text))) - F.size(tx.lines(F.col("content"))), F.lit(0)))
