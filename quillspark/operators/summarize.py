"""Heuristic summaries: conversations, file trees and outlines."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .compression import any_of

ROLES = [("user", ("user:", "**user**")), ("assistant", ("assistant:", "**assistant**")), ("system", ("system:", "**system**"))]
TREE = "│├└─|`+- "


def detect_mode(t: Column) -> Column:
    a = tx.lines(t)
    path = F.filter(F.transform(a, tx.trim), lambda x: x.contains("/") & (x.endswith("/") | x.contains(".") | any_of(x.startswith(s) for s in ("├", "│", "└", "- "))))
    role = F.filter(a, lambda x: any_of(tx.ascii_lower(x).startswith(s) for s in ("user:", "assistant:", "system:", "**user**", "**assistant**")))
    return F.when(F.size(path) >= 5, "filetree").when(F.size(role) >= 2, "conversation").otherwise("outline")


def heading_level(line: Column) -> Column:
    """1 to 6 for that many #, 1 for a short line whose letters are all capitals, else null."""
    marks = F.length(F.regexp_extract(line, "^#*", 0))
    caps = (F.octet_length(line) < 60) & line.rlike(r"\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return F.when(marks.between(1, 6), marks).when(caps, 1)


def key_phrases(t: Column, limit: int) -> Column:
    long = F.filter(F.transform(tx.lines(t), tx.trim), lambda x: F.octet_length(x) > 20)
    return F.transform(F.slice(long, 1, limit), lambda x: tx.first_sentence(x, 120))


# ------------------------------------------------------------------ whole summaries (nested, so not a single expression)
def _sentence(t: str, most: int) -> str:
    flat = t.replace("\n", " ")
    head = re.match(r"[^.!?]*[.!?]?", flat).group().encode()[:most].decode("utf-8", "ignore")
    return head.strip() + ("…" if len(head) < len(flat) else "")


def _phrases(t: str, n: int) -> list[str]:
    return [_sentence(x, 120) for x in (y.strip() for y in t.splitlines()) if len(x.encode()) > 20][:n]


def _lines(t: str) -> list[str]:
    return [x.removesuffix("\r") for x in t.removesuffix("\n").split("\n")] if t else []


def _talk(t: str, depth: int, most: int):
    turns, role, body = [], "narration", []
    for line in [*_lines(t), None]:
        low = "" if line is None else line.strip().lower()
        new = next((r for r, marks in ROLES if low.startswith(marks)), None)
        if line is None or new:
            if text := "\n".join(body).strip():
                turns.append((role, text))
            role, body = new, [line.partition(":")[2].strip()] if line and ":" in line else []
        else:
            body.append(line)
    yield 1, f"Conversation ({len(turns)} turns)", [f"T{i} [{r}]: {_sentence(b, 160)}" for i, (r, b) in enumerate(turns, 1)][: 2 * most]
    for i, (r, b) in enumerate(turns, 1) if depth > 1 else ():
        yield 2, f"Turn {i} ({r})", _phrases(b, most)


def _tree(t: str, depth: int, most: int):
    dirs, ext = [], Counter()
    for line in _lines(t):
        name = line.strip().lstrip(TREE).strip()
        if not name:
            continue
        if name.endswith("/") or "." not in name:
            dirs.append((len(re.match(r"[\s│|]*", line).group()) // 2, name.rstrip("/")))
        else:
            ext[name.rpartition(".")[2].lower()] += 1
    yield 1, "File tree", [f"{ext.total()} files across {len(dirs)} directories", *(f".{e}: {n}" for e, n in sorted(ext.items())[:most])]
    for top in [d for at, d in dirs if at <= 1][:most] if depth > 1 else ():
        yield 2, top, [d for at, d in dirs if at > 0 and d.startswith(top)][:4]


def _level(line: str) -> int | None:
    marks = len(line) - len(line.lstrip("#"))
    letters = [c for c in line if c.isalpha()]
    return marks if 1 <= marks <= 6 else 1 if letters and len(line.encode()) < 60 and all(c.isupper() for c in letters) else None


def _outline(t: str, depth: int, most: int):
    found: list[tuple[int, str, list[str]]] = []
    for line in filter(None, (x.strip() for x in _lines(t))):
        if level := _level(line):
            found.append((level, line.lstrip("#").strip().rstrip(":"), []))
        elif found and len(found[-1][2]) < most and (s := _sentence(line.lstrip("-*• "), 140)):
            found[-1][2].append(s)
    if not found:
        parts = [p for p in (x.strip() for x in t.split("\n\n")) if p][:most]
        found = [(1, f"Section {i}", _phrases(p, min(4, most))) for i, p in enumerate(parts, 1)]
    yield from found


def sections(t: str, mode: str, depth: int, most: int) -> list[tuple[int, str, list[str]]]:
    """Level, title and bullets of every section in reading order."""
    return list({"conversation": _talk, "filetree": _tree}.get(mode, _outline)(t, depth, most))


def render(found: list[tuple[int, str, list[str]]], depth: int) -> str:
    """Sections down to a level; what lies under a deeper one is left out with it."""
    out, path = [], []
    for level, title, bullets in found:
        while path and path[-1] >= level:
            path.pop()
        path.append(level)
        if max(path) > depth:
            continue
        pad = "  " * (level - 1)
        out += [f"{pad}{'#' * level} {title}", *(f"{pad}- {b}" for b in bullets)]
    return "".join(x + "\n" for x in out)


@F.pandas_udf(T.StringType())
def _summary(t: pd.Series, mode: pd.Series, depth: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else render(sections(x, m, d, k), d) for x, m, d, k in zip(t, mode, depth, most, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType().add("level", T.IntegerType()).add("title", T.StringType()).add("bullets", T.ArrayType(T.StringType()))))
def _sections(t: pd.Series, mode: pd.Series, depth: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([[{"level": a, "title": b, "bullets": c} for a, b, c in sections(x or "", m, d, k)] for x, m, d, k in zip(t, mode, depth, most, strict=True)])


def with_sections(df: DataFrame, text: str = "text", mode: str = "auto", max_depth: int = 3, max_bullets: int = 8) -> DataFrame:
    """Add sections: level, title and bullets in reading order, before any budget."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("sections", _sections(t, detect_mode(t) if mode == "auto" else F.lit(mode), F.lit(max_depth), F.lit(max_bullets)))


def summarize_text(t: Column, mode: Column, depth: Column, most: Column, max_tokens: Column | None = None) -> Column:
    s = _summary(t, mode, depth, most)
    if max_tokens is None:
        return s
    cut = tx.byte_floor(s, (max_tokens * tx.CHARS_PER_TOKEN).cast("int"))
    at = F.when(cut.contains("\n"), F.regexp_extract(cut, r"(?s)^(.*)\n", 1)).otherwise(cut)
    return F.when(tx.token_count(s) <= max_tokens, s).otherwise(F.concat(at, F.lit("\n…")))


def summarize(df: DataFrame, text: str = "text", mode: str = "auto", max_depth: int = 3, max_bullets: int = 8, max_tokens: int | None = None, force: bool = False) -> DataFrame:
    """Add mode, summary, bypassed, metrics. Trees are flat sections by level, as Spark has no recursive types."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("bypassed", (F.length(t) < tx.BYPASS_CHARS) & F.lit(not force)).withColumn("mode", detect_mode(t) if mode == "auto" else F.lit(mode))
    s = summarize_text(F.when(~F.col("bypassed"), t), F.col("mode"), F.lit(max_depth), F.lit(max_bullets), F.lit(max_tokens) if max_tokens is not None else None)
    return out.withColumn("summary", F.when(F.col("bypassed"), t).otherwise(s)).withColumn("metrics", tx.metrics(t, F.col("summary")))


def summarize_smart(df: DataFrame, text: str = "text", query: str | None = None, **options) -> DataFrame:
    """The summary by heuristics, of the lines that matter to the query if one is given; names its backend."""
    from .ranking import keep_lines

    (held,) = tx.free(df, "source_text")
    src = df.withColumn(held, F.coalesce(F.col(text), F.lit("")))
    src = keep_lines(src, query, held) if query else src
    out = summarize(src, held, **options).drop(held)
    return out.withColumns({"backend": F.lit("heuristic"), "fallback_reason": F.lit("no model configured"), "deterministic": F.lit(True)})
