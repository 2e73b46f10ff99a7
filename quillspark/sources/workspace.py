"""Files of a directory tree as rows: path, kind, bytes, modification time, text."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_floor, free, once

#: Folders and lock files that are never read, and extensions by kind (fixed values).
SKIP_DIRS = [".git", "node_modules", "target", "dist", "build", ".next"]
BARE_NAMES = ["dockerfile", "makefile", "gemfile", "procfile", "cmakelists.txt"]
IGNORE_FILES = [".gitignore", ".ignore"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock"]
DOC_EXT = "md txt rst adoc".split()
CODE_EXT = "rs ts tsx js jsx mjs cjs py go java kt c h cpp hpp cc cs rb php sql svelte vue swift scala dart ex exs zig".split()
READ_EXT = "rs ts tsx js jsx mjs cjs py md toml json yaml yml go java kt c h cpp hpp cc cs rb php sql sh bash zsh svelte vue css scss html txt xml gradle cmake swift m mm r lua pl pm ex exs erl hs scala dart proto graphql tf hcl nix zig gd wgsl".split()

#: Window size, windows of a file, bytes of a file that are looked at, and what parts windows.
WINDOW, MOST_WINDOWS, READ_BYTES = 80 * 1024, 3, 2 << 20
WINDOW_BREAK = "\n\n/* --- window --- */\n\n"


def kind(path: Column) -> Column:
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    doc = name.rlike(r"^(roadmap|architecture)") | name.isin("changelog.md", "todo.md") | low.rlike("(^|/)docs/") | ext.isin(DOC_EXT)
    return F.when(doc, "doc").when(ext.isin(CODE_EXT), "code").otherwise("other")


def mtime_boost(mtime: Column, now: Column) -> Column:
    """0.35 for a file changed now, falling to 0 at 90 days; times are seconds."""
    age = F.greatest(now - mtime, F.lit(0)) / 86400.0
    return F.greatest(0.35 * (1 - F.least(age / 90.0, F.lit(1.0))), F.lit(0.0))


def checked_root(root: str, allowed: str | None = None) -> str:
    """The root, if it is ``allowed`` or lies below it; raises otherwise."""

    def place(p: str) -> tuple[str, str]:
        scheme, _, path = p.rpartition("://") if "://" in p else ("file", "", p.removeprefix("file:"))
        return scheme, os.path.realpath(path) if scheme == "file" else posixpath.normpath(path)

    if allowed:
        (s, p), (t, top) = place(root), place(allowed)
        if s != t or (p != top and not p.startswith(top.rstrip("/") + "/")):
            raise ValueError(f"root {root} is outside {allowed}")
    return root


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[bool, str]]:
    """(ignored or taken back, pattern) of the ignore files at the root, in order; Spark's reader hides dot files."""
    jvm, out = spark.sparkContext._jvm, []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            continue
        stream = fs.open(path)
        try:
            raw = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out += [ignore_rule(x.rstrip()) for x in raw.splitlines() if x.strip() and not x.startswith("#")]
    return out


def ignore_rule(line: str) -> tuple[bool, str]:
    """A line of an ignore file as a regular expression over relative paths."""
    taken_back, line = line.startswith("!"), line.removeprefix("!")
    folder, body = line.endswith("/"), line.rstrip("/")
    anchored, body = "/" in body, body.removeprefix("/")
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    rule = "".join(wild.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", body) if p)
    return not taken_back, ("^" if anchored else "(?:^|/)") + rule + ("/" if folder else "(?:/|$)")


def query_windows(df: DataFrame, query: str, budget: int, big: Column, text: str = "text") -> DataFrame:
    """Replace texts of ``big`` rows by their best windows for the query, in document order.

    Overlapping windows of a text are ranked against one another; the best three with a
    positive score stay (evenly spaced ones if none has), within ``budget`` bytes. Windows
    are cut at characters. All in the row, so a text never leaves its task.
    """
    from ..operators.ranking import query_terms, with_line_scores

    terms, size = query_terms(query), min(WINDOW, max(budget, 1024))
    step = max(size * 3 // 4, 1024)
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < F.length(t)))
    parts, scores, chosen = free(df, "windows", "scores", "chosen")
    out = once(df.withColumn(chosen, big), parts, F.when(F.col(chosen), F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>")))
    out = with_line_scores(out, parts, terms, scores)
    n = F.size(parts)
    every = F.greatest(F.floor(n / F.greatest(F.least(n, F.lit(MOST_WINDOWS)), F.lit(1))).cast("int"), F.lit(1))
    best = F.slice(F.array_sort(F.filter(F.transform(scores, lambda s, i: F.struct((-s).alias("o"), i.alias("i"))), lambda x: x["o"] < 0)), 1, MOST_WINDOWS)
    spaced = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i % every == 0) & (i < every * MOST_WINDOWS))
    picked = F.when(F.exists(scores, lambda s: s > 0), F.array_sort(F.transform(best, lambda x: x["i"]))).otherwise(spaced)
    out = once(out, parts, F.transform(picked, lambda i: F.get(parts, i)))

    def add(acc: Column, w: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        full = acc["full"] | ((F.octet_length(w) > left) & (F.size(acc["out"]) > 0))
        more = byte_floor(w, left)
        return F.when(full, F.struct(acc["out"].alias("out"), acc["used"].alias("used"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(acc["out"], F.array(more)).alias("out"), (acc["used"] + F.octet_length(more)).alias("used"), F.lit(False).alias("full")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    joined = F.array_join(F.aggregate(parts, start, add, lambda s: s["out"]), WINDOW_BREAK)
    return once(out, text, F.when(F.col(chosen), joined).otherwise(F.col(text))).drop(parts, scores, chosen)


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, max_file_bytes: int | None = None, query: str | None = None, allowed_root: str | None = None) -> DataFrame:
    """Text files below ``root``: path (relative), kind, bytes, mtime, text, truncated.

    Empty files, files with NUL bytes and invalid UTF-8 are left out, as is what ignore
    files at the root name. Listing and reading are Spark's, so any file system works; only
    the columns that are used are read. Files above ``max_file_bytes`` are cut, or with a
    ``query`` give their best windows out of the first 2 MiB.
    """
    checked_root(root, allowed_root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), f"^{base}/", "")
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    out = raw.withColumn("rel", rel).where(~F.col("rel").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/"))
    name = F.regexp_extract("rel", r"([^/]*)$", 1)
    out = out.where(~name.isin(SKIP_FILES) & (ext.isin(extensions or READ_EXT) | F.lower(name).isin(BARE_NAMES)))
    gone = F.lit(False)
    for ignored, rule in ignore_rules(spark, root):
        gone = F.when(F.col("rel").rlike(rule), F.lit(ignored)).otherwise(gone)
    out = out.where(~gone)
    out = out.where((F.col("length") > 0) & F.is_valid_utf8(F.col("content").cast("string")))
    text = F.col("content").cast("string")
    out = out.where(F.instr(text, "\0") == 0)
    most = READ_BYTES if max_file_bytes and query else max_file_bytes
    cut = byte_floor(text, most) if most else text
    found = out.select(F.col("rel").alias("path"), kind(F.col("rel")).alias("kind"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"), cut.alias("text"), (F.col("length") > F.lit(max_file_bytes or 1 << 62)).alias("truncated"))
    return query_windows(found, query, max_file_bytes, F.col("truncated")) if max_file_bytes and query else found
