"""Scrubbing of command output by domain, then head and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .compression import any_of
from .filtering import densify_json, strip_ansi, with_filtered

#: Domain -> fragments of the lower-cased first 4000 characters, in order of precedence (fixed values).
DOMAIN_DROPS = {
    "cargo": [r"(?i)^ {4,}Compiling ", r"(?i)^ {4,}Downloading ", r"(?i)^ {4,}Downloaded ", r"(?i)^ {4,}Checking "],
    "npm": [r"(?i)^npm (warn|notice)", r"(?i)^deprecated "],
    "docker": [r"(?i)^[a-f0-9]{12}: (Waiting|Downloading|Extracting|Pull complete)"],
    "git": [r"(?i)^create mode ", r"(?i)^delete mode "],
}
DOCKER_PROGRESS = r"(?i)^[a-f0-9]{8,}:\s+(Waiting|Downloading|Extracting|Pull complete|Verifying)"
GIT_HEADS = ["diff --git", "index ", "--- ", "+++ ", "@@", "commit ", "Author:", "Date:"]


def detect_domain(t: Column) -> Column:
    sample = F.left(t, F.lit(4000))
    low, head = tx.ascii_lower(sample), tx.trim(sample)
    has = lambda *xs: any_of(low.contains(x) for x in xs)
    return (
        F.when(head.rlike(r"^[{\[]") & tx.json_value(head).isNotNull(), "json")
        .when(has("compiling ") & has("cargo", "finished `"), "cargo")
        .when(has("error[e", " --> src/"), "rustc")
        .when(has("diff --git", "git status") | low.startswith("commit "), "git")
        .when(has("npm warn") | (has("added ") & has("packages")), "npm")
        .when(has("digest:", "pulling fs layer", "sha256:"), "docker")
        .when(has("kubectl", "namespace/", "pod/"), "kubectl")
        .when(has("===== test session", "passed in"), "pytest")
        .when(has("gcc ", "collect2:"), "gcc")
        .otherwise("generic")
    )


def git_lines(a: Column) -> Column:
    """Headers, hunks, changes and the one line after a hunk header; other blank-led lines go."""
    head = lambda x: any_of(x.startswith(s) for s in GIT_HEADS)
    return F.filter(a, lambda x, i: head(x) | ~x.startswith(" ") | F.coalesce(F.get(a, i - 1).startswith("@@"), F.lit(False)))


def cargo_lines(a: Column) -> Column:
    """The first three Compiling lines (and any with error); downloads and checks go; a count leads."""
    compiling = lambda x: tx.trim_start(x).startswith("Compiling ")
    at = F.filter(F.transform(a, lambda x, i: F.when(compiling(x), i)), lambda i: i.isNotNull())
    n, third = F.size(at), F.coalesce(F.get(at, F.lit(2)), F.size(a))
    gone = lambda x: any_of(x.startswith(s) for s in ("Downloading ", "Downloaded ", "Checking "))
    # the third place is found once, in front of the filter that uses it
    kept = F.flatten(F.transform(F.array(third), lambda last: F.filter(a, lambda x, i: F.when(compiling(x), (i <= last) | x.contains("error")).otherwise(~gone(tx.trim_start(x))))))
    return F.when(n > 3, F.concat(F.array(F.concat(F.lit("…["), n.cast("string"), F.lit(" Compiling lines collapsed]"))), kept)).otherwise(kept)


def npm_lines(a: Column) -> Column:
    return F.filter(a, lambda x: ~any_of(tx.ascii_lower(x).startswith(s) for s in ("npm warn", "npm notice", "deprecated ")))


def docker_lines(a: Column) -> Column:
    return F.filter(a, lambda x: ~x.rlike(DOCKER_PROGRESS))


def kubectl_lines(a: Column) -> Column:
    def three(x: Column) -> Column:
        parts = F.split(tx.trim(x), rf"[{tx.WS}]+")
        return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) != "NAME"), F.array_join(F.slice(parts, 1, 3), " ")).otherwise(x)

    return F.transform(a, three)


def rustc_lines(a: Column) -> Column:
    return F.filter(a, lambda x: ~any_of(tx.trim_start(x).startswith(s) for s in ("= note: `#[warn", "= help: consider")))


def pytest_lines(a: Column) -> Column:
    return F.filter(a, lambda x: ~(tx.trim(x).endswith(" PASSED") & ~x.contains("FAILED")))


def gcc_lines(a: Column) -> Column:
    return F.filter(a, lambda x: any_of(tx.ascii_lower(x).contains(s) for s in ("error", "warning", "undefined")) | ~tx.ascii_lower(x).contains("in function"))


LINES = {"git": git_lines, "cargo": cargo_lines, "npm": npm_lines, "docker": docker_lines, "kubectl": kubectl_lines, "rustc": rustc_lines, "pytest": pytest_lines, "gcc": gcc_lines}


def head_tail(t: Column, head: int = 40, tail: int = 40) -> Column:
    a = tx.lines(t)
    n = F.size(a)
    end = F.slice(a, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)) if tail else F.array().cast("array<string>")
    parts = F.concat(F.slice(a, 1, head), F.array(F.concat(F.lit("…["), (n - head - tail).cast("string"), F.lit(" lines omitted]…"))), end)
    return F.when(n > head + tail + 1, F.concat(tx.unlines(parts), F.lit("\n"))).otherwise(t)


def head_tail_tokens(t: Column, max_tokens: int) -> Column:
    half = max_tokens * tx.CHARS_PER_TOKEN // 2
    cut = F.concat(F.left(t, F.lit(half)), F.lit("\n…[truncated]…\n"), F.right(t, F.lit(half)))
    return F.when((tx.token_count(t) <= max_tokens) | (F.length(t) <= 2 * half), t).otherwise(cut)


def _without(t: Column, drop: list[str]) -> Column:
    return tx.unlines(F.filter(tx.lines(t), lambda x: ~any_of(tx.trim_end(x).rlike(p) for p in drop)))


def compress_output(df: DataFrame, text: str = "text", domain: str = "auto", max_tokens: int | None = None, keep_head_tail: bool = True, head: int = 40, tail: int = 40) -> DataFrame:
    """Add domain, content, lines_in, lines_out, metrics."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = tx.once(df, "domain", detect_domain(t) if domain == "auto" else F.lit(domain))
    body = F.lit(None).cast("string")
    for name, fn in LINES.items():
        body = F.when(F.col("domain") == name, tx.unlines(fn(tx.lines(t)))).otherwise(body)
    body = F.when(F.col("domain") == "json", densify_json(t)).otherwise(F.coalesce(body, t))
    (held,) = tx.free(df, "body")
    out = tx.once(out, held, body)
    body = F.col(held)
    for name, drop in DOMAIN_DROPS.items():  # these patterns see right-trimmed lines, before white space collapses
        body = F.when(F.col("domain") == name, _without(strip_ansi(F.col(held)), drop)).otherwise(body)
    out = with_filtered(tx.once(out, held, body), F.col(held), "content", json=False)
    if keep_head_tail:
        out = tx.once(out, "content", head_tail(F.col("content"), head, tail))
    if max_tokens is not None:
        out = tx.once(out, "content", head_tail_tokens(F.col("content"), max_tokens))
    return out.withColumn("lines_in", F.size(tx.lines(t))).withColumn("lines_out", F.size(tx.lines(F.col("content")))).withColumn("metrics", tx.metrics(t, F.col("content"))).drop(held)
