"""Action names to operators: ``run("filter", df, ...)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import archive, brief, catalog, chunking, compression, filtering, history, output, ranking, sanitize, state, summarize


def count_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"tokens": tx.token_count(t), "chars": F.length(t), "bytes": F.octet_length(t), "backend": F.lit("heuristic")})


ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "filter": filtering.filter_lines, "compress": compression.compress, "compress_output": output.compress_output, "summarize": summarize.summarize,
    "summarize_smart": summarize.summarize_smart, "filter_relevant": ranking.filter_relevant, "prune_history": history.prune_history, "chunk": chunking.chunk,
    "resolve": chunking.resolve, "count_tokens": count_tokens, "stats": state.session_stats, "cache_store": state.cache_put, "cache_get": state.cache_get,
    "cache_invalidate": state.cache_invalidate, "sanitize": sanitize.sanitize, "rerank": ranking.rerank, "brief": brief.briefing, "catalog": catalog.catalog,
    "help": catalog.help_for, "playbooks": catalog.playbooks, "playbook": catalog.playbook, "pack": archive.pack, "unpack": archive.unpack, "llm_status": catalog.llm_status,
}

#: Actions whose texts may be scrubbed first.
SCRUBBABLE = {"filter", "compress", "compress_output", "summarize", "summarize_smart", "filter_relevant"}


def run(action: str, df, *args, sanitize_input: bool = False, text: str = "text", **options) -> DataFrame:
    """Run an action by name; ``sanitize_input`` scrubs the text column of text actions first."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action}")
    if action in SCRUBBABLE:
        df = df.withColumn(text, tx.trim(F.col(text)))
        if sanitize_input:
            df = df.withColumn(text, sanitize.scrub(F.col(text)))
        options["text"] = text
    return ACTIONS[action](df, *args, **options)
