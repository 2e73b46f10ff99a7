"""Parsers of text payloads into rows: transcripts, rerank items, pack sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_ROLE = r"(?i)^(user|assistant|system|human|ai):"


def transcript(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, turn, role, text) from a JSON list of {role, content}, else from role-prefixed lines.

    A turn goes from a line with a role to the next one; places are found once, in one pass.
    """
    parsed = F.from_json(F.col(text), "array<struct<role:string,content:string>>")
    rows, starts, ends = tx.free(df, "rows", "starts", "ends")
    out = tx.once(df, rows, tx.lines(F.col(text)))
    marks = F.filter(F.transform(rows, lambda x, i: F.when(tx.trim(x).rlike(_ROLE), i)), lambda i: i.isNotNull())
    out = tx.once(out, starts, F.array_distinct(F.concat(F.array(F.lit(0)), marks)))
    out = tx.once(out, ends, F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(rows))))

    def turn(a, b):
        own = F.slice(rows, a + 1, F.greatest(b - a, F.lit(0)))
        head = tx.trim(F.coalesce(F.get(own, F.lit(0)), F.lit("")))
        role = tx.ascii_lower(F.regexp_extract(head, _ROLE, 1))
        role = F.when(role == "human", "user").when(role == "ai", "assistant").when(role == "", "user").otherwise(role)
        return F.struct(role.alias("role"), tx.trim(F.regexp_replace(tx.unlines(own), rf"(?i)^[{tx.WS}]*(user|assistant|system|human|ai):", "")).alias("content"))

    by_line = F.filter(F.zip_with(starts, ends, turn), lambda t: t["content"] != "")
    out = out.select(key, F.posexplode(F.when(tx.trim(F.col(text)).startswith("[") & parsed.isNotNull(), parsed).otherwise(by_line)).alias("turn", "t"))
    return out.select(key, "turn", F.coalesce("t.role", F.lit("user")).alias("role"), F.col("t.content").alias("text"))


def rerank_items(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, index, id, text) from a JSON list of items or strings, else paragraphs, else lines."""
    t = F.col(text)
    items = F.from_json(t, "array<struct<id:string,text:string>>")
    plain = F.from_json(t, "array<string>")
    paras = F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), tx.trim), lambda x: x != "")
    rows = F.filter(F.transform(tx.lines(t), tx.trim), lambda x: x != "")
    bare = lambda a: F.transform(a, lambda x: F.struct(F.lit(None).cast("string").alias("id"), x.alias("text")))
    is_list = tx.trim(t).startswith("[")
    good = F.coalesce(F.exists(items, lambda x: x["text"].isNotNull()), F.lit(False))
    found = F.when(is_list & good, items).when(is_list & plain.isNotNull(), bare(plain)).when(F.size(paras) > 1, bare(paras)).otherwise(bare(rows))
    return df.select(key, F.posexplode(found).alias("index", "x")).select(key, "index", "x.id", "x.text")


def pack_sections(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, path, text) from ``path\\n---\\nbody`` sections between ``\\n===\\n``; else one input.txt."""
    parts = F.split(F.col(text), r"\n===\n")
    out = df.select(key, F.explode(parts).alias("p"))
    cut = F.instr("p", "\n---\n")
    return out.select(key, F.when(cut > 0, tx.trim(F.substring("p", F.lit(1), cut - 1))).otherwise("input.txt").alias("path"), F.when(cut > 0, F.substring("p", cut + 5, F.length("p"))).otherwise(F.col("p")).alias("text"))
