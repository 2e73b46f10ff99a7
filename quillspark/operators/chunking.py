"""Chunks with references, and their resolution."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

_WORD = regex.compile(tx.WORD)
_CHUNKS = "array<struct<index:int,start_offset:long,end_offset:long,content:string>>"


def estimate(t: str) -> int:
    return max(-(-len(t) // 4), (13 * len(_WORD.findall(t)) + 9) // 10, 1) if t else 0


def _segments(t: str) -> list[str]:
    """Runs of lines, broken before headings and fences and at blank lines (which are left out)."""
    if not t:
        return [""]
    out: list[list[str]] = [[]]
    for line in t.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        if (not line.strip() or line.lstrip().startswith(("#", "```"))) and out[-1]:
            out.append([])
            if not line.strip():
                continue
        out[-1].append(line)
    return ["\n".join(x) + "\n" for x in out if x] or [t]


def _prefix(raw: bytes, n: int) -> int:
    """Bytes of the longest whole-character prefix within n."""
    return len(raw[:n].decode("utf-8", "ignore").encode())


def _overlap(t: str, n: int) -> str:
    tail = t.encode()[-n:].decode("utf-8", "ignore") if n else ""
    return tail.partition("\n")[2] if "\n" in tail else tail


def pack(t: str, size: int, overlap: int, semantic: bool) -> Iterator[tuple[int, int, str]]:
    """Start, end and content of each chunk, cut where the estimate calls for it."""
    budget, lap = size * 4, overlap * 4
    held, start, at = "", 0, 0
    for piece in _segments(t) if semantic else [t]:
        if held and estimate(held) + estimate(piece) > size and len(held) >= budget // 2:
            yield start, at, held
            held = _overlap(held, lap)
            start = at - len(held.encode())
        if not held:
            start = at
        held = f"{held}\n{piece}" if held else piece
        at += len(piece.encode()) + 1
        while estimate(held) > 2 * size:
            raw = held.encode()
            cut = _prefix(raw, budget)
            line = raw[:cut].rfind(b"\n")
            cut = line + 1 if line > cut / 3 else max(cut, 1)
            head, tail = raw[:cut].decode(), raw[cut:].decode()
            yield start, start + cut, head
            keep = _overlap(head, lap)
            start += cut - len(keep.encode())
            held = f"{keep}\n{tail}" if keep and tail else keep + tail
    if held:
        yield start, len(t.encode()), held


def chunk(df: DataFrame, text: str = "text", key: str = "doc_id", chunk_tokens: int = 512, overlap_tokens: int = 64, semantic: bool = True) -> DataFrame:
    """Rows: key, source, content_hash, chunk_id, index, offsets, tokens, preview, content.

    Where a chunk ends depends on where the last one ended, so packing is an Arrow UDF.
    """

    @F.pandas_udf(_CHUNKS)
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"index": i, "start_offset": a, "end_offset": b, "content": c} for i, (a, b, c) in enumerate(pack(t or "", chunk_tokens, overlap_tokens, semantic))])

    h = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    out = df.select(key, F.concat(F.lit("mem://"), h(F.col(text))).alias("source"), h(F.col(text)).alias("content_hash"), F.explode(packed(F.col(text))).alias("c"))
    c = F.col("c.content")
    return out.select(
        key, "source", "content_hash", F.concat(F.lit("cmp://"), F.left(h(F.concat_ws(":", F.col(key), F.col("source"))), F.lit(8)), F.lit("/"), F.col("c.index")).alias("chunk_id"), F.col("c.index").alias("index"), F.col("c.start_offset").alias("start_offset"), F.col("c.end_offset").alias("end_offset"),
        tx.token_count(c).alias("tokens"), F.when(F.length(c) > 96, F.concat(F.left(c, F.lit(96)), F.lit("…"))).otherwise(c).alias("preview"), c.alias("content"),
    )


def chunk_fixed(df: DataFrame, text: str = "text", key: str = "doc_id", chars: int = 2048, overlap: int = 256) -> DataFrame:
    """Windows of fixed length: key, index, start, content. Array functions only."""
    n, step = F.length(F.col(text)), chars - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0)))
    out = df.where(n > 0).select(key, text, F.posexplode(starts).alias("index", "_k"))
    return out.select(key, "index", (F.col("_k") * step).alias("start"), F.substring(F.col(text), F.col("_k") * step + 1, F.lit(chars)).alias("content"))


def resolve(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Find each wanted ``id`` among chunk ids, else by its numeric suffix in the ``key`` it names."""
    exact = wanted.join(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("c1")), "id", "left")
    key = chunks.columns[0]
    suffix = F.regexp_extract("id", r"/([0-9]+)$", 1).try_cast("int")
    by_index = chunks.select(F.col(key).alias("_k"), F.col("index").alias("_i"), F.col("content").alias("c2"))
    out = exact.join(by_index, (F.col(key) == F.col("_k")) & (suffix == F.col("_i")), "left") if key in wanted.columns else exact.withColumn("c2", F.lit(None).cast("string"))
    content = F.coalesce("c1", "c2")
    return out.select(*wanted.columns, content.isNotNull().alias("found"), content.alias("content"))
