"""Byte-pair encoding and decoding over a contiguous rank array per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import bpe
from .common import runs, table_of


class Codec:
    """Encode whole texts to packed little-endian 32-bit ids, and back."""

    def __init__(self, path: str):
        self.v, self.table = bpe.vocabulary(path), bpe.rank_array_ids(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, cuts = self.table.values(texts)
        whole, cuts = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, packed: bytes) -> str:
        piece = self.v.piece.__getitem__
        return b"".join(map(piece, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", digests_only: bool = False, packed: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns key as ``doc_id``, ``n_tokens``, ``ids`` (array of int) and ``decoded``, or with
    ``digests_only`` the SHA-256 of the packed ids and of the decoded text in their place.
    ``packed`` gives ``ids`` as packed little-endian 32-bit ids (binary) and both digests.
    Null and empty texts give no ids and an empty text; a null key stays null; repeated
    rows each give a row; other columns are ignored, whatever their names. No shuffle.
    """
    tail = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    kinds = [pa.string(), pa.string()] if digests_only else [pa.list_(pa.int32()), pa.string()]
    if packed:
        tail, kinds = "ids binary, ids_sha256 string, decoded_sha256 string", [pa.binary(), pa.string(), pa.string()]
    names = [x.split()[0] for x in tail.split(", ")]
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in runs([x or 0 for x in pa.compute.binary_length(texts).to_pylist()]):
                ids = codec.encode(texts.slice(a, b - a).to_pylist())
                back = [codec.decode(p) for p in ids]
                if digests_only or packed:
                    digests = [[hashlib.sha256(p).hexdigest() for p in ids], [hashlib.sha256(t.encode()).hexdigest() for t in back]]
                    columns = [ids, *digests] if packed else digests
                else:
                    columns = [[np.frombuffer(p, "<i4") for p in ids], back]
                yield table_of({"doc_id": batch.column(0).slice(a, b - a), "n_tokens": [len(p) // 4 for p in ids], **dict(zip(names, columns, strict=True))}, out)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {tail}")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Texts of id arrays or packed ids; null ones give empty texts, invalid byte sequences U+FFFD."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(x if isinstance(x, bytes) else np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield table_of({"doc_id": batch.column(0), "text": texts}, out)

    return df.select(df[key].cast("long").alias("doc_id"), df[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")
