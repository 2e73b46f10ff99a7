"""Token counts by heap-and-linked-list byte-pair merging, emitting no identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import bpe
from .common import runs, table_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Count the tokens of every whole text.

    A word's count is its initial symbols minus the merges that pop from the heap; a
    text's count is the sum over its words, and special strings in it count one each. Words
    met before are looked up (``word_table``), in memory that is bounded by bytes.
    Null and empty texts have 0 tokens and 0 bytes; a null key stays null; repeated rows
    each give a row; other columns are ignored, whatever their names. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.heap_counts(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
            for a, b in runs(sizes):
                each, cuts = table.values(texts.slice(a, b - a).to_pylist())
                n = np.diff(np.concatenate(([0], np.cumsum(each, dtype=np.int64)))[cuts])
                yield table_of({"doc_id": batch.column(0).slice(a, b - a), "n_bytes": sizes[a:b], "n_tokens": n, "over_limit": n > limit}, _OUT)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(count, SCHEMA)
