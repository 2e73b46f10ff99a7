"""What the training-data operators share: shared storage, Arrow slicing, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import new_path, remove, scratch, shared_dir, staged  # noqa: F401

#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
PASS_BYTES = 1 << 20
#: Bytes of an Arrow batch; bounds what the JVM and a Python worker hold of a task's texts.
BATCH_BYTES = 4 << 20

_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH_BYTES (a longer row is one by itself).

    Spark reads the bound from the session when the plan runs, so it is set there, unless the
    session has one of its own.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


# --------------------------------------------------------------------------- ordering
def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, key: str, blocks: int) -> list[int]:
    """At most ``blocks - 1`` ascending values that split ``key`` into even ranges."""
    if blocks < 2:
        return []
    steps = [i / blocks for i in range(1, blocks)]
    got = df.agg(F.percentile_approx(key, steps, max(1000, 20 * blocks)).alias("q")).first()["q"]
    return sorted(set(got or []))


def block_of(key: Column, cuts: list[int]) -> Column:
    """Index of the range that ``key`` falls into (null: 0), as a balanced tree of tests."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts)).cast("int")


# --------------------------------------------------------------------------- numpy
def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(salt << 20)) * _U(0x9E3779B97F4A7C15))


def runs(sizes: list[int], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit`` (one item at least)."""
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > limit:
            yield at, i
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a text column and their UTF-8 bytes (null: empty), made one pass at a time."""
    raw = texts.cast(pa.binary())
    for a, b in runs([n or 0 for n in pa.compute.binary_length(raw).to_pylist()], limit):
        yield a, b, [t or b"" for t in raw.slice(a, b - a).to_pylist()]


def utf8(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and the offsets of each text in them."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], ends))


def table_of(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = seeds(256, 77)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=_U)
    if n > 1:
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts.

    Returns the start and end of each word, the text it is in, and a 64-bit hash of it
    (a polynomial over byte seeds modulo 2**64, finalised).
    """
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    first[starts] = inside[starts]  # a text begins anew even right after another's last word
    ends = starts[starts > 0] - 1
    last[ends] = inside[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, a, side="right") - 1
    pre = np.zeros(n + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=pre[1:])
        h = mix64((pre[b] - pre[a]) * powers(_INV, n + 1)[a] + (b - a).astype(_U))
    return a, b, doc, h
