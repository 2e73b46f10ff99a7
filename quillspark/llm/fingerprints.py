"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, cut_points, mix64, runs, seeds, shuffle_partitions, table_of, utf8

_U = np.uint64
#: Least phrase names kept of levels 1, 2 and 3 and above, and the fewest that level is compared by.
KEEP, ENOUGH = (8, 24, 64), (0, 8, 24)
MAX_LEVELS = 24

_BYTE_NAME = seeds(256, 3)
_PLACE = seeds(64, 5) | _U(1)


def _toss(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Deterministic coin: twice the lowest bit in which x differs from y, plus x's bit there."""
    d = x ^ y
    low = np.bitwise_count((d & (~d + d.dtype.type(1))) - d.dtype.type(1))
    low = np.minimum(low, d.dtype.itemsize * 8 - 1).astype(x.dtype)
    return (2 * low + ((x >> low) & d.dtype.type(1))).astype(np.uint8)


def _pair_table(size: int) -> np.ndarray:
    x, y = np.meshgrid(np.arange(size, dtype=np.uint8), np.arange(size, dtype=np.uint8), indexing="ij")
    return np.where(x == y, 0, _toss(x, y)).astype(np.uint8)


#: Tosses of labels below 128, then below 16, then below 8, until they are below 6.
_NEXT = [_pair_table(128), _pair_table(16), _pair_table(8)]


def _parse(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: runs become one symbol each, coins mark phrase starts, phrases get names.

    Which symbols start a phrase depends on a few symbols around them alone, so equal
    substrings are cut alike wherever they stand, but for a few symbols at their ends.
    """
    head = np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(head)
    count = np.diff(np.concatenate((at, [len(names)])))
    names, doc = names[at], doc[at]
    with np.errstate(over="ignore"):
        many = count > 1
        names = names.copy()
        names[many] = mix64(names[many] ^ (count[many].astype(_U) * _U(0x9E3779B97F4A7C15)))
        n = len(names)
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        label = np.zeros(n, dtype=np.uint8)
        label[1:] = _toss(names[1:], names[:-1])
        label[first] = (names[first] & _U(127)).astype(np.uint8)
        for table in _NEXT:
            label[1:] = table[label[1:], label[:-1]]
            label[first] = (names[first] & _U(7 if table.shape[0] > 8 else 3)).astype(np.uint8)  # of its own text alone
        start = first.copy()
        if n > 2:
            mid, left, right = label[1:-1], label[:-2], label[2:]
            start[1:-1] |= (mid > left) & (mid >= right) & ~first[2:]
        two = start[1:] & first[:-1] & ~first[1:]
        start[1:] &= ~two  # a text's first phrase has two symbols at least
        begin = np.flatnonzero(start)
        place = np.arange(n) - np.repeat(begin, np.diff(np.concatenate((begin, [n]))))
        total = np.add.reduceat(mix64(names) * _PLACE[place & 63], begin) if n else names
    return mix64(total), doc[begin]


def _least(names: np.ndarray, doc: np.ndarray, docs: int, keep: int) -> list[np.ndarray]:
    """The ``keep`` least distinct names of each text (top 32 bits), as a filter before a sort.

    Names are uniform, so a text with c of them has its least below about 3 keep / c of the
    range; texts where that leaves too few (many repeats) are taken whole.
    """
    count = np.bincount(doc, minlength=docs)
    bound = np.minimum(1.0, (3.0 * keep + 32) / np.maximum(count, 1))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * docs
    short = names >> _U(32)
    todo = count > 0
    while todo.any():
        at = todo[doc] & (short < (bound * 4294967296.0)[doc])
        key = np.unique(doc[at].astype(_U) << _U(32) | short[at])
        of = (key >> _U(32)).astype(np.int64)
        begin = np.searchsorted(of, np.arange(docs + 1))
        for d in np.flatnonzero(todo):
            got = key[begin[d] : begin[d + 1]]
            if len(got) >= keep or bound[d] >= 1.0:
                out[d] = (got[:keep] & _U(0xFFFFFFFF)).astype(np.uint32)
                todo[d] = False
        bound[todo] = 1.0
    return out


class Fingerprints:
    """Sketches of texts: of each level its least names, and the name of the whole text."""

    def __init__(self, texts: list[bytes]):
        docs = len(texts)
        data, offsets = utf8(texts)
        doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(offsets))
        names = _BYTE_NAME[data]
        self.root = np.zeros(docs, dtype=_U)
        levels: list[list[np.ndarray]] = []
        upper_names, upper_docs = [], []
        for level in range(1, MAX_LEVELS + 1):
            if len(names):
                names, doc = _parse(names, doc)
            if level < 3:
                levels.append(_least(names, doc, docs, KEEP[level - 1]))
            else:
                upper_names.append(names), upper_docs.append(doc)
            count = np.bincount(doc, minlength=docs)
            done = (count == 1)[doc]
            if level >= 3:
                self.root[doc[done]] = names[done]  # one name is left: the whole text's
                names, doc = names[~done], doc[~done]
            if not len(names):
                break
        with np.errstate(over="ignore"):
            np.add.at(self.root, doc, names)  # only texts deeper than MAX_LEVELS
        levels.append(_least(np.concatenate(upper_names), np.concatenate(upper_docs), docs, KEEP[2]) if upper_names else [np.zeros(0, dtype=np.uint32)] * docs)
        self.levels = levels if len(levels) == 3 else [*levels, *[[np.zeros(0, dtype=np.uint32)] * docs] * (3 - len(levels))]

    def text(self, i: int) -> str:
        """``root:level 1:level 2:levels 3 and above`` in hexadecimal."""
        return ":".join([f"{int(self.root[i]):016x}", *(x[i].astype(">u4").tobytes().hex() for x in self.levels)])


def likeness(a: str, b: str) -> float:
    """Resemblance of the phrase names of two fingerprints, 0 to 1; 1 if the texts are equal.

    The highest level of which both have enough names is compared: of the least names of
    the union, the share that both have.
    """
    if a == b:
        return 1.0
    xs, ys = a.split(":"), b.split(":")
    for level in (3, 2, 1):
        x, y = (np.frombuffer(bytes.fromhex(z[level]), ">u4") for z in (xs, ys))
        if min(len(x), len(y)) >= max(ENOUGH[level - 1], 1):
            keep = KEEP[level - 1]
            union = np.union1d(x, y)
            union = union[:keep] if max(len(x), len(y)) >= keep else union
            shared = np.intersect1d(x, y, assume_unique=True)
            return float((shared <= union[-1]).sum() / len(union))
    return 0.0


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint of every whole text: doc_id, n_chars, fingerprint. No shuffle.

    Null texts count as empty; the empty text has a fingerprint of no names; equal texts
    have equal fingerprints; repeated rows each give a row; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in runs([len(t) for t in texts], 1 << 19):
                f = Fingerprints([t.encode() for t in texts[a:b]])
                yield table_of({"doc_id": batch.column(0).slice(a, b - a), "n_chars": [len(t) for t in texts[a:b]], "fingerprint": [f.text(i) for i in range(b - a)]}, out)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_neighbour_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edit with the next document's text, and their likeness.

    The next document has the next lower doc_id (after the least: the greatest); the edit
    replaces the last half of the text's code points by the first as many of it, or all.
    Ties are ordered by text; null doc_ids are lowest; null texts count as empty; a single
    row is its own next; an empty table gives an empty one.

    Rows are dealt once, to ``blocks`` ranges of doc_id (quantiles of the data); the rows
    of each range's greatest doc_id go to the range above as well, so each range streams
    through its sorted rows with the next text at hand and no window over all rows.
    """
    spark = docs.sparkSession
    blocks = blocks or shuffle_partitions(spark)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    cuts = cut_points(rows, "doc_id", blocks)
    rows = rows.withColumn("block", block_of(F.col("doc_id"), cuts))
    tops = sorted((r["block"], r["top"]) for r in rows.groupBy("block").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], _SCHEMA)
    above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    also = F.element_at(F.create_map(*[F.lit(x) for b, _ in tops for x in (b, above[b])]), F.col("block"))
    top = F.element_at(F.create_map(*[x for b, t in tops for x in (F.lit(b), F.lit(t).cast("long"))]), F.col("block"))
    copies = F.when(F.col("doc_id").eqNullSafe(top), F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("guest")), F.struct(also.alias("to"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("guest"))))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.to", "c.guest")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # rows that wait for the text after them
        size = 0

        def flush(after: str) -> pa.RecordBatch:
            texts = [t for _, t in held]
            nexts = [*texts[1:], after]
            edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, n in zip(texts, nexts, strict=True)]
            k = len(texts)
            own, other = Fingerprints([t.encode() for t in [*texts, after]]), Fingerprints(edited)
            mine, theirs = [own.text(i) for i in range(k + 1)], [other.text(i) for i in range(k)]
            return table_of(
                {
                    "doc_id": [i for i, _ in held],
                    "n_chars": [len(t) for t in texts],
                    "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                    "fingerprint": mine[:k],
                    "edited_fingerprint": theirs,
                    "near_edited": [likeness(a, b) for a, b in zip(mine, theirs, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(mine, mine[1:], strict=False)],
                },
                _OUT,
            )

        for batch in batches:
            for i, t, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                if held and (guest or size + len(t) > 1 << 19):
                    yield flush(t)
                    held, size = [], 0
                if not guest:
                    held.append((i, t))
                    size += len(t)

    return dealt.select("doc_id", "text", "guest").mapInArrow(run, _SCHEMA)
