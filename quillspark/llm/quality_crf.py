"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, mix64, passes, table_of, utf8, words_of

#: At most so many labelled documents are fitted on (chosen by hash of the key).
MAX_TRAIN_DOCS = 4000
#: At most so many lines of a training document: a longer one gives a run of so many lines.
MAX_TRAIN_LINES = 200

_CLASSES = 10
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[ord("!")] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[[9, 11, 12, 13, 32]] = 7
_CLASS[10] = 9

#: Of a line itself; a line also has those of the lines before and after it.
FEATURES = ["log_bytes", "lower", "upper", "digit", "symbol", "bang", "mark", "blank", "non_ascii", "control", "log_words", "word_bytes", "same_as_last_word", "repeated_windows", "repeated_line", "long_words"]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every ``\\n``-separated line, its document, and its bytes plus one.

    A text has a line at least, so empty texts have one empty line.
    """
    data, offsets = utf8(texts)
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    owner = np.concatenate((np.arange(len(texts)), np.searchsorted(offsets, breaks, side="right") - 1))
    owner = np.sort(owner, kind="stable")  # a line's text index grows with its start
    lines = len(starts)
    ends = np.concatenate((starts[1:], [n])) - np.concatenate((owner[1:] == owner[:-1], [False])).astype(np.int64)
    size = np.maximum(ends - starts, 0)
    line_of = np.repeat(np.arange(lines), np.concatenate((starts[1:], [n])) - starts)
    counts = np.bincount(line_of * _CLASSES + _CLASS[data], minlength=lines * _CLASSES).reshape(lines, _CLASSES)
    share = counts[:, :9] / np.maximum(size, 1)[:, None]
    a, b, doc, h = words_of(data, offsets)
    x = np.zeros((lines, len(FEATURES)), dtype=np.float64)
    x[:, 0] = np.log1p(size)
    x[:, 1:9] = share[:, [1, 2, 3, 4, 5, 6, 7, 8]]
    x[:, 9] = share[:, 0]
    if len(a):
        at = line_of[a]
        words = np.bincount(at, minlength=lines)
        some = np.maximum(words, 1)
        x[:, 10] = np.log1p(words)
        x[:, 11] = np.bincount(at, b - a, minlength=lines) / some / 8
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
        x[:, 12] = np.bincount(at, same, minlength=lines) / some
        with np.errstate(over="ignore"):
            seed = mix64(doc.astype(np.uint64) + np.uint64(1))
            three = mix64(h[:-2] * np.uint64(3) + mix64(h[1:-1] * np.uint64(5) + mix64(h[2:] + seed[2:]))) if len(a) > 2 else h[:0]
        order = np.argsort(three, kind="stable")
        again = np.zeros(len(three), dtype=bool)
        again[order[1:]] = three[order[1:]] == three[order[:-1]]
        x[:, 13] = np.bincount(at[: len(three)], again, minlength=lines) / some
        x[:, 15] = np.bincount(at, b - a > 12, minlength=lines) / some
        with np.errstate(over="ignore"):
            key = np.zeros(lines, dtype=np.uint64)
            np.add.at(key, at, h * (np.arange(len(a)) - np.searchsorted(at, at) + 1).astype(np.uint64))
            key = mix64(key + mix64(owner.astype(np.uint64) + np.uint64(7)))
        order = np.argsort(key, kind="stable")
        x[order[1:], 14] = (key[order[1:]] == key[order[:-1]]) & (words[order[1:]] > 0)
    return x, owner, size + 1.0


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A line's own features, then those of the line before and the line after (0 at the ends)."""
    joined = (owner[1:] == owner[:-1])[:, None]
    zero = np.zeros((1, x.shape[1]))
    before = np.concatenate((zero, x[:-1] * joined))
    after = np.concatenate((x[1:] * joined, zero))
    first = np.concatenate(([1.0], 1.0 - joined[:, 0]))[:, None]
    return np.concatenate((x, before, after, first), axis=1)


class Chain:
    """Two states, good 0 and bad 1: line scores for bad, transition scores, start score."""

    def __init__(self, width: int):
        self.w, self.bias, self.move, self.start = np.zeros(width), 0.0, np.zeros((2, 2)), 0.0
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def marginals(self, z: np.ndarray, owner: np.ndarray, pairs: bool = False):
        """Forward-backward over all documents at once, position by position.

        Returns P(bad) of each line, and with ``pairs`` the expected transition counts too.
        """
        s = np.clip((z - self.mean) / self.scale @ self.w + self.bias, -30, 30)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        length = np.diff(np.concatenate((starts, [len(owner)])))
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]  # documents with more than t lines
        e = np.stack((np.exp(-np.maximum(s, 0)), np.exp(np.minimum(s, 0))), axis=1)
        a = np.exp(self.move)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        for t, k in enumerate(active):
            i = starts[:k] + t
            now = e[i] * (alpha[i - 1] @ a if t else np.array([1.0, np.exp(self.start)]))
            alpha[i] = now / now.sum(axis=1, keepdims=True)
        for t in range(len(active) - 1, 0, -1):
            i = starts[: active[t]] + t
            back = (beta[i] * e[i]) @ a.T
            beta[i - 1] = back / back.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = p[:, 1] / p.sum(axis=1)
        if not pairs:
            return p
        inner = np.flatnonzero(np.concatenate(([False], owner[1:] == owner[:-1])))
        both = alpha[inner - 1][:, :, None] * a[None] * (e[inner] * beta[inner])[:, None, :]
        return p, (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0), starts

    def fit(self, z: np.ndarray, owner: np.ndarray, bad: np.ndarray, rounds: int = 120, ridge: float = 2.0) -> Chain:
        """Maximise the conditional likelihood of the line labels (a line has its document's)."""
        self.mean, self.scale = z.mean(axis=0), z.std(axis=0) + 1e-6
        x = (z - self.mean) / self.scale
        docs = owner[-1] + 1 if len(owner) else 1
        inner = np.flatnonzero(np.concatenate(([False], owner[1:] == owner[:-1])))
        seen = np.zeros((2, 2))
        np.add.at(seen, (bad[inner - 1].astype(int), bad[inner].astype(int)), 1)
        theta, m, v = np.zeros(len(self.w) + 6), 0.0, 0.0
        for step in range(1, rounds + 1):
            self.w, self.bias, self.start, self.move = theta[:-6], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
            p, moved, starts = self.marginals(z, owner, pairs=True)
            d = bad - p
            g = np.concatenate((x.T @ d, [d.sum()], [d[starts].sum()], (seen - moved).ravel())) - ridge * theta
            g /= docs
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.bias, self.start, self.move = theta[:-6], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text: one minus the length-weighted mean of its lines' P(bad)."""
        x, owner, size = line_features(texts)
        p = self.marginals(with_neighbours(x, owner), owner)
        return np.clip(1.0 - np.bincount(owner, p * size) / np.bincount(owner, size), 0.0, 1.0)


def held_out(key):
    """Rows that no label is learned from: crc32 of the key as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _start(lines: int, key: int, most: int) -> int:
    """First of the ``most`` consecutive lines of a longer text that are fitted on."""
    return int(mix64(np.array([key], dtype=np.int64).view(np.uint64))[0] % np.uint64(lines - most + 1)) if lines > most else 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> Chain:
    """Fit on at most ``max_docs`` labelled documents that are not held out.

    Only keys meet the labels; the chosen keys, at most ``max_docs``, go to the texts, and
    their line features come to the driver: one row a key, whatever rows repeat it, and at
    most ``max_lines`` lines of it. Features are taken from the whole text; of a longer text
    the lines from a place that a hash of the key chooses are fitted on. So the driver holds
    max_docs x max_lines lines at most (of 64 bytes, 51 MB; the fit takes about 15 times
    that). Without labelled rows every score is 0.5.
    """
    named = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = named.select("doc_id").where(~held_out(F.col("doc_id"))).distinct().join(known, "doc_id")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    model = Chain(3 * len(FEATURES) + 1)
    if not chosen:
        return model
    few = docs.sparkSession.createDataFrame(chosen, ids.schema)
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in passes(batch.column("text")):
                x, owner, _ = line_features(texts)
                each = np.split(x, np.searchsorted(owner, np.arange(1, b - a)))
                ids = batch.column("doc_id").slice(a, b - a)
                each = [y[at : at + max_lines] for y, at in zip(each, (_start(len(y), i, max_lines) for y, i in zip(each, ids.to_pylist(), strict=True)), strict=True)]
                yield table_of({"doc_id": ids, "quality": batch.column("quality").slice(a, b - a), "lines": [y.astype("<f4").tobytes() for y in each]}, out)

    got = in_batches(named.join(F.broadcast(few), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), features, "doc_id long, quality int, lines binary")
    got = got.groupBy("doc_id", "quality").agg(F.min("lines").alias("lines")).collect()
    got.sort(key=lambda r: r["doc_id"])
    each = [np.frombuffer(r["lines"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64) for r in got]
    owner = np.repeat(np.arange(len(each)), [len(y) for y in each])
    bad = np.repeat([1.0 - float(r["quality"]) for r in got], [len(y) for y in each])
    return model.fit(with_neighbours(np.concatenate(each), owner), owner, bad)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, keep_columns: bool = False) -> DataFrame:
    """Score every whole text.

    Returns doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= 0.5).
    With ``keep_columns`` the columns of ``docs`` come instead, for rows predicted 1 only.
    Null and empty texts are scored as one empty line; null keys are not held out and have
    no label; repeated rows each give a row; columns other than key and text are never
    looked at. A very long text is one pass by itself. No shuffle of texts.
    """
    model = fit(docs, labels, text, key, max_docs)

    def scored(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(model.score(texts) for _, _, texts in passes(batch.column("_text")))])

    if keep_columns:
        cols = docs.columns
        wide = docs.select(*[docs[c].alias("_text" if c == text else f"_{i}") for i, c in enumerate(cols)])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(scored(batch) >= 0.5))

        return in_batches(wide, keep, wide.schema).toDF(*cols)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table_of({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scored(batch)}, out)

    named = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key].cast("long")).alias("held_out"), docs[text].alias("_text"))
    return in_batches(named, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
