"""Content-addressed store of token ids: rolling-hash chunks, recipes, Merkle manifests.

A store is a folder of Parquet tables:

* ``encoded/kind=chunk``  key (the address: SHA-256 of the packed ids), width, data (these
  ids, Zstandard): every distinct chunk once
* ``recipes``  block, doc_id, start, n_tokens, row, root, chunks (length and address) in
  ascending doc_id order: block after block, sorted within; ``root`` is the Merkle root over
  its chunks' lengths and addresses
* ``manifest`` block, docs, n_tokens, root: Merkle root over doc_id, start, n_tokens and root
  of a block's recipes
* ``summary``  one row: root over the blocks' roots and totals, and the totals

A document is bound to its ids by that chain: chunk data to its address, addresses and
lengths to the recipe's root, the root with key and place to the block's, that to the store's.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import block_of, cut_points, new_path, remove, runs, seeds, shuffle_partitions, table_of

#: Ids hashed together, least and most ids of a chunk, and the mask that cuts one in 512.
WINDOW, LEAST, MOST, MASK = 16, 128, 4096, np.uint64(511 << 40)
#: Characters of text encoded at once, the Zstandard level of chunk data, and the addresses a task remembers.
PASS, LEVEL, SEEN = 1 << 20, 6, 500_000


# --------------------------------------------------------------------------- chunking
_GEAR = seeds(1 << 16, 11)


def chunk_ends(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream in a concatenation.

    A hash of the last WINDOW ids, kept rolling by doubling shifts, cuts where its masked
    bits are 0; chunks have LEAST to MOST ids. As LEAST exceeds WINDOW, no cut depends on
    ids of another stream, and equal stretches are cut alike after their first cut.
    """
    with np.errstate(over="ignore"):
        h = _GEAR[ids & 0xFFFF] if ids.dtype.itemsize == 2 else _GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint64)
        step = 1
        while step < WINDOW:
            more = h.copy()
            more[step:] += h[:-step] << np.uint64(step)
            h, step = more, 2 * step
    marks = np.flatnonzero((h & MASK) == 0) + 1
    begin = np.searchsorted(marks, offsets)
    out = []
    for d in range(len(offsets) - 1):
        at, end, ends = int(offsets[d]), int(offsets[d + 1]), []
        for m in marks[begin[d] : begin[d + 1]].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < end:
                ends.append(m)
                at = m
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(ends)
    return out


# --------------------------------------------------------------------------- Merkle trees
def merkle(leaves: Iterable[bytes]) -> bytes:
    """Root of a binary hash tree, from a stack of log n nodes; no leaves give 32 zero bytes."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while stack and stack[-1][0] == level:
            node = hashlib.sha256(b"\1" + stack.pop()[1] + node).digest()
            level += 1
        stack.append((level, node))
    root = stack.pop()[1] if stack else bytes(32)
    while stack:
        root = hashlib.sha256(b"\1" + stack.pop()[1] + root).digest()
    return root


def chunk_leaf(n: int, address: bytes) -> bytes:
    return n.to_bytes(8, "little") + address


def recipe_leaf(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    key = b"null" if doc_id is None else doc_id.to_bytes(8, "little", signed=True)
    return start.to_bytes(8, "little") + n_tokens.to_bytes(8, "little") + root + key


def block_leaf(docs: int, n_tokens: int, root: bytes) -> bytes:
    return docs.to_bytes(8, "little") + n_tokens.to_bytes(8, "little") + root


# --------------------------------------------------------------------------- checksums
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of CRC-32 polynomials (bit 31 is the constant term), elementwise."""
    a, b = a.astype(np.uint64), np.broadcast_to(b, a.shape).astype(np.uint64)
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = b >> np.uint64(1) ^ np.where(b & np.uint64(1), np.uint64(_POLY), np.uint64(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Share of a part's CRC-32 in the whole's, if ``after`` zero-to-be bytes follow the part.

    The CRC-32 of a concatenation is the exclusive or of its parts' shares.
    """
    power = np.array([1 << 23], dtype=np.uint64)  # x ** 8: one byte
    out, n = crc.astype(np.uint64), after.copy()
    while n.any():
        odd = (n & 1).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], power)
        power, n = _times(power, power), n >> 1
    return out


# --------------------------------------------------------------------------- write
_ENCODED = "kind string, key binary, width int, data binary, row long, doc_id long, n_tokens long, root binary, chunks array<struct<n: int, address: binary>>"


def _encoded(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_ENCODED).parquet(f"{path}/encoded").where(F.col("kind") == kind)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Address, width and data of every chunk of a store."""
    return _encoded(spark, path, "chunk").select(F.col("key").alias("address"), "width", "data")


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, text: str = "text", key: str = "doc_id", blocks: int | None = None) -> str:
    """Encode every whole text, append ``end_id``, and write a store; returns its path.

    Null and empty texts are a lone end id; equal doc_ids are ordered by their row number in
    the encoding; null doc_ids come first; an empty table gives a store without chunks.
    Chunk data is shuffled once, to find equal chunks, after each task has left out those it
    met before; recipes carry addresses only. If an executor is lost, what it had encoded is
    encoded again.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "store")
    out = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("width", pa.int32()), ("data", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(pa.struct([("n", pa.int32()), ("address", pa.binary())])))])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return table_of({f.name: columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in out}, out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table, width = bpe.library_ids(tokenizer), 2 if bpe.vocabulary(tokenizer).size <= 1 << 16 else 4
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        row, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs([len(t or "") for t in texts], PASS):
                ids, cuts = table.values(texts[a:b])
                ids = np.insert(ids, cuts[1:], end_id).astype(f"<u{width}")
                offsets = cuts + np.arange(len(cuts))
                whole, ends = ids.tobytes(), chunk_ends(ids, offsets)
                of = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
                cut = np.concatenate(([0], np.fromiter(chain.from_iterable(ends), dtype=np.int64, count=int(of[-1]))))
                n, at = np.diff(cut), (cut * width).tolist()
                data = [whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                names = [hashlib.sha256(x).digest() for x in data]
                leaves, upto = list(map(chunk_leaf, n.tolist(), names)), of.tolist()
                numbers = np.arange(row, row + b - a)
                yield rows(
                    b - a, kind=["draft"] * (b - a), key=[x.tobytes() for x in numbers], row=numbers, doc_id=batch.column(0).slice(a, b - a), n_tokens=np.diff(offsets),
                    root=[merkle(leaves[x:y]) for x, y in zip(upto[:-1], upto[1:], strict=True)],
                    chunks=pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(names, pa.binary())], ["n", "address"])),
                )
                new = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
                yield rows(len(new), kind=["chunk"] * len(new), key=[names[i] for i in new], width=np.full(len(new), width), data=[squeeze(data[i]) for i in new])
                row += b - a
                if len(seen) > SEEN:
                    seen.clear()

    named = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    # chunks meet by address, recipes stay one by one: one shuffle, one write, and no other copy of the data
    named.mapInArrow(encode, _ENCODED).dropDuplicates(["key"]).write.partitionBy("kind").parquet(f"{path}/encoded")
    drafts = _encoded(spark, path, "draft").select("row", "doc_id", "n_tokens", "root", "chunks")
    cuts = cut_points(drafts, "doc_id", blocks or shuffle_partitions(spark))
    drafts = drafts.withColumn("block", block_of(F.col("doc_id"), cuts))
    sums = drafts.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    shift = sums.select(F.col("block").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "row")
    placed = drafts.join(F.broadcast(shift), F.col("block") == F.col("of")).withColumn("start", F.col("shift") + F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.select("block", "doc_id", "start", "n_tokens", "row", "root", "chunks")
    placed.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").write.parquet(f"{path}/recipes")
    remove(spark, f"{path}/encoded/kind=draft")
    manifest = block_roots(spark.read.parquet(f"{path}/recipes"), len(cuts) + 1)
    manifest.write.parquet(f"{path}/manifest")
    tops = spark.read.parquet(f"{path}/manifest").orderBy("block").collect()  # a row for each block
    spark.createDataFrame([(store_root(tops), len(tops), sum(r["docs"] for r in tops), sum(r["n_tokens"] for r in tops), end_id)], "root binary, blocks long, docs long, n_tokens long, end_id long").coalesce(1).write.parquet(f"{path}/summary")
    return path


def block_roots(recipes: DataFrame, blocks: int) -> DataFrame:
    """Merkle root of each block's recipes, in doc_id order, streamed."""
    out = pa.schema([("block", pa.int32()), ("docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {"block": None, "docs": 0, "n": 0}

        def leaves() -> Iterator[bytes]:
            for batch in batches:
                for b, key, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "start", "n_tokens", "root")), strict=True):
                    seen.update(block=b, docs=seen["docs"] + 1, n=seen["n"] + n)
                    yield recipe_leaf(key, start, n, root)

        root = merkle(leaves())
        if seen["docs"]:
            yield table_of({"block": [seen["block"]], "docs": [seen["docs"]], "n_tokens": [seen["n"]], "root": [root]}, out)

    return recipes.select("block", "doc_id", "row", "start", "n_tokens", "root").repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").mapInArrow(run, "block int, docs long, n_tokens long, root binary")


def store_root(manifest: list) -> bytes:
    """Merkle root over a store's blocks, in order: a row for each block."""
    return merkle(block_leaf(r["docs"], r["n_tokens"], bytes(r["root"])) for r in manifest)


# --------------------------------------------------------------------------- read
def chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """Address, ids and CRC-32 (of ids as 32-bit) of every stored chunk, and whether its data has that address."""
    out = pa.schema([("address", pa.binary()), ("ids", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            address, width, data = (batch.column(c).to_pylist() for c in ("address", "width", "data"))
            data = [plain(x) for x in data]
            wide = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(data, width, strict=True)]
            yield table_of({"address": batch.column("address"), "ids": [len(x) // 4 for x in wide], "crc": [zlib.crc32(x) for x in wide], "sound": [hashlib.sha256(x).digest() == a for x, a in zip(data, address, strict=True)]}, out)

    return stored_chunks(spark, path).mapInArrow(run, "address binary, ids long, crc long, sound boolean")


def chunk_uses(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe, in place: what it is, how many ids follow it, and
    whether the recipe's root is that of its chunks and their lengths sum to n_tokens.

    A recipe without chunks gives one row with a null address, so that it is not overlooked.
    """
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("i", pa.int32()), ("n", pa.int64()), ("after", pa.int64()), ("address", pa.binary()), ("rooted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunks")
            each = pa.compute.list_value_length(chunks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = chunks.flatten()
            n, address = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("address").to_pylist()
            ends = np.concatenate(([0], np.cumsum(n)))
            last = np.cumsum(each)
            total = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            leaves = list(map(chunk_leaf, n.tolist(), address))
            fits = [merkle(leaves[y - k : y]) == r for y, k, r in zip(last.tolist(), each.tolist(), batch.column("root").to_pylist(), strict=True)]
            fits = np.array(fits, dtype=bool) & (ends[last] - ends[last - each] == total) & (each > 0)
            doc = np.repeat(np.arange(len(each)), each)
            of = {c: batch.column(c).take(pa.array(doc)) for c in ("doc_id", "start", "row", "n_tokens")}
            yield table_of(of | {"i": np.arange(len(doc)) - (last - each)[doc], "n": n, "after": ends[last][doc] - ends[1:], "address": address, "rooted": fits[doc]}, out)
            if len(bare := np.flatnonzero(each == 0)):
                nothing = {"i": np.zeros(len(bare)), "n": np.zeros(len(bare)), "after": np.zeros(len(bare)), "address": [None] * len(bare), "rooted": np.zeros(len(bare), dtype=bool)}
                yield table_of({c: batch.column(c).take(pa.array(bare)) for c in of} | nothing, out)

    return recipes.select("doc_id", "start", "row", "n_tokens", "root", "chunks").mapInArrow(run, "doc_id long, start long, row long, n_tokens long, i int, n long, after long, address binary, rooted boolean")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from a store's files: doc_id, start, n_tokens, ids_crc32, verified.

    Each stored chunk is read once and gives a checksum and a length; recipes meet these
    small facts by address, and a document's checksum is the exclusive or of its chunks'
    shifted ones, so no ids are gathered. ``verified``: every chunk is there, has its address
    and its stated length, the recipe's root is computed again from its chunks, and their
    lengths make n_tokens. Whether recipes are where the manifests say is for ``verify``.
    """
    used = chunk_uses(spark.read.parquet(f"{path}/recipes")).drop("i")
    met = used.join(chunk_facts(spark, path).withColumnRenamed("address", "_a"), F.col("address") == F.col("_a"), "left").drop("_a", "address")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.int64()), ("part", pa.int64()), ("sound", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
            sound = pa.compute.and_(batch.column("sound").fill_null(False), pa.compute.equal(batch.column("ids").fill_null(-1), batch.column("n")))
            yield table_of({c: batch.column(c) for c in ("doc_id", "start", "row", "n_tokens", "ids")} | {"part": shifted_crc(crc, after * 4).astype(np.int64), "sound": pa.compute.and_(sound, batch.column("rooted"))}, out)

    parts = met.mapInArrow(run, "doc_id long, start long, row long, n_tokens long, ids long, part long, sound boolean")
    whole = parts.groupBy("row", "start", "doc_id", "n_tokens").agg(F.sum("ids").alias("ids"), F.bit_xor("part").alias("ids_crc32"), F.min("sound").alias("sound"))
    return whole.select("doc_id", "start", F.coalesce("ids", F.lit(0).cast("long")).alias("n_tokens"), "ids_crc32", (F.col("sound") & F.coalesce(F.col("ids") == F.col("n_tokens"), F.lit(False))).alias("verified"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids (array of int, with the end id), rebuilt from its recipe; a missing chunk is an error."""
    used = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "row", F.posexplode("chunks").alias("i", "c"))
    met = used.join(stored_chunks(spark, path), F.col("c.address") == F.col("address"), "left").select("doc_id", "start", "row", "i", "width", F.coalesce("data", F.raise_error(F.lit("a chunk of the store is missing")).cast("binary")).alias("data"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(plain(p["data"]), f"<u{p['width']}") for p in x]).astype(np.int32) for x in batch.column("parts").to_pylist()]
            yield table_of({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": ids}, out)

    grouped = met.groupBy("doc_id", "start", "row").agg(F.sort_array(F.collect_list(F.struct("i", "width", "data"))).alias("parts"))
    return grouped.mapInArrow(run, "doc_id long, start long, ids array<int>")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the summary, the manifests, the recipes and the chunks of a store agree.

    Block roots are computed again from the recipes, their starts from the lengths before
    them, recipe roots from chunks, and addresses from data; the store's root, from the
    blocks', must be the summary's. Blocks are as many as shuffle partitions were at writing.
    """
    summary = spark.read.parquet(f"{path}/summary").first()
    recipes = spark.read.parquet(f"{path}/recipes")
    told = spark.read.parquet(f"{path}/manifest").orderBy("block").collect()
    again = block_roots(recipes, 1 + max([r["block"] for r in told], default=0)).orderBy("block").collect()
    at = np.concatenate(([0], np.cumsum([r["n_tokens"] for r in told]))).tolist()
    firsts = {r["block"]: r for r in recipes.groupBy("block").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("n_tokens")).alias("high"), F.sum("n_tokens").alias("n")).collect()}
    same = again == told and store_root(told) == bytes(summary["root"]) and [summary["blocks"], summary["docs"], summary["n_tokens"]] == [len(told), sum(r["docs"] for r in told), at[-1]]
    same = same and all((f := firsts.get(r["block"])) and (f["low"], f["high"], f["n"]) == (at[i], at[i + 1], r["n_tokens"]) for i, r in enumerate(told))
    return same and not chunk_facts(spark, path).where(~F.col("sound")).head(1) and not read_digests(spark, path).where(~F.col("verified")).head(1)
