"""Training-data operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, bpe_codec, fingerprints, licence_texts, licences, mixing, near_dedup, quality_crf, queries, rules, sharding, token_counts, token_store, word_table

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
GAP = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (3, " \n\t ", None, None), (4, "one two", "en", "b"), (4, "one two", "en", "b"),
    (None, "no key here but words", "de", "b"), (5, "x" * 70000, "en", None), (6, "word " * 20000, "fr", "a"), (7, "é<|endoftext|>ü 🎉 <|startoftext|>", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("key", "n", "total", "size", "block", "bucket", "comp", "t", "row", "score"):  # names that operators use themselves
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# ------------------------------------------------------------------ 7, 8: tokens
POOLS = ["abc the of ing's 12 \n\t .,!_-'", "éàüßñœ²½٣Ⅷ\x1c\x85\xa0 Σςİǅﬁ中文가á", "🎉👍🏽𐐀", "xyz", "'s't're've'm'll'd''", "'  \t\n \r\n"]


def random_text(rng, most=30):
    return "".join(rng.choice(rng.choice(POOLS)) if rng.random() < 0.95 else rng.choice(["<|endoftext|>", "<|", "'re", " 's", "'ll"]) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("most", [word_table.TABLE_BYTES, 1500])
def test_merge_loops_agree_with_the_library(most, monkeypatch):
    monkeypatch.setattr(word_table, "PASS_CHARS", 60)  # many passes, and texts cut into pieces
    byte, word, rng = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), random.Random(3)
    tables = [f.__wrapped__(BYTE) for f in (bpe.rank_array_ids, bpe.library_ids)]
    counts = bpe.heap_counts.__wrapped__(WORD)
    for t in (*tables, counts):
        t.table.most = most
    for _ in range(200):
        texts = [random_text(rng, 30 if rng.random() < 0.9 else 700) for _ in range(8)] + ["", None, " plain words" * rng.randint(0, 40)]
        for t in tables:
            ids, cuts = t.values(texts)
            for x, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
                assert ids[a:b].tolist() == byte.encode(x or "", add_special_tokens=False).ids, x
        each, cuts = counts.values(texts)
        assert [int(each[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [len(word.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_both_loops_agree_on_words():
    v, rng = bpe.vocabulary(BYTE), random.Random(4)
    for _ in range(1500):
        w = "".join(rng.choices("abcdeinrst", k=rng.randint(1, 60))).encode()
        assert bpe.by_rank_array(v, w) == bpe.by_heap(v, w) and bpe.count_by_heap(v, w) == len(bpe.by_heap(v, w))


@pytest.mark.parametrize("most", [1 << 20, 2000])
def test_word_table_stands_hash_collisions(most, monkeypatch):
    plain = word_table.WordTable.hashes
    monkeypatch.setattr(word_table.WordTable, "hashes", staticmethod(lambda p, a, b: plain(p, a, b) & np.uint64(7 << 61)))
    table = word_table.TextTable(lambda w: [len(w), *map(ord, w)], True, {}, lambda t: [t], most=most)
    rng = random.Random(6)
    for _ in range(30):
        texts = [" ".join(rng.choices(["a", "bb", "ab", "ba", "ccc", "cac", "x1"], k=20)) for _ in range(5)]
        got, cuts = table.values(texts)
        for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
            words = re.findall(r" ?[a-z]+| ?[0-9]+", t)
            assert got[a:b].tolist() == [v for w in words for v in (len(w), *map(ord, w))]


def test_special_strings_are_the_vocabulary_s_own():
    table = word_table.TextTable(lambda w: [0], True, {"[[x]]": [7], "#end": [9]}, re.compile(r"(\[\[x\]\]|#end)").split)
    values, cuts = table.values(["a[[x]]b", "#end#end", "no"])
    assert values.tolist() == [0, 7, 0, 9, 9, 0] and cuts.tolist() == [0, 3, 5, 6]


def test_token_counts(docs, odd, none):
    t = Tokenizer.from_file(WORD)
    for df in (docs, odd):
        want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in pairs(df))
        assert Counter(map(tuple, token_counts.token_counts(df, WORD).collect())) == want
    assert token_counts.token_counts(none, WORD).count() == 0


def test_codec(docs, odd, none):
    t = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        want = Counter()
        for i, x in pairs(df):
            ids = t.encode(x, add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe_codec.encode(df, BYTE, digests_only=True).collect())) == want
    full = bpe_codec.encode(odd, BYTE)
    back = bpe_codec.decode(full, BYTE)
    assert Counter(map(tuple, back.collect())) == Counter(pairs(odd))
    assert bpe_codec.encode(none, BYTE).count() == 0


# ------------------------------------------------------------------ 5: store
def test_token_store(spark, docs, odd, none):
    t = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        path = token_store.write_store(df, BYTE)
        got = token_store.read_digests(spark, path).orderBy("start").collect()
        want = Counter()
        for i, x in pairs(df):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
            want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and all(r.verified for r in got)
        assert [r.doc_id for r in got] == sorted((i for i, _ in pairs(df)), key=lambda i: (i is not None, i or 0))
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        rebuilt = {r.start: r.ids for r in token_store.read_ids(spark, path).collect()}
        assert all(zlib.crc32(np.array(rebuilt[r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
        assert token_store.verify(spark, path)
        stored = token_store.stored_chunks(spark, path)
        assert stored.count() == stored.select("address").distinct().count()
    path = token_store.write_store(none, BYTE)
    assert token_store.read_digests(spark, path).count() == 0


def rewritten(spark, path, name, change):
    df = spark.read.parquet(f"{path}/{name}")
    rows = change(df.collect())
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{path}/{name}")


def with_fields(row, **new):
    return tuple(new.get(k, v) for k, v in row.asDict().items())


def swapped(*fields):
    """The first two recipes with these fields exchanged."""

    def change(rows):
        a, b, *others = rows
        return [with_fields(a, **{f: b[f] for f in fields}), with_fields(b, **{f: a[f] for f in fields}), *others]

    return change


DAMAGE = {
    "addresses changed": ("encoded/kind=chunk", lambda rows: [with_fields(r, key=hashlib.sha256(bytes(r.key)).digest()) for r in rows]),
    "chunk missing": ("encoded/kind=chunk", lambda rows: rows[1:]),
    "chunk data changed": ("encoded/kind=chunk", lambda rows: [with_fields(rows[0], data=rows[1].data), *rows[1:]]),
    "chunks of two documents swapped": ("recipes", swapped("chunks")),
    "whole recipes swapped": ("recipes", swapped("chunks", "root", "n_tokens")),
    "keys swapped": ("recipes", swapped("doc_id")),
    "recipe missing": ("recipes", lambda rows: rows[1:]),
    "recipe twice": ("recipes", lambda rows: [rows[0], *rows]),
    "chunks of a recipe reversed": ("recipes", lambda rows: [with_fields(r, chunks=r.chunks[::-1]) for r in rows]),
    "recipe cut short": ("recipes", lambda rows: [with_fields(r, chunks=r.chunks[:-1]) for r in rows]),
    "starts moved": ("recipes", lambda rows: [with_fields(r, start=r.start + 1) for r in rows]),
    "block root changed": ("manifest", lambda rows: [with_fields(r, root=hashlib.sha256(bytes(r.root)).digest()) for r in rows]),
    "block total changed": ("manifest", lambda rows: [with_fields(r, n_tokens=r.n_tokens + 1) for r in rows]),
    "summary changed": ("summary", lambda rows: [with_fields(r, docs=r.docs + 1) for r in rows]),
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "in"]) + str(rng.randrange(99)) for _ in range(900))) for i in range(6)], "doc_id long, text string")


@pytest.mark.parametrize("what", DAMAGE)
def test_store_notices_damage(spark, long_docs, what):
    path = token_store.write_store(long_docs, BYTE, blocks=2)
    name, change = DAMAGE[what]
    rewritten(spark, path, name, lambda rows: change(sorted(rows, key=lambda r: r.doc_id) if name == "recipes" else rows))
    assert not token_store.verify(spark, path)
    if what.startswith(("chunks of", "recipe cut", "addresses", "chunk ")):
        assert not all(r.verified for r in token_store.read_digests(spark, path).collect())


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50000, 20000).astype("<u2")
    y = np.concatenate((x[:7000], x[7001:]))  # one id less

    def cut(a):
        ends = token_store.chunk_ends(a, np.array([0, len(a)]))[0]
        return {a[p:q].tobytes() for p, q in zip([0, *ends[:-1]], ends, strict=True)}

    a, b = cut(x), cut(y)
    assert len(a & b) > 0.8 * len(a)


# ------------------------------------------------------------------ 1: near-duplicates
def brute_classes(rows):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = GAP.findall(t)
        sets[n] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    by = defaultdict(list)
    for n, s in sets.items():
        for x in s:
            by[x].append(n)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for g in by.values() if len(g) < 400 for a in g for b in g if a < b}:
        x, y = sets[a], sets[b]
        if sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys()) >= 0.8:
            up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(n) for n in range(len(rows))]


def test_near_dedup_against_all_pairs(spark, docs, none):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [(100000 + i, " ".join(f"e{i}{k}" if rng.random() < 0.004 * (i % 12) else w for k, w in enumerate(base))) for i in range(80)]
    rows = pairs(docs) + texts
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(least[c], i)
    assert got == {i: least[c] for (i, _), c in zip(rows, want, strict=True)}
    assert len(set(want)) < len(rows)
    assert near_dedup.classes(none).count() == 0 == near_dedup.deduplicated(none).count()


@pytest.mark.parametrize("first, then", [("de df", "eb"), ("ab ac de df", "fb")])
def test_near_dedup_keeps_links_of_both_rounds(spark, monkeypatch, first, then):
    base = [f"w{k}" for k in range(400)]
    by_key = sorted(hashlib.md5(t.encode()).digest() + t.encode() for t in (" ".join([*base, f"e{i}"]) for i in range(6)))
    key = dict(zip("abcdef", (x[:16] for x in by_key), strict=True))
    links = lambda names: lambda *_: spark.createDataFrame([(key[a], key[b]) for a, b in names.split()], "a binary, b binary")
    monkeypatch.setattr(near_dedup, "_verified", links(first))
    monkeypatch.setattr(near_dedup, "_rest", links(then))
    rows = [(i, x[16:].decode()) for i, x in enumerate(by_key)]
    up = list(range(6))
    for a, b in f"{first} {then}".split():
        x, y = sorted((up["abcdef".index(a)], up["abcdef".index(b)]))
        up = [x if u == y else u for u in up]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got} == {i: (u, up.count(u), u == i) for i, u in enumerate(up)}


@pytest.mark.parametrize("hub, parts", [(near_dedup.HUB, near_dedup.PARTS), (3, 4), (1 << 30, 1)])
def test_components_split_hubs(spark, monkeypatch, hub, parts):
    monkeypatch.setattr(near_dedup, "HUB", hub)
    monkeypatch.setattr(near_dedup, "PARTS", parts)
    rng = random.Random(3)
    edges = [(0, i) for i in range(10, 700)] + [(900, i) for i in range(701, 1100)] + [(i, i + 1) for i in range(1200, 1220)] + [(699, 1210), (5, 5)]
    names = {i: hashlib.md5(str(i).encode()).digest() for i in range(1300)}
    rng.shuffle(edges)
    up = list(range(1300))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)), key=names.get)
        up[y] = x
    nodes = spark.createDataFrame([(names[i], names[i]) for i in range(1300)], "key binary, comp binary")
    got = near_dedup.components(nodes, spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a binary, b binary")).collect()
    assert {bytes(r.key): bytes(r.comp) for r in got} == {names[i]: names[top(i)] for i in range(1300)}
    assert near_dedup.components(nodes, spark.createDataFrame([], "a binary, b binary")).where("key = comp").count() == 1300


def test_blocks_by_bytes_lose_no_link(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text")
    want = Counter(near_dedup.classes(rows).drop("key").collect())
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    assert Counter(near_dedup.classes(rows).drop("key").collect()) == want


def test_near_dedup_odd_rows(odd):
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(r.class_size for r in got) == [1, 1, 1, 1, 1, 1, 1, 1, 2, 2]
    left = near_dedup.deduplicated(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "3", "4", "None", "5", "6", "7"])


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(1, 1 << 62, 300, dtype=np.uint64))
    wa, wb = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
    a, b = (names[:200], wa), (names[100:], wb)
    sig = near_dedup.signatures(np.repeat([0, 1], 200), np.concatenate((a[0], b[0])), np.concatenate((wa, wb)).astype(float), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - near_dedup.probability_jaccard(a, b)) < 0.03


# ------------------------------------------------------------------ 2: licences
def wrapped(text, width, start="", end="\n"):
    """The paragraphs of a text broken to lines of a width."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return end.join(start + line for p in paragraphs for line in [*textwrap.wrap(p, width), ""])


def licence_files():
    """(expected licence, text) of files as projects ship them."""
    t = {k: v[0] for k, v in licence_texts.TEXTS.items()}
    out = [("MIT", f"MIT License\n\nCopyright (c) 2021-2024 A. Person <a@b.example>\n\n{wrapped(t['MIT'], w)}") for w in (60, 72, 80, 500)]
    out += [("MIT", f"The MIT License (MIT)\r\n\r\nCopyright \xa9 2019, Some Body\r\nCopyright (C) Other\r\n\r\n" + wrapped(t["MIT"], 76, end="\r\n"))]
    out += [("MIT", "// Copyright 2020 The Authors. All rights reserved.\n//\n" + wrapped(t["MIT"], 70, "// ")), ("MIT", t["MIT"].upper()), ("MIT", t["MIT"].replace("sublicense", "sublicence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"))]
    for k in ("ISC", "0BSD", "MIT-0", "Unlicense", "BSL-1.0", "Zlib", "BSD-2-Clause", "BSD-3-Clause"):
        out += [(k, f"{licence_texts.TITLES[k][0]}\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n{wrapped(t[k], w)}") for w in (50, 66, 79)]
    out += [("BSD-3-Clause", wrapped(licence_texts.TEXTS["BSD-3-Clause"][-28], 72, " * "))]
    return out


def test_licence_files_of_every_shape(spark):
    files = licence_files()
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(rows).collect()}
    assert got == {i: k for i, (k, _) in enumerate(files)}


def test_long_licences_by_digest(spark):
    shipped = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for name, licence in names.items():
        try:
            with open(f"{shipped}/{name}", encoding="utf-8") as f:
                t = f.read()
        except FileNotFoundError:
            pytest.skip("no licence files on this machine")
        # the same words in other lines, up to copyright lines, which must stay lines
        other = "\n".join(x if "opyright" in x else " ".join(x.split()) + "  " for x in t.split("\n"))
        rows += [(licence, t), (licence, other.replace("\n", "\r\n")), (None, t + " one more word")]
    got = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {i: k for i, (k, _) in enumerate(rows)}


def test_canonical_form(spark):
    pairs_ = [
        ("Licence licence LICENCE", "license license license"), ("a\ncopyright notice and this\nb", "a copyright notice and this b"), ("a\n  (c) You must retain\nb", "a c you must retain b"),
        ("a\nCopyright (c) 2020 X\nCopyright 2021 Y\n(c) 2020 Z\nb", "a b"), ("a\n# Copyright [yyyy] [name]\nb", "a b"), ("non-infringement non\ninfringement", "noninfringement noninfringement"), (None, ""), (" .,\n\t", ""),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs_)], "i int, t string").select("i", licences.canonical(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: c for i, (_, c) in enumerate(pairs_)}


def test_licence_scan_equals_its_sql_on_planted_texts(spark, docs, odd):
    import duckdb

    planted = [(10_000_000 + i, t) for i, (_, t) in enumerate(licence_files())]
    notes = [(20_000_000, "some words\nReleased under the MIT Licence!\n# SPDX-License-Identifier: GPL-3.0-or-later\nLicensed under CC BY 4.0."), (20_000_001, "words released under the MIT License."), (20_000_001, "Licence licence")]
    rows = [*pairs(docs), *[(r.doc_id, r.text) for r in odd.collect()], *planted, *notes]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, licences.scan(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert got == Counter(con.execute(licences.oracle_sql()).fetchall())
    assert sum(n for r, n in got.items() if r[2]) == len(planted) and {r[0]: r[3] for r in got if r[0] and r[0] >= 20_000_000} == {20_000_000: "CC-BY-4.0,GPL-3.0,MIT", 20_000_001: None}


def test_licences_odd_rows(odd, none):
    got = licences.scan(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD) and all(r.licence is None and r.notices is None for r in got)
    assert {r.doc_id for r in got if r.digest == empty} == {1, 2, 3} and licences.scan(none).count() == 0


def test_any_number_of_notices_and_no_word_they_need(spark):
    given = [("CC0-1.0", "notice", "Dedicated to the public domain."), ("B", "notice", "twice known"), ("A", "notice", "twice known"), *((f"L{i}", "notice", f"notice number {i}") for i in range(12_000))]
    given = spark.createDataFrame(given, "licence string, kind string, text string").select("licence", "kind", licences.digest(F.col("text")).alias("digest"))
    rows = spark.createDataFrame([(1, "some words\nDedicated to the Public Domain\nNotice number 11999\nnotice, number 7"), (2, "other words"), (3, "twice KNOWN\ntwice known")], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licences.scan(rows, given).collect()} == {1: "CC0-1.0,L11999,L7", 2: None, 3: "A"}
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to broadcast
    try:
        assert {r.doc_id: r.notices for r in licences.scan(rows, given).collect()} == {1: "CC0-1.0,L11999,L7", 2: None, 3: "A"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)


# ------------------------------------------------------------------ 3: fingerprints
@pytest.mark.parametrize("blocks", [1, 7])
def test_neighbour_edits(docs, odd, none, blocks):
    for df in (docs, odd):
        got = fingerprints.with_neighbour_edits(df, blocks=blocks).collect()
        rows = sorted(pairs(df), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = Counter()
        for k, (i, t) in enumerate(rows):
            n = rows[(k + 1) % len(rows)][1]
            want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        alone = {r.fingerprint for r in fingerprints.fingerprints(df).collect()}
        assert alone == {r.fingerprint for r in got}
    assert fingerprints.with_neighbour_edits(none).count() == 0


def test_equal_substrings_share_names():
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    a, b = words(400), words(400)
    f = fingerprints.Fingerprints([x.encode() for x in (a, words(7) + a, a[: len(a) // 2] + b[: len(b) // 2], b, a)])
    t = [f.text(i) for i in range(5)]
    assert t[0] == t[4] and fingerprints.likeness(t[0], t[1]) > 0.85
    assert 0.2 < fingerprints.likeness(t[0], t[2]) < 0.55 and fingerprints.likeness(t[0], t[3]) < 0.05


# ------------------------------------------------------------------ 4: mixing
def brute_targets(sizes, weights, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if part[s] > cap * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix(df, [3.0, 1.0, 2.0]).collect()
        size = [(r["source"], len(GAP.findall(r["text"] or ""))) for r in df.collect()]
        total = Counter()
        for s, n in size:
            total[s] += n
        want = brute_targets(total, [3.0, 1.0, 2.0])
        assert Counter((r.source, r["size"]) for r in got) == Counter(size)
        taken = Counter()
        for r in got:
            assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
            assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
            taken[r.source] += r.taken
        most = Counter()
        for s, n in size:
            most[s] = max(most[s], n)
        assert all(abs(taken[s] - want[s]) <= most[s] + 1 for s in total)
        assert Counter(mixing.mix(df, [3.0, 1.0, 2.0]).collect()) == Counter(got)
        assert mixing.mixed_rows(df, [3.0, 1.0, 2.0]).count() == sum(r.copies for r in got)
    assert mixing.mix(none, [1.0]).count() == 0 == mixing.mixed_rows(none, [1.0]).count()


def test_mixing_splits_a_hot_source_and_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), (F.when(F.col("id") < 2000, 3).otherwise(F.col("id") % 9 + 1)).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    got = mixing.mix(rows, [1.0, 1.0]).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("x"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 6000 and all(abs(r.x - r.t) <= 10 for r in got)


# ------------------------------------------------------------------ 6: shards
def brute_shards(key, shards):
    name = "null" if key is None else str(key)
    unit = [(int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(shards + 1)]
    best = lambda n: max(range(n), key=lambda i: (-1 / math.log(unit[i]), -i))
    return best(shards), best(shards + 1)


def test_sharding(docs, odd, none):
    for df in (docs, odd):
        got = sharding.shard(df, 24).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in pairs(df))
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 for r in got)
        assert all((r.shard, r.grown_shard) == brute_shards(r.doc_id, 24) for r in got)
    assert sharding.shard(none).count() == 0


def test_sharding_follows_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r.shard: r["count"] for r in sharding.shard(df, [1.0, 3.0, 0.0, 2.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[3] / 20000 - 1 / 3) < 0.02


# ------------------------------------------------------------------ 9: classifier
def test_classifier_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality_crf.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_fit_is_a_maximum_of_the_likelihood():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 6, 60)
    owner = np.repeat(np.arange(60), lengths)
    bad = rng.random(len(owner)) < 0.4
    z = rng.normal(size=(len(owner), 3)) + bad[:, None]
    model = quality_crf.Chain(3).fit(z, owner, bad.astype(float), rounds=600)
    x, cut = (z - model.mean) / model.scale, np.concatenate(([0], np.cumsum(lengths)))

    def value(w, bias, start, move):  # log-likelihood by all paths, less the ridge
        total = -(w @ w + bias * bias + start * start + (move * move).sum())
        for a, b in itertools.pairwise(cut):
            path = lambda y: sum((x[a + t] @ w + bias) * s + (move[y[t - 1], s] if t else start * s) for t, s in enumerate(y))  # noqa: B023, E731
            total += path(bad[a:b].astype(int)) - np.log(sum(np.exp(path(y)) for y in itertools.product((0, 1), repeat=b - a)))
        return total

    theta = np.concatenate((model.w, [model.bias, model.start], model.move.ravel()))
    of = lambda t: value(t[:3], t[3], t[4], t[5:].reshape(2, 2))
    best = of(theta)
    for k in range(len(theta)):
        for step in (-0.05, 0.05):
            assert of(theta + step * np.eye(len(theta))[k]) < best + 1e-3


def test_training_rows_are_bounded(spark, labels, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf.Chain, "fit", lambda self, z, owner, bad, **_: seen.append(Counter(owner.tolist())) or self)
    long = docs.withColumn("text", F.repeat(F.concat("text", F.lit("\n")), 40))
    quality_crf.fit(long.unionByName(long), labels, max_docs=20, max_lines=30)
    assert len(seen[0]) == 20 and max(seen[0].values()) == 30


def test_classifier_odd_rows(odd, none, labels):
    got = quality_crf.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_crf.classify(none, labels).count() == 0
    assert quality_crf.classify(odd, labels, keep_columns=True).columns == odd.columns


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(4)
    c = quality_crf.Chain(3)
    c.w, c.bias, c.move, c.start = rng.normal(size=3), 0.3, rng.normal(size=(2, 2)), -0.4
    z, owner = rng.normal(size=(7, 3)), np.array([0, 0, 0, 0, 1, 2, 2])
    s, want = z @ c.w + c.bias, np.zeros(7)
    for d in range(3):
        at = np.flatnonzero(owner == d)
        total = 0.0
        for code in range(1 << len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            p = np.exp(c.start * y[0] + sum(s[i] * v for i, v in zip(at, y, strict=True)) + sum(c.move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            want[at] += p * np.array(y)
        want[at] /= total
    assert np.allclose(c.marginals(z, owner), want)


# ------------------------------------------------------------------ 10: rules
def test_rule_counts(docs, odd, none, labels):
    names = ("words", "word_chars", "symbols", "dup_lines", "repeat")
    for df in (docs, odd):
        want = Counter()
        for i, t in pairs(df):
            w = GAP.findall(t)
            seen = Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
            rows = [x for x in t.split("\n") if GAP.search(x)]
            n = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(covered))
            want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
        got = rules.assess(df, labels).collect()
        assert Counter((r.doc_id, *(r[c] for c in names), r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
        assert rules.kept_rows(df, labels).count() == sum(r.kept for r in got)
    assert rules.assess(none, labels).count() == 0 == rules.kept_rows(none, labels).count()


def test_binomial_bound(spark):
    from math import comb, log

    rows = [(k, n) for n in (20, 400) for k in range(0, n // 8)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.125).alias("x")).collect()
    for r in got:
        assert abs(r.x - log(sum(comb(r.n, i) * 0.125**i * 0.875 ** (r.n - i) for i in range(r.k + 1)))) < 1e-9


def test_cutoffs_limit_false_rejection(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = rules.assess(d, lab).join(lab.where("quality = 1"), "doc_id").where("not base_failed")
    per = got.groupBy("stratum").agg(F.avg((~F.col("kept")).cast("double")).alias("lost"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in per) > 1000 and all(r.lost <= rules.RISK for r in per)


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, docs):
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        if name != "BPE encoding":
            assert out.columns == docs.columns
            assert out.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = spark.createDataFrame(out.collect(), out.schema)
    assert before.count() > 50
    assert Counter(corpus_pipeline.run(spark, SF).collect()) == Counter(before.collect())


def test_pipeline_ends_in_ids(spark, docs, odd):
    t = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        out = corpus_pipeline.bpe_encoding(spark, df, SF)
        got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256) for r in out.collect())
        want = Counter()
        for i, x in pairs(df):
            ids = np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
            want[i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest()] += 1
        assert got == want
        assert Counter(map(tuple, bpe_codec.decode(out, BYTE).collect())) == Counter(pairs(df))


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
