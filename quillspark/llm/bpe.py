"""Byte-pair vocabularies and the two merge loops, over tables of known words.

``VOCABULARY`` files are parameters (paths); they are never copied here. The files are
small and fixed, so every executor reads its own installed copy once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from .word_table import TextTable

NEVER = 1 << 60
#: Words of more bytes go through the heap, as scanning a rank array is quadratic.
SHORT = 128


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    at = {b: chr(b) for b in shown}
    return [at[b] if b in at else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-pair vocabulary file: symbol ids, ranked merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_id = [ids[c] for c in chars]
        self.last_id = [ids[c + suffix] for c in chars] if suffix else self.byte_id
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] * self.size + ids[b]] = r
            self.made.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        back = {c: b for b, c in enumerate(chars)}
        self.piece = [b""] * self.size
        for token, i in ids.items():
            self.piece[i] = bytes(back[c] for c in token) if not suffix else token.encode()
        for token, i in self.special.items():
            self.piece[i] = token.encode()

    def symbols(self, word: bytes) -> list[int]:
        out = [self.byte_id[b] for b in word]
        out[-1] = self.last_id[word[-1]]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_rank_array(v: Vocabulary, word: bytes) -> list[int]:
    """Ids of one word: a contiguous array of adjacent ranks, scanned for its minimum.

    ``parts[i]`` is the id between boundaries i and i+1, ``ranks[i]`` the rank of the pair
    around boundary i+1. The first lowest rank names the boundary to delete; only its two
    neighbours are looked up anew. Words beyond SHORT bytes take the heap, with equal ids.
    """
    if len(word) > SHORT:
        return by_heap(v, word)
    parts, rank, n = v.symbols(word), v.rank.get, v.size
    ranks = [rank(parts[i] * n + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
    while ranks and (low := min(ranks)) != NEVER:
        i = ranks.index(low)
        parts[i] = v.made[low]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank(parts[i] * n + parts[i + 1], NEVER)
        if i:
            ranks[i - 1] = rank(parts[i - 1] * n + parts[i], NEVER)
    return parts


def _heap_merges(v: Vocabulary, ids: list[int]) -> tuple[list[int], int]:
    """Merge in place over a linked list; returns the list of next positions and the merge count."""
    n, size, rank = len(ids), v.size, v.rank.get
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != a or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = v.made[r], -1
        merges += 1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (s := rank(ids[i] * size + ids[k])) is not None:
                heapq.heappush(heap, (s, i, ids[i], ids[k]))
        h = before[i]
        if h >= 0 and (s := rank(ids[h] * size + ids[i])) is not None:
            heapq.heappush(heap, (s, h, ids[h], ids[i]))
    return after, merges


def by_heap(v: Vocabulary, word: bytes) -> list[int]:
    ids = v.symbols(word)
    _heap_merges(v, ids)
    return [i for i in ids if i >= 0]


def count_by_heap(v: Vocabulary, word: bytes) -> int:
    """Number of ids of one word: its initial symbols minus the merges made."""
    ids = v.symbols(word)
    return len(ids) - _heap_merges(v, ids)[1]


#: Beyond this code point, scripts and Unicode versions differ enough to ask the library itself.
_KNOWN = re.compile("[\x00-\u052f\u1e00-\u1eff\u2000-\u206f]*").fullmatch


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def normalised(text: str, path: str) -> str | list[str]:
    """NFC and lower case letter by letter, still to be split, or the words themselves.

    Texts with characters whose class depends on the Unicode version are normalised and
    split by the tokenizers library's own stages, so that versions cannot disagree.
    """
    if _KNOWN(text):
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    t = library(path)
    back = _symbol_bytes()
    return [bytes(back[c] for c in piece).decode() for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]


@lru_cache(maxsize=1)
def _symbol_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_symbols())}


def byte_level_table(path: str, make: Callable[[str], list[int]]) -> TextTable:
    """Ids of whole texts for a byte-level vocabulary; ``make`` encodes a word."""
    v = vocabulary(path)
    return TextTable(make, True, {s: [i] for s, i in v.special.items()}, v.cut)


@lru_cache(maxsize=4)
def rank_array_ids(path: str) -> TextTable:
    """Ids by the rank-array loop, kept by the Python worker from task to task."""
    v = vocabulary(path)
    return byte_level_table(path, lambda w: by_rank_array(v, w.encode()))


@lru_cache(maxsize=4)
def library_ids(path: str) -> TextTable:
    """Ids by the tokenizers library: its model encodes each word of the published pre-split."""
    model, symbol = library(path).model, dict(enumerate(byte_symbols()))
    return byte_level_table(path, lambda w: [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(symbol))])


@lru_cache(maxsize=4)
def heap_counts(path: str) -> TextTable:
    """Numbers of ids by the heap, a number a word, for a vocabulary with word ends."""
    v = vocabulary(path)
    return TextTable(lambda w: [count_by_heap(v, w.encode())], False, {s: [1] for s in v.special}, v.cut, lambda t: normalised(t, path))
