"""Words of many texts at once: exact splitting and a table of known words, in numpy.

Byte-pair vocabularies work word by word, and most words of a text are known already. Texts
are concatenated as code points, split by runs of character classes as the published
patterns do, and looked up by a 64-bit hash in an open table; each hit is compared character
by character, so no hash collision can change a result. Only new words are given to the
function that makes a word's values (ids, or a count).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from .common import mix64, powers

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)

#: Characters of text that one numpy pass works on, and bytes of words that a table keeps.
PASS_CHARS, TABLE_BYTES = 1 << 19, 96 << 20
#: A place where every split has a boundary, so that long texts can be cut there.
_SAFE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, plain space, other white space, other."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[32] = SPACE
    return out


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    return powers(base, size)


def _power(base: int, n: int) -> np.ndarray:
    """The first powers of a base, kept for passes of the usual size."""
    return _powers(base, 2 * PASS_CHARS)[:n] if n <= 2 * PASS_CHARS else powers(base, n)


def pieces(text: str, size: int = PASS_CHARS) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut only where words end anyway."""
    at = 0
    while len(text) - at > 2 * size and (m := _SAFE_CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def bounds(points: np.ndarray, cuts: np.ndarray, joins: bool, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of concatenated segments (``cuts``: their offsets).

    Words are runs of letters, of numbers or of other characters, and the contractions 's 't
    're 've 'm 'll 'd at the start of a run. With ``joins`` (byte-level vocabularies) a plain
    space belongs to the run after it and the white space before that is a word of its own;
    without, white space is left out and every digit is a word. Segments marked ``whole``
    are one word each.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    run = np.minimum(kind, BLANK)
    begins = cuts[:-1][cuts[1:] > cuts[:-1]]
    start = np.ones(n, dtype=bool)
    np.not_equal(run[1:], run[:-1], out=start[1:])
    start[begins] = True
    last = np.ones(n, dtype=bool)
    last[:-1] = start[1:]
    final = np.zeros(n, dtype=bool)
    final[cuts[1:][cuts[1:] > 0] - 1] = True
    if joins:
        tail = np.flatnonzero(last & (run == BLANK) & ~final)
        start[tail] = True
        start[tail[kind[tail] == SPACE] + 1] = False
    else:
        start |= run == NUMBER
    mark = np.flatnonzero((points == 39) & start & last & ~final)
    if len(mark):
        one = points[mark + 1]
        two = np.where(final[mark + 1], 0, points[np.minimum(mark + 2, n - 1)])
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = (is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        start[mark[short | long] + 1] = False
        after = np.concatenate((mark[short] + 2, mark[long] + 3))
        start[after[after < n]] = True
    if whole is not None and whole.any():
        forced = np.repeat(whole, np.diff(cuts))
        start[forced] = False
        start[cuts[:-1][whole & (cuts[1:] > cuts[:-1])]] = True
    a = np.flatnonzero(start)
    b = np.append(a[1:], n)
    if not joins:
        words = run[a] != BLANK
        if whole is not None:
            words |= np.repeat(whole, np.diff(cuts))[a]
        a, b = a[words], b[words]
    return a, b


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin .. begin + size - 1 of every range, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class WordTable:
    """Word -> values (integers), made on first use.

    Bounded by bytes: when words and values exceed ``most`` bytes, those used since the last
    time stay if they take half of it at most, else the table begins anew.
    """

    def __init__(self, make: Callable[[str], list[int]], most: int = TABLE_BYTES):
        self.make, self.most = make, most
        self._empty()

    def _empty(self) -> None:
        self.points, self.values, self.hash = _Grown(np.uint32), _Grown(np.int32), _Grown(_U)
        self.at, self.size, self.first, self.count = (_Grown(np.int64) for _ in range(4))
        self.used = _Grown(bool)
        self.slots = np.full(1 << 14, -1, dtype=np.int32)

    def bytes(self) -> int:
        return 4 * (self.points.n + self.values.n) + 57 * self.at.n

    def _place(self, entries: np.ndarray) -> None:
        """Write entries into free slots, each from the slot of its hash on."""
        mask, shift = len(self.slots) - 1, _U(65 - len(self.slots).bit_length())
        at = (self.hash.all()[entries] >> shift).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & mask

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask, shift = len(self.slots) - 1, _U(65 - len(self.slots).bit_length())
        out = np.full(len(h), -1, dtype=np.int64)
        todo, at, known = np.arange(len(h)), (h >> shift).astype(np.int64), self.hash.data
        while len(todo):
            e = self.slots[at]
            hit = (e >= 0) & (known[e] == h[todo])
            out[todo[hit]] = e[hit]
            on = (e >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def _append(self, h: np.ndarray, words: list[str], points: np.ndarray, size: np.ndarray) -> np.ndarray:
        made = [self.make(w) for w in words]
        count = np.array([len(x) for x in made], dtype=np.int64)
        new = np.arange(self.at.n, self.at.n + len(words), dtype=np.int64)
        self.at.add(self.points.n + np.cumsum(size) - size)
        self.first.add(self.values.n + np.cumsum(count) - count)
        self.size.add(size), self.count.add(count), self.hash.add(h)
        self.used.add(np.ones(len(words), dtype=bool))
        self.points.add(points)
        self.values.add(np.array([v for x in made for v in x], dtype=np.int32))
        return new

    def _shrink(self) -> None:
        old = {k: getattr(self, k).all() for k in ("points", "values", "hash", "at", "size", "first", "count", "used")}
        keep = np.flatnonzero(old["used"])
        small = 4 * int(old["size"][keep].sum() + old["count"][keep].sum()) + 57 * len(keep) <= self.most // 2
        self._empty()
        if small and len(keep):
            size, count = old["size"][keep], old["count"][keep]
            self.at.add(np.cumsum(size) - size), self.first.add(np.cumsum(count) - count)
            self.size.add(size), self.count.add(count), self.hash.add(old["hash"][keep])
            self.points.add(old["points"][spread(old["at"][keep], size)])
            self.values.add(old["values"][spread(old["first"][keep], count)])
            self.used.add(np.zeros(len(keep), dtype=bool))
            self._rebuild(np.arange(len(keep), dtype=np.int64))

    def _rebuild(self, entries: np.ndarray) -> None:
        slots = len(self.slots)
        while slots < 2 * len(entries):
            slots *= 2
        self.slots = np.full(slots, -1, dtype=np.int32)
        self._place(entries)

    @staticmethod
    def hashes(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its code points, finalised."""
        sums = np.zeros(len(points) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum((points.astype(_U) + _U(0x1F123BB5)) * _power(_BASE, len(points)), out=sums[1:])
            return mix64((sums[b] - sums[a]) * _power(_INVERSE, len(points))[a] + (b - a).astype(_U))

    def find(self, text: str, points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each word text[a:b], new ones made."""
        if self.bytes() > self.most:
            self._shrink()
        h, size = self.hashes(points, a, b), b - a
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            _, at = np.unique(h[miss], return_index=True)
            at = miss[np.sort(at)]
            new = self._append(h[at], [text[i:j] for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)], points[spread(a[at], size[at])], size[at])
            if 2 * self.at.n > len(self.slots):  # words that collided before are in no slot, and need none
                self._rebuild(np.arange(self.at.n, dtype=np.int64))
            else:
                self._place(new)
            entry[miss] = self._find(h[miss])
        alike = self.size.data[entry] == size
        if alike.all():
            there = self.points.data[spread(self.at.data[entry], size)] == points[spread(a, size)]
            if not there.all():
                alike &= np.logical_and.reduceat(there, np.cumsum(size) - size)
        else:
            ok = np.flatnonzero(alike)
            there = self.points.data[spread(self.at.data[entry[ok]], size[ok])] == points[spread(a[ok], size[ok])]
            alike[ok] = np.logical_and.reduceat(there, np.cumsum(size[ok]) - size[ok]) if len(ok) else alike[ok]
        for i in np.flatnonzero(~alike).tolist():  # another word has this hash: an entry of its own
            entry[i] = self._append(h[i : i + 1], [text[a[i] : b[i]]], points[a[i] : b[i]], size[i : i + 1])[0]
        self.used.data[entry] = True
        return entry

    def of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the entries, one after the other, and how many each has."""
        count = self.count.data[entry]
        return self.values.data[spread(self.first.data[entry], count)], count


class TextTable:
    """Values of whole texts, word by word, through a ``WordTable``.

    ``cut`` splits a text at special strings, ``special`` is their values; ``words`` gives
    the words of a text that must not be split here (or None), ``prepare`` a text's
    normalised form.
    """

    def __init__(self, make: Callable[[str], list[int]], joins: bool, special: dict[str, list[int]], cut: Callable[[str], list[str]], prepare: Callable[[str], str | list[str]] | None = None, most: int = TABLE_BYTES):
        self.table = WordTable(lambda w: special[w] if w in special else make(w), most)
        self.joins, self.special, self.cut, self.prepare = joins, special, cut, prepare

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that are split on their own; those marked are one word each."""
        parts = self.cut(text) if any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield part, True
            else:
                for piece in pieces(part) if part else ():
                    got = self.prepare(piece) if self.prepare else piece
                    if isinstance(got, str):
                        yield got, False
                    else:
                        yield from ((w, True) for w in got)

    def _pass(self, parts: list[str], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Values of the parts' words and how many each part has."""
        text = "".join(parts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        cuts = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        a, b = bounds(points, cuts, self.joins, np.array(whole, dtype=bool))
        values, count = self.table.of(self.table.find(text, points, a, b)) if len(a) else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        upto = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(a, cuts)]
        return values, np.diff(upto)

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts, one after the other, and the offsets of each text in them."""
        out, counts, owner = [np.zeros(0, dtype=np.int32)], [], []
        parts, whole, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if parts:
                got, each = self._pass(parts, whole)
                out.append(got), counts.append(each)
                parts.clear(), whole.clear()
                held = 0

        for i, t in enumerate(texts):
            for part, one in self._segments(t) if t else ():
                if held and held + len(part) > PASS_CHARS:
                    flush()
                parts.append(part), whole.append(one), owner.append(i)
                held += len(part)
        flush()
        sizes = np.bincount(owner, np.concatenate(counts), minlength=len(texts)).astype(np.int64) if owner else np.zeros(len(texts), dtype=np.int64)
        return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))
