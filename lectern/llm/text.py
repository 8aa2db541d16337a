"""Array kernels over whole Arrow batches of text: words, pre-tokens, hashes of segments, shingles."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import store

U = np.uint64
#: Bytes of text that a task's arrays are over at a time; they take about a hundred times as much.
CHUNK = 1 << 19


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    size = np.diff(at)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count and size[~column.is_valid().to_numpy(zero_copy_only=False)].any():
        return utf8(column.fill_null(""))
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut so that the text of each takes at most `limit` bytes, or is one row; with its bytes and offsets."""
    with store.tidied():
        yield from _pieces(batches, column, limit)


def _pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit in changes about half of those out."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; kept for the largest usual chunk."""
    if len(_pow[0]) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(n, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if n > 8 * CHUNK:
            return out[0], out[1]
        _pow[:] = out
    return _pow[0], _pow[1]


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASE))


#: Segments from so many values on are hashed by a digest: a polynomial modulo 2**64 tells some long ones apart no more.
LONG = 64


def hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each segment: short ones by differences of one running polynomial."""
    n = len(values)
    if not len(start):
        return np.zeros(0, U)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(values * up[:n], out=total[1:])
    size = end - start
    out = mix((total[end] - total[start]) * down[start] + size.astype(U) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than 9-13 and 32, and the number of such words of each row."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(at) - 1, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each row's number of them."""
    start, end, count = words(data, at)
    return hashes(byte_values()[_LOWER[data]], start, end), count


@lru_cache(maxsize=16)
def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on, whatever rows they are in."""
    a, n = _weights(k), len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    x = h[:n] * a[0]
    for j in range(1, k):
        x = x + h[j : n + j] * a[j]
    return mix(x + U(k))


def shingles(h: np.ndarray, count: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles, as sorted hashes; the whole sequence where a row has fewer words."""
    a, all_k = _weights(k), shingle_hashes(h, k)
    out, i = [], 0
    for c in count.tolist():
        if c >= k:
            s = np.sort(all_k[i : i + c - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif c:
            out.append(mix(np.array([int((h[i : i + c] * a[:c]).sum(dtype=U))], U) + U(c)))
        else:
            out.append(np.zeros(0, U))
        i += c
    return out


# Classes of code points for pre-tokenizing.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def code_points() -> np.ndarray:
    """All of them but the surrogates, which no text holds."""
    return np.r_[0:0xD800, 0xE000:0x110000]


def classes(cut) -> np.ndarray:
    """The class of each code point as a pre-tokenizer has it; `cut` gives the pieces of a string and their places.

    All code points in order are cut where the class changes (or more often), and the first of each run is judged by what
    it joins.  So the library's own version of Unicode decides.
    """
    every = code_points()
    whole = "".join(map(chr, every.tolist()))
    edge = np.zeros(len(every) + 1, bool)
    edge[[0, 32, 33]] = True  # a space joins what follows
    for _, ends in cut(whole):
        edge[list(ends)] = True
    grouped = len(cut("11")) == 1

    def joins(x: str) -> bool:
        return [ends for _, ends in cut(x)] == [(0, len(x))]

    def kind(c: str) -> int:
        if joins("a" + c):
            return LETTER
        if joins("!" + c):
            return OTHER
        return NUMBER if (joins("1" + c) if grouped else cut(c)) else SPACE

    first = np.flatnonzero(edge[:-1])
    out = np.zeros(0x110000, np.uint8)
    out[every] = np.repeat(np.array([kind(whole[i]) for i in first.tolist()], np.uint8), np.diff(np.append(first, len(every))))
    return out


def codepoints(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of strings one after another, and the n + 1 offsets."""
    cp = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


def code_values(cp: np.ndarray) -> np.ndarray:
    """Values for `hashes` of code points."""
    x = (cp.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _runs(cp: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the code points, whether a run of one class starts there, and whether a piece starts or ends there."""
    kind = kinds[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[at] = True
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    return kind, run, edge


def _contractions(cp: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a token starts with 's 't 'm 'd 're 've 'll, where that ends, and where its piece ends."""
    i = np.flatnonzero((cp == 39) & start)
    end = at[np.searchsorted(at, i, "right")]
    at_most = len(cp) - 1
    one = np.where(i + 1 < end, cp[np.minimum(i + 1, at_most)], 0)
    two = np.where(i + 2 < end, cp[np.minimum(i + 2, at_most)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(i), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    ok = short | long
    return i[ok], i[ok] + np.where(short, 2, 3)[ok], end[ok]


def byte_level_tokens(cp: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pre-token starts that the byte-level pattern finds, and how many each piece has; none is left out.

    The pattern takes contractions, then letters, numbers or others with one space before them, then white space, of
    which the last character stays for what follows.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    kind, start, edge = _runs(cp, at, kinds)
    first = np.flatnonzero(start)
    after = np.append(first[1:], n)
    gap = (kind[first] == SPACE) & ~edge[after]
    j = after[gap]
    start[j - 1] = True
    start[j[cp[j - 1] == 32]] = False
    i, end, last = _contractions(cp, at, start)
    start[i + 1] = False
    start[end[end < last]] = True
    first = np.flatnonzero(start)
    return first, np.diff(np.searchsorted(first, at))


def word_level_tokens(cp: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token, and how many each piece has: contractions, letters, single numbers, others."""
    n = len(cp)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(at) - 1, np.int64)
    kind, start, _ = _runs(cp, at, kinds)
    start |= kind == NUMBER
    i, end, last = _contractions(cp, at, start)
    start[i + 1] = False
    start[end[end < last]] = True
    first = np.flatnonzero(start)
    after = np.append(first[1:], n)
    word = kind[first] != SPACE
    first, after = first[word], after[word]
    return first, after, np.diff(np.searchsorted(first, at))


def split_special(texts: list[str | None], special: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, str]]]:
    """Texts cut at special strings: the pieces, each one's text, and (piece that it stands before, string) of each."""
    if not any(s in t for s in special for t in texts if t):
        return [t or "" for t in texts], np.arange(len(texts)), []
    import re

    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    out, owner, found = [], [], []
    for i, t in enumerate(texts):
        for j, p in enumerate(cut.split(t or "")):
            if j % 2:
                found.append((len(out), p))
            else:
                out.append(p)
                owner.append(i)
    return out, np.array(owner), found


class HashTable:
    """64-bit keys to small numbers in two flat arrays, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot, self.probes = self._slot(keys), 0
        while len(left):
            self.probes += 1
            at = slot[left]
            put, who = np.unique(np.where(self.values[at] < 0, at, -1), return_index=True)
            put, who = put[put >= 0], who[put >= 0]
            self.keys[put], self.values[put] = keys[left[who]], values[left[who]]
            left = np.delete(left, who)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(BASE)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (self.values[at] >= 0)]
        return out
