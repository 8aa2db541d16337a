"""Edit distances of many pairs of strings at once, for tasks that hold tables of them.

A column of the distance table is two bit vectors, of where it rises and falls by one along the longer string (Myers 1999, in
blocks of 64 letters after Hyyrö 2003).  The vectors of all pairs and blocks are one array: in one step each block takes the
letter of the shorter string that the block before it took in the last step.  Strings of over LONG letters take a row of the
table at a time instead.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONES, TOP = U(0xFFFFFFFFFFFFFFFF), U(63)
#: Letters of a string up to which pairs go together; vectors and letters' masks that are held at once, 8 bytes each.
LONG, VECTORS, MASKS = 4096, 1 << 18, 1 << 21
#: Bits of masks that are set, as bytes, before they are packed; letters of strings whose pairs `between` takes at once.
BITS, CHARS = 1 << 23, 1 << 21


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after another, and where each begins."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _by_rows(x: np.ndarray, y: np.ndarray) -> int:
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, c in enumerate(x, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (y != c)]))
        new[0] = i
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def distances(strings: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of strings[a[k]] and strings[b[k]] for each k."""
    code, at = _codes(strings)
    size = np.diff(at)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    longer = size[a] >= size[b]
    p, t = np.where(longer, a, b), np.where(longer, b, a)
    out = size[p].copy()
    blocks = (size[p] + 63) // 64
    todo = (size[t] > 0) & (p != t)
    out[p == t] = 0
    for k in np.flatnonzero(todo & (size[p] > LONG)).tolist():
        out[k] = _by_rows(code[at[p[k]] : at[p[k] + 1]], code[at[t[k]] : at[t[k] + 1]])
    todo &= size[p] <= LONG
    least = 0
    while (todo & (blocks > least)).any():  # one block, two, up to four, up to eight ...
        w = max(1, 2 * least)
        rows = np.flatnonzero(todo & (blocks > least) & (blocks <= w))
        rows = rows[np.argsort(p[rows], kind="stable")]
        step = max(1, VECTORS // w)
        for i in range(0, len(rows), step):
            _group(code, at, p, t, rows[i : i + step], w, out)
        least = w
    return out


def between(left: list[str], right: list[str]) -> np.ndarray:
    """The distance of left[k] and right[k] for each k; equal ones, and pairs that come again, cost nothing."""
    pairs = {(x, y): 0 for x, y in zip(left, right, strict=True) if x != y}
    todo, i = list(pairs), 0
    while i < len(todo):
        upto, chars, named = i, 0, {}
        while upto < len(todo) and (upto == i or chars < CHARS):
            for x in todo[upto]:
                if x not in named:
                    named[x] = len(named)
                    chars += len(x)
            upto += 1
        a, b = (np.fromiter((named[pair[side]] for pair in todo[i:upto]), np.int64, upto - i) for side in (0, 1))
        pairs.update(zip(todo[i:upto], distances(list(named), a, b).tolist(), strict=True))
        i = upto
    return np.fromiter((0 if x == y else pairs[x, y] for x, y in zip(left, right, strict=True)), np.int64, len(left))


def _group(code: np.ndarray, at: np.ndarray, p: np.ndarray, t: np.ndarray, rows: np.ndarray, w: int, out: np.ndarray) -> None:
    """Pairs whose longer string takes up to w blocks, with the masks of as many such strings at once as MASKS allows."""
    named, which = np.unique(p[rows], return_inverse=True)
    letters = np.unique(np.concatenate([code[at[s] : at[s + 1]] for s in named]))
    kinds = len(letters) + 1
    most = max(1, MASKS // (w * kinds))
    if len(named) > most:
        for i in range(0, len(named), most):
            _group(code, at, p, t, rows[(which >= i) & (which < i + most)], w, out)
        return
    x = np.minimum(np.searchsorted(letters, code), len(letters) - 1)
    letter = np.append(np.where(letters[x] == code, x, len(letters)), np.full(w, len(letters)))
    masks = np.zeros((w, len(named), kinds), U)
    part = max(1, BITS // (64 * w * kinds))
    for i in range(0, len(named), part):
        own = named[i : i + part]
        n = at[own + 1] - at[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hot = np.zeros((len(own), kinds, 64 * w), bool)
        hot[np.repeat(np.arange(len(own)), n), letter[np.repeat(at[own], n) + place], place] = True
        masks[:, i : i + part] = np.packbits(hot, axis=2, bitorder="little").view("<u8").transpose(2, 0, 1)
    masks = masks.reshape(-1)
    size = at[t[rows] + 1] - at[t[rows]]
    order = np.argsort(-size, kind="stable")
    rows, which, size = rows[order], which[order] * kinds, size[order]
    begin, n, length = at[t[rows]], len(rows), at[p[rows] + 1] - at[p[rows]]
    end, last = (length - 1) >> 6, U(1) << ((length - 1) & 63).astype(U)
    up, down, score = np.full((w, n), ONES), np.zeros((w, n), U), length.copy()
    rise, fall = np.ones((w + 1, n), U), np.zeros((w + 1, n), U)  # what the block before gave on
    longest = int(size[0])
    for s in range(longest + w - 1):
        k = int(np.searchsorted(-size, -(s - w + 1), "left"))  # strings that some block still reads
        a, b = max(0, s - longest + 1), min(w, s + 1)
        block = np.arange(a, b)[:, None]
        eq = masks[block * (len(named) * kinds) + (which[:k] + letter[np.minimum(begin[:k] + (s - block), len(letter) - 1)])]
        pv, mv, r, f = up[a:b, :k], down[a:b, :k], rise[a:b, :k].copy(), fall[a:b, :k].copy()
        xv = eq | mv
        eq |= f
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if w == 1:
            score[:k] += (ph[0] & last[:k]) != 0
            score[:k] -= (mh[0] & last[:k]) != 0
        else:
            at_end = np.flatnonzero((end[:k] >= a) & (end[:k] < b) & (s - end[:k] < size[:k]))
            score[at_end] += (ph[end[at_end] - a, at_end] & last[at_end]) != 0
            score[at_end] -= (mh[end[at_end] - a, at_end] & last[at_end]) != 0
        rise[a + 1 : b + 1, :k], fall[a + 1 : b + 1, :k] = ph >> TOP, mh >> TOP
        ph, mh = (ph << U(1)) | r, (mh << U(1)) | f
        up[a:b, :k], down[a:b, :k] = mh | ~(xv | ph), ph & xv
    out[rows] = score
