"""The cheapest monotone alignment of two lists of lines, for pages of any length.

Rows of the cost table are folded one after another, each as one array; what a cell took is one byte.  Of long pages only a
band around the diagonal is computed.  A path that leaves it skips so many lines on both sides that it costs at least the sum
of that many shortest ones; the band widens until the best path within costs less, so the result, ties included, is that of
the whole table.  Distances are taken only where they matter: the table is first filled with what letters' counts say that a
distance is at least, and those on the cheapest path are taken until it has no others.  All that were cheapest by true
distances are so by these too, so the first of them by the order of ties is the same.  Bytes of at most CELLS cells are held: of larger tables a first pass keeps some rows' costs, and a second
one, from the last such row to the first, goes back along the path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .distance import between, distances

#: Half the first band; pairs of lines whose distances are taken at once; cells whose bytes are held.
BAND, PAIRS, CELLS = 32, 1 << 16, 1 << 26
FAR = 1 << 60
#: Kinds that letters are counted by, and rounds after which a page's distances are all taken.
KINDS, ROUNDS = 32, 16
MATCH, SKIP_PRED, SKIP_TRUTH = 0, 1, 2


class Table:
    """The table of one page; `rows(first, last, low, high)` gives the distances of lines first..last-1 to low..high-1 of the truth."""

    def __init__(self, p: list[str], g: list[str], rows: Callable[[int, int, int, int], np.ndarray] | None = None):
        self.lp, self.lg = (np.fromiter(map(len, x), np.int64, len(x)) for x in (p, g))
        self.before = np.concatenate([[0], np.cumsum(self.lg)])
        self.low = [x.lower() for x in (*p, *g)]
        self.given, self.rows, self.found = rows is not None, rows or self._bounds, None
        self.known, self.taken = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @cached_property
    def counts(self) -> np.ndarray:
        """How many letters of each kind a line has."""
        size = np.fromiter(map(len, self.low), np.int64, len(self.low))
        code = np.frombuffer("".join(self.low).encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS
        return np.bincount(np.repeat(np.arange(len(size)) * KINDS, size) + code, minlength=len(size) * KINDS).reshape(-1, KINDS).astype(np.int32)

    def _bounds(self, first: int, last: int, low: int, high: int) -> np.ndarray:
        """What the distances are at least, and those that were taken."""
        n, m = len(self.lp), len(self.lg)
        x, y = self.counts[first:last], self.counts[n + low : n + high]
        out = np.abs(x.sum(1)[:, None] - y.sum(1)).astype(np.int64)
        for k in range(KINDS):
            out += np.abs(x[:, k, None] - y[:, k])
        out //= 2
        own = slice(*np.searchsorted(self.known, (first * m, last * m)))
        i, j = np.divmod(self.known[own], m)
        inside = (j >= low) & (j < high)
        out[i[inside] - first, j[inside] - low] = self.taken[own][inside]
        return out

    def wanted(self, match: np.ndarray) -> np.ndarray:
        """The pairs of a path whose distances were not taken."""
        i = np.flatnonzero(match >= 0)
        return np.setdiff1d(i * len(self.lg) + match[i], self.known)

    def learn(self, pairs: np.ndarray, distance: np.ndarray) -> None:
        at = np.searchsorted(self.known, pairs)
        self.known, self.taken = np.insert(self.known, at, pairs), np.insert(self.taken, at, distance)

    def distances(self) -> np.ndarray:
        """The distance of each prediction to its partner, or its length if it has none."""
        out, match = self.lp.copy(), self.best()[1]
        i = np.flatnonzero(match >= 0)
        pairs = i * len(self.lg) + match[i]
        if np.isin(pairs, self.known).all():
            out[i] = self.taken[np.searchsorted(self.known, pairs)]
        else:
            out[i] = between([self.low[k] for k in i], [self.low[len(self.lp) + j] for j in match[i]])
        return out

    def _rows(self, first: int, last: int, low: int, high: int) -> np.ndarray:
        n, part = len(self.lp), self.low[first:last] + self.low[len(self.lp) + low : len(self.lp) + high]
        a, b = np.divmod(np.arange((last - first) * (high - low)), high - low)
        return distances(part, a, b + (last - first)).reshape(last - first, high - low) if n else np.zeros((0, 0), np.int64)

    def span(self, i: int, band: int) -> tuple[int, int]:
        """First and last cell of row i within the band."""
        turn = len(self.lg) - len(self.lp)
        return max(0, i + min(0, turn) - band), min(len(self.lg), i + max(0, turn) + band)

    def outside(self, band: int) -> int:
        """What a path that leaves the band costs at least."""
        turn = len(self.lg) - len(self.lp)
        sums = [np.concatenate([[0], np.cumsum(np.sort(x))]) for x in (self.lp, self.lg)]
        out = FAR
        for p, g in ((max(0, turn) + band + 1 - turn, max(0, turn) + band + 1), (band + 1 - min(0, turn), band + 1 - min(0, turn) + turn)):
            if p <= len(self.lp) and g <= len(self.lg):
                out = min(out, int(sums[0][p] + sums[1][g]))
        return out

    def fold(self, row: np.ndarray, first: int, last: int, band: int, took: list[np.ndarray] | None) -> np.ndarray:
        """The costs of row `last` from those of row `first`; what the cells of the rows between took goes to `took`."""
        i = first
        while i < last:
            upto, low = i + 1, max(1, self.span(i + 1, band)[0])
            while upto < last and (upto + 1 - i) * (self.span(upto + 1, band)[1] + 1 - low) <= PAIRS:
                upto += 1
            high = self.span(upto, band)[1]
            cost = self.rows(i, upto, low - 1, high)
            for k in range(i + 1, upto + 1):
                a, b = self.span(k, band)
                up = row[a : b + 1] + self.lp[k - 1]
                diagonal = np.full(b - a + 1, FAR)
                j = max(a, 1)
                diagonal[j - a :] = row[j - 1 : b] + cost[k - 1 - i, j - low : b + 1 - low]
                base = self.before[a : b + 1]
                new = np.minimum.accumulate(np.minimum(diagonal, up) - base) + base
                if took is not None:
                    took.append(np.where(new == diagonal, MATCH, np.where(new == up, SKIP_PRED, SKIP_TRUTH)).astype(np.uint8))
                row[a : b + 1] = new
                if a:
                    row[a - 1] = FAR
            i = upto
        return row

    def path(self, band: int) -> tuple[int, np.ndarray]:
        """Cost, and for each prediction the truth line that it matches, or -1."""
        n, m = len(self.lp), len(self.lg)
        width = min(m + 1, 2 * band + 2 + abs(m - n))
        step = max(1, CELLS // width)
        row = np.full(m + 1, FAR)
        high = self.span(0, band)[1]
        row[: high + 1] = self.before[: high + 1]
        kept, took, at = [(0, row.copy())], [], 0
        while at < n:
            last = min(n, at + step)
            took = [] if last == n else None
            row = self.fold(row, at, last, band, took)
            at = last
            if at < n:
                kept.append((at, row.copy()))
        cost, match, i, j = int(row[m]), np.full(n, -1, np.int64), n, m
        for first, state in reversed(kept):
            if took is None:
                took = []
                self.fold(state, first, min(n, first + step), band, took)
            while i > first:
                op = took[i - first - 1][j - self.span(i, band)[0]]
                if op == MATCH:
                    match[i - 1] = j - 1
                i, j = i - (op != SKIP_TRUTH), j - (op != SKIP_PRED)
            took = None
        return cost, match

    def best(self) -> tuple[int, np.ndarray]:
        if self.found is None:
            settle([self])
        return self.found

    def banded(self) -> tuple[int, np.ndarray]:
        n, m = len(self.lp), len(self.lg)
        if not n or not m:
            return int(self.lp.sum() + self.lg.sum()), np.full(n, -1, np.int64)
        band = BAND
        while True:
            whole = band >= max(n, m)
            cost, match = self.path(band)
            if whole or cost < self.outside(band):
                return cost, match
            band *= 4


def settle(tables: list[Table]) -> None:
    """Find the path of each page; distances that several pages ask for are taken together."""
    left = list(tables)
    for _ in range(ROUNDS):
        if not left:
            break
        asked = []
        for t in left:
            t.found = t.banded()
            if not t.given and len(want := t.wanted(t.found[1])):
                asked.append((t, want))
        pairs = [(t, *divmod(w, len(t.lg))) for t, want in asked for w in want.tolist()]
        d, at = between([t.low[i] for t, i, _ in pairs], [t.low[len(t.lp) + j] for t, _, j in pairs]), 0
        for t, want in asked:
            t.learn(want, d[at : at + len(want)])
            at += len(want)
        left = [t for t, _ in asked]
    for t in left:
        t.rows = t._rows
        t.found = t.banded()


def _tables(pages: list[tuple[list[str], list[str]]]) -> Iterator[Table]:
    """A table for each page, in order, with its path; pages of up to PAIRS pairs are settled together."""
    i = 0
    while i < len(pages):
        upto, pairs = i, 0
        while upto < len(pages) and (upto == i or pairs + len(pages[upto][0]) * len(pages[upto][1]) <= PAIRS):
            pairs += len(pages[upto][0]) * len(pages[upto][1])
            upto += 1
        group = [Table(*page) for page in pages[i:upto]]
        settle(group)
        yield from group
        i = upto


PARTNERS = "page_id long, pred_idx int, pred_text string, matched_gt string, matched_gt_idx int, path_cost int, edit_distance int"


def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of PARTNERS for each prediction of each page (page_id, p, g), with what other columns the page has."""
    for batch in batches:
        pages = list(zip(*(batch.column(c).to_pylist() for c in ("p", "g")), strict=True))
        more = {c: batch.column(c) for c in batch.schema.names if c not in ("page_id", "p", "g")}
        for k, (page, (p, g), table) in enumerate(zip(batch.column("page_id").to_pylist(), pages, _tables(pages), strict=True)):
            cost, match = table.best()
            found = [g[j] if j >= 0 else "" for j in match.tolist()]
            n = len(p)
            cols = [pa.array([page] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(p, pa.string()), pa.array(found, pa.string()), pa.array(match, pa.int32()), pa.array([cost] * n, pa.int32()), pa.array(table.distances(), pa.int32())]
            cols += [pa.repeat(x[k], n) for x in more.values()]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "pred_idx", "pred_text", "matched_gt", "matched_gt_idx", "path_cost", "edit_distance", *more])
