"""Page images made ready for recognition: straightened, their contrast levelled, what shines through taken off.

Pages are rows (page_id, height, width, grey); a page is one row's work, nothing is grouped or shuffled, and other columns stay.
A page whose bytes are null, or that has no pixel, comes back as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Angles of lines that count, in degrees, and the step between them; the least gradient, votes and skew that do.
WIDEST, STEP, GRADIENT, VOTES, SKEWED = 45.0, 0.25, 150, 100, 0.5
#: Tiles a side, and how many times its share of a tile a level may hold.
TILES, CLIP = 8, 2.0
#: Side of the square that the paper's own level is taken from.
SQUARE = 25


def edges(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) where the brightness changes by GRADIENT and more, at the steepest place across the change."""
    g = np.pad(grey.astype(np.int32), 1, mode="edge")
    col, row = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dx, dy = np.abs(col[:, 2:] - col[:, :-2]), np.abs(row[2:] - row[:-2])
    size = dx + dy
    p = np.pad(size, 1)
    up = (dy >= dx) & (size > p[:-2, 1:-1]) & (size >= p[2:, 1:-1])
    side = (dx > dy) & (size > p[1:-1, :-2]) & (size >= p[1:-1, 2:])
    return np.nonzero((size >= GRADIENT) & (up | side))


def lines(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles and votes of the straight lines: cells of (angle, distance) that no near one outvotes, with enough votes."""
    y, x = edges(grey)
    if len(y) < VOTES:
        return np.zeros(0), np.zeros(0, np.int64)
    angles = np.arange(-WIDEST + STEP, WIDEST, STEP)
    reach = int(np.hypot(*grey.shape)) + 2
    votes = np.zeros((len(angles), 2 * reach), np.int32)
    for i, a in enumerate(np.deg2rad(angles)):
        votes[i] = np.bincount(np.rint(y * np.cos(a) - x * np.sin(a)).astype(np.int64) + reach, minlength=2 * reach)[: 2 * reach]
    best = extreme(extreme(votes, 9, 0, np.maximum), 9, 1, np.maximum)
    i, j = np.nonzero((votes == best) & (votes >= max(VOTES, votes.max() // 2)))
    return angles[i], votes[i, j].astype(np.int64)


def middle(angles: Column) -> Column:
    """The median of an array, of the two middle ones their mean; null for an empty one."""
    s, n = F.array_sort(angles), F.size(angles)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def turned(grey: np.ndarray, angle: float) -> np.ndarray:
    """The page turned about its middle so that lines of this angle lie flat: cubic between pixels, edges repeated."""
    h, w = grey.shape
    a = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y -= h // 2
    x -= w // 2
    fy, fx = y * np.cos(a) + x * np.sin(a) + h // 2, x * np.cos(a) - y * np.sin(a) + w // 2
    y0, x0 = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)

    def weight(d: np.ndarray) -> np.ndarray:
        d, k = np.abs(d), -0.75
        return np.where(d <= 1, (k + 2) * d**3 - (k + 3) * d**2 + 1, np.where(d < 2, k * (d**3 - 5 * d**2 + 8 * d - 4), 0.0))

    out = np.zeros((h, w))
    for i in range(-1, 3):
        rows, wy = np.clip(y0 + i, 0, h - 1), weight(fy - y0 - i)
        for j in range(-1, 3):
            out += wy * weight(fx - x0 - j) * grey[rows, np.clip(x0 + j, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def levelled(grey: np.ndarray, tiles: int = TILES, clip: float = CLIP) -> np.ndarray:
    """Contrast by tiles: each has a map from its clipped histogram, and a pixel takes from the four maps around it.

    What is clipped is dealt out evenly over all levels, the rest at even steps.
    """
    h, w = grey.shape
    full = np.pad(grey, ((0, -h % tiles), (0, -w % tiles)), mode="reflect")
    th, tw = full.shape[0] // tiles, full.shape[1] // tiles
    area = th * tw
    most = max(1, int(clip * area / 256))
    cut = full.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, area).astype(np.int64)
    n = np.bincount((cut + 256 * np.arange(tiles * tiles)[:, None]).ravel(), minlength=256 * tiles * tiles).reshape(-1, 256)
    over = np.maximum(n - most, 0).sum(1)
    n = np.minimum(n, most) + (over // 256)[:, None]
    rest = (over % 256)[:, None]
    step, level = np.maximum(256 // np.maximum(rest, 1), 1), np.arange(256)[None, :]
    n += (level % step == 0) & (level // step < rest)
    maps = np.clip(np.rint(np.cumsum(n, 1) * (255 / area)), 0, 255).reshape(tiles, tiles, 256)

    def around(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / tile - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (ya, yb, fy), (xa, xb, fx) = around(h, th), around(w, tw)
    fy = fy[:, None]
    near = lambda r, c: maps[r[:, None], c[None, :], grey]
    out = (near(ya, xa) * (1 - fx) + near(ya, xb) * fx) * (1 - fy) + (near(yb, xa) * (1 - fx) + near(yb, xb) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def extreme(x: np.ndarray, size: int, axis: int, take: np.ufunc) -> np.ndarray:
    """Running extremes over an odd number of cells, fewer at the ends.

    Each window is the end of one stretch of `size` cells and the begin of the next, so two passes tell all windows.
    """
    x = np.moveaxis(x, axis, -1)
    n, half = x.shape[-1], size // 2
    none = (np.iinfo(x.dtype).min if take is np.maximum else np.iinfo(x.dtype).max) if x.dtype.kind in "iu" else (-np.inf if take is np.maximum else np.inf)
    p = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half + -(n + 2 * half) % size)], constant_values=none)
    p = p.reshape(*x.shape[:-1], -1, size)
    begin = take.accumulate(p, -1).reshape(*x.shape[:-1], -1)
    end = take.accumulate(p[..., ::-1], -1)[..., ::-1].reshape(*x.shape[:-1], -1)
    return np.moveaxis(take(end[..., :n], begin[..., size - 1 : size - 1 + n]), -1, axis)


def background(grey: np.ndarray, size: int = SQUARE) -> np.ndarray:
    """The paper's level: the darkest of the brightest around each pixel."""
    for take in (np.maximum, np.minimum):
        grey = extreme(extreme(grey, size, 1, take), size, 0, take)
    return grey


def cleaned(grey: np.ndarray, size: int = SQUARE) -> np.ndarray:
    """White but for how much darker than the paper around it a pixel is."""
    return 255 - (background(grey, size) - grey)


def _each(pages: DataFrame, change: Callable, out: S.DataType, column: str, *given: str) -> DataFrame:
    """pages with `column` from change(page's pixels, given columns), computed in the task that holds the row."""

    def run(batches):
        for df in batches:
            found = []
            for grey, h, w, *more in df[["grey", "height", "width", *given]].itertuples(index=False):
                if grey is None or not len(grey):
                    found.append(grey if column == "grey" else None)
                else:
                    found.append(change(np.frombuffer(grey, np.uint8).reshape(int(h), int(w)), grey, *more))
            df[column] = found
            yield df

    fields = [S.StructField(column, out) if f.name == column else f for f in pages.schema.fields]
    if column not in pages.columns:
        fields.append(S.StructField(column, out))
    return pages.mapInPandas(run, S.StructType(fields))


def skews(pages: DataFrame) -> DataFrame:
    """pages with `skew`: the median angle of the page's lines in degrees, null where it has none."""
    found = _each(pages, lambda p, _: lines(p)[0].tolist(), S.ArrayType(S.DoubleType()), "skew")
    return found.withColumn("skew", middle(F.col("skew")))


def straightened(pages: DataFrame) -> DataFrame:
    """Pages turned by their `skew` (see `skews`) where that is SKEWED degrees and more; others keep their bytes."""

    def change(page: np.ndarray, raw: bytes, skew: float) -> bytes:
        return raw if skew is None or np.isnan(skew) or abs(skew) < SKEWED else turned(page, skew).tobytes()

    return _each(skews(pages), change, S.BinaryType(), "grey", "skew")


def contrasted(pages: DataFrame) -> DataFrame:
    return _each(pages, lambda p, _: levelled(p).tobytes(), S.BinaryType(), "grey")


def unbled(pages: DataFrame) -> DataFrame:
    return _each(pages, lambda p, _: cleaned(p).tobytes(), S.BinaryType(), "grey")


def prepared(pages: DataFrame) -> DataFrame:
    """All three, in their order; the skew that was found stays as a column."""
    return unbled(contrasted(straightened(pages)))
