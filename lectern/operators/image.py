"""Page images as rows of grey bytes: binarising, ink profiles and column extents, a page per task row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import signal


#: Pages that are handed on at a time.
DRAWN = 256


def threshold(grey: np.ndarray) -> int:
    """Otsu's level: the one that parts the histogram with the largest variance between its sides."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 127


def median3(grey: np.ndarray) -> np.ndarray:
    """Median of each pixel's 3 x 3 neighbourhood, edges repeated."""
    p = np.pad(grey, 1, mode="edge")
    a, b, c = p[:-2], p[1:-1], p[2:]
    low, high = np.minimum(a, b), np.maximum(a, b)
    columns = np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)  # each column's three in order
    low, middle, high = ((x[:, :-2], x[:, 1:-1], x[:, 2:]) for x in columns)
    least, most = np.maximum(np.maximum(low[0], low[1]), low[2]), np.minimum(np.minimum(high[0], high[1]), high[2])
    return _middle(least, _middle(*middle), most)


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def binarised(grey: np.ndarray) -> np.ndarray:
    """255 where there is ink."""
    g = median3(grey)
    return np.where(g > threshold(g), 0, 255).astype(np.uint8)


def profiles(pages: DataFrame) -> DataFrame:
    """(page_id, y, ink) of pages (page_id, height, width, grey): the sums of the binarised rows."""

    def run(batches):
        for df in batches:
            for r in df.itertuples():
                ink = binarised(np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width)).sum(1, dtype=np.int64)
                yield pd.DataFrame({"page_id": r.page_id, "y": np.arange(r.height), "ink": ink.astype(float)})

    return pages.mapInPandas(run, "page_id long, y int, ink double")


def components(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Height and area of each group of ink that touches by side or corner.

    Runs of a row are joined with those of the row before that overlap them or lie one column off, by hooking and jumping
    over all runs at once.
    """
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = ink.shape[1] + 2
    low = np.searchsorted(row * wide + end, (row - 1) * wide + start)
    high = np.searchsorted(row * wide + start, (row - 1) * wide + end, "right")
    n = np.maximum(high - low, 0)
    x = np.repeat(np.arange(len(row)), n)
    y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(up := root[root], root):
            root = up
    _, of = np.unique(root, return_inverse=True)
    area = np.bincount(of, end - start).astype(np.int64)
    top, bottom = np.full(len(area), ink.shape[0]), np.full(len(area), -1)
    np.minimum.at(top, of, row)
    np.maximum.at(bottom, of, row)
    return bottom - top + 1, area


def component_table(pages: DataFrame) -> DataFrame:
    """(page_id, page_height, height, area) of the components of pages (page_id, height, width, grey)."""

    def run(batches):
        for df in batches:
            for r in df.itertuples():
                height, area = components(binarised(np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width)) > 0)
                yield pd.DataFrame({"page_id": r.page_id, "page_height": r.height, "height": height, "area": area})

    return pages.mapInPandas(run, "page_id long, page_height int, height int, area long")


BOX = "page_id long, line_index int, x1 int, y1 int, x2 int, y2 int, area long, page_height int, page_width int, period int, confidence double, method string"


def boxes(pages: DataFrame) -> DataFrame:
    """Boxes of text lines, a page a row: segments of its ink profile, each as wide as the ink between its rows."""

    def run(batches):
        for df in batches:
            out = []
            for r in df.itertuples():
                ink = binarised(np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width))

                def likely(ink=ink, page=r.height):
                    height, area = components(ink > 0)
                    return height[(area > 10) & (height > 3) & (height < 0.8 * page)]

                found, period, sure, method = signal.segments(ink.sum(1, dtype=np.int64).astype(float), likely)
                for i, (y1, y2) in enumerate(found):
                    x = np.flatnonzero(ink[y1 : y2 + 1].any(0))
                    x1, x2 = (int(x[0]), int(x[-1])) if len(x) else (0, r.width)
                    out.append((r.page_id, i, x1, y1, x2, y2, (x2 - x1) * (y2 - y1), r.height, r.width, period, sure, method))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BOX.split(", ")])

    return pages.mapInPandas(run, BOX)


def text_lines(pages: DataFrame) -> DataFrame:
    """The boxes with their padded form, noise left out by each page's median area; pages are read once, and only boxes are shuffled."""
    line_h = F.greatest(F.lit(4), (F.col("period") * signal.RATIO).cast("int"))
    pad_v, pad_h = F.greatest(F.lit(2), (line_h * 0.15).cast("int")), F.greatest(F.lit(2), (F.col("page_width") * 0.05).cast("int"))
    median = F.percentile("area", F.lit(0.5)).over(Window.partitionBy("page_id"))
    kept = boxes(pages).where("page_id is not null").withColumn("__m", median).where(F.col("area") >= F.col("__m") * signal.NOISE).drop("__m")
    return kept.withColumn("padded", signal.padded(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), pad_h, pad_v, F.col("page_width"), F.col("page_height")))


def drawn(texts: DataFrame, page: str, lines: str, cell: tuple[int, int] = (6, 4), gap: int = 4) -> DataFrame:
    """Pages (page_id, height, width, grey) that show arrays of lines: a block of ink for each letter, a gap below each line.

    A letter's code gives how high its block is; a page without lines is one white row.
    """
    high, wide = cell

    def run(batches):
        for df in (df[i : i + DRAWN] for df in batches for i in range(0, len(df), DRAWN)):
            out = []
            for page_id, rows in zip(df.page_id, df.lines, strict=True):
                rows = [] if rows is None else list(rows)
                width = max([len(x) for x in rows] + [1]) * wide
                grey = np.full((max(1, len(rows) * (high + gap)), width), 255, np.uint8)
                for i, x in enumerate(rows):
                    code = np.frombuffer(x.encode("utf-32-le"), np.uint32)
                    tall = np.where(code == 32, 0, high - code % 3)
                    block = np.arange(high)[:, None] >= high - tall[None, :]
                    grey[i * (high + gap) : i * (high + gap) + high, : len(code) * wide] = np.where(np.repeat(block, wide, 1), 0, 255)
                out.append((page_id, grey.shape[0], grey.shape[1], grey.tobytes()))
            yield pd.DataFrame(out, columns=["page_id", "height", "width", "grey"])

    return texts.select(F.col(page).alias("page_id"), F.col(lines).alias("lines")).mapInPandas(run, "page_id long, height int, width int, grey binary")
