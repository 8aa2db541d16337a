"""One-dimensional signals as rows (page, y, ink): smoothing, islands, autocorrelation, peaks, line segments and boxes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOISE = 0.20
RATIO = 0.75
#: Places of a cell in which segments are counted together.
WIDE = 1 << 16
#: The longest signal whose lagged sums are taken one by one.
DIRECT = 4096


def moving_average(rows: DataFrame, page: str, at: str, value: str, width: int) -> DataFrame:
    """Centred mean with zeros beyond the ends: always divided by the width."""
    w = Window.partitionBy(page).orderBy(at).rowsBetween(-(width // 2), (width - 1) // 2)
    return rows.withColumn("smooth", F.sum(value).over(w) / width)


def islands(rows: DataFrame, page: str, at: str, high: str, gap: int) -> DataFrame:
    """Runs of high rows; a run of `gap` low rows ends one, and an island open at the end takes in the last row."""
    last = rows.groupBy(page).agg(F.max(at).alias("__end"))
    w = Window.partitionBy(page).orderBy(at)
    tops = rows.where(high).withColumn("__new", F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1))
    tops = tops.withColumn("island", F.sum("__new").over(w))
    found = tops.groupBy(page, "island").agg(F.min(at).alias("start"), F.max(at).alias("stop"))
    return found.join(last, page).select(page, "island", "start", F.when(F.col("__end") - F.col("stop") < gap, F.col("__end")).otherwise(F.col("stop")).alias("stop"))


def autocorrelation(rows: DataFrame, page: str, at: str, value: str, most: int) -> DataFrame:
    """(page, lag, acf) for lags 0..most about the mean, by lag 0; pages under 20 rows or without variation give none.

    A lag is a shift of the same sorted page, so each page is shuffled once.
    """
    whole = Window.partitionBy(page)
    r = rows.withColumns({"__n": F.count("*").over(whole), "__m": F.avg(value).over(whole), "__s": F.stddev_pop(value).over(whole)}).where("__n >= 20 and __s >= 1e-6")
    r = r.withColumn("__d", F.col(value) - F.col("__m"))
    w = Window.partitionBy(page).orderBy(at)
    lags = r.select(page, *[(F.col("__d") * F.lead("__d", k).over(w)).alias(f"__{k}") for k in range(most + 1)])
    sums = lags.groupBy(page).agg(*[F.coalesce(F.sum(f"__{k}"), F.lit(0.0)).alias(f"__{k}") for k in range(most + 1)])
    return sums.select(page, F.posexplode(F.array(*[F.col(f"__{k}") / F.col("__0") for k in range(most + 1)])).alias("lag", "acf"))


def levels(rows: DataFrame, page: str, value: str) -> DataFrame:
    """(page, p10, p20, p75): exact percentiles, interpolated."""
    p = F.percentile(value, F.array(F.lit(0.10), F.lit(0.20), F.lit(0.75)))
    return rows.groupBy(page).agg(p.alias("p")).select(page, *[F.col("p")[i].alias(k) for i, k in enumerate(("p10", "p20", "p75"))])


def between_cuts(rows: DataFrame, page: str, at: str, value: str, cut: str, least: int) -> DataFrame:
    """(page, y1, y2) of the stretches between rows where `cut` holds, of `least` rows and more, that hold any value above 0."""
    w = Window.partitionBy(page).orderBy(at)
    r = rows.withColumn("__cut", F.expr(cut)).withColumn("__part", F.count_if("__cut").over(w)).where("not __cut")
    found = r.groupBy(page, "__part").agg(F.min(at).alias("y1"), F.max(at).alias("y2"), F.max(value).alias("__top"))
    return found.where((F.col("y2") - F.col("y1") + 1 >= least) & (F.col("__top") > 0)).select(page, "y1", "y2")


def lowest(x: np.ndarray) -> np.ndarray:
    """The lowest value from each place back to the last higher value, or to the begin; each value is taken up and put off once."""
    out, open_ = np.zeros(len(x)), []
    for i, v in enumerate(x.tolist()):
        low = v
        while open_ and open_[-1][0] <= v:
            low = min(low, open_.pop()[1])
        open_.append((v, low))
        out[i] = low
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far each peak stands above the higher of the lowest points towards the next higher value on either side."""
    return x[peaks] - np.maximum(lowest(x), lowest(x[::-1])[::-1])[peaks]


def peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Local maxima (the middle of flat ones) by height, then distance, the tallest first, then prominence."""
    x = np.asarray(x, float)
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    p = np.array(found, int)
    if height is not None:
        p = p[x[p] >= height]
    if distance > 1 and len(p):
        keep = np.ones(len(p), bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                keep[np.searchsorted(p, p[k] - distance, "right") : np.searchsorted(p, p[k] + distance)] = False
                keep[k] = True
        p = p[keep]
    if prominence is not None and len(p):
        p = p[prominences(x, p) >= prominence]
    return p


def absorbed(segments: list[tuple[int, int]], line: int, least: float = 0.6) -> list[tuple[int, int]]:
    """Segments with those lower than least * line joined to the one before, or, at the top, to the one after.

    A single segment stays whatever its height; where all of several together stay too low, none is left.
    """
    if len(segments) < 2:
        return list(segments)
    out: list[tuple[int, int]] = []
    top: int | None = None
    for start, stop in segments:
        start, top = (start if top is None else top), None
        if stop - start + 1 >= least * line:
            out.append((start, stop))
        elif out:
            out[-1] = (out[-1][0], stop)
        else:
            top = start
    return out


def absorb(rows: DataFrame, page: str, start: str, stop: str, line: str, least: float = 0.6) -> DataFrame:
    """`absorbed` over rows: (page, start, stop), `line` being the height that a page's segments should have.

    The first group goes from the page's first segment to the first place where it is high enough; from there on a high
    segment opens a group and the low ones behind it join it.  Groups are counted by cells of WIDE places and the cells' sums,
    so a page's segments need not fit a task.  Segments don't overlap, and a page has one height.  A null page is a page.
    """
    r = rows.select(F.col(page).alias("p"), F.col(start).alias("a"), F.col(stop).alias("b"), (least * F.col(line)).alias("need"), F.floor(F.col(start) / F.lit(WIDE)).alias("cell"))
    upto, whole = Window.partitionBy("p").orderBy("cell"), Window.partitionBy("p")

    def beside(r: DataFrame, sums: list, pages: dict) -> DataFrame:
        """Rows with what a window over their page's cells says."""
        cells = r.groupBy("p", "cell").agg(*sums).withColumns(pages).select(F.col("p").alias("p_"), F.col("cell").alias("cell_"), *pages)
        return r.join(cells, F.col("p").eqNullSafe(F.col("p_")) & (F.col("cell") == F.col("cell_"))).drop("p_", "cell_")

    r = beside(r, [F.min("a").alias("a0"), F.count("*").alias("k")], {"first": F.min("a0").over(whole), "all": F.sum("k").over(whole)})
    r = r.withColumn("enough", F.when(F.col("b") - F.col("first") + 1 >= F.col("need"), F.col("b")))
    r = beside(r, [F.min("enough").alias("b0")], {"opened": F.min("b0").over(whole)}).where("opened is not null or all = 1")
    r = r.withColumn("high", (F.col("b") == F.col("opened")) | ((F.col("b") > F.col("opened")) & (F.col("b") - F.col("a") + 1 >= F.col("need"))))
    r = beside(r, [F.count_if("high").alias("h")], {"before": F.sum("h").over(upto) - F.col("h")})
    group = F.count_if("high").over(Window.partitionBy("p", "cell").orderBy("a")) + F.col("before")
    r = r.withColumn("g", F.greatest(group, F.lit(1)))
    return r.groupBy("p", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(F.col("p").alias(page), F.col("a").alias(start), F.col("b").alias(stop))


def lagged(d: np.ndarray) -> np.ndarray:
    """Sums of products at each lag; of a long signal by transforms, to 12 digits of the first so that ties stay ties."""
    n = len(d)
    if n <= DIRECT:
        return np.correlate(d, d, "full")[n - 1 :]
    size = 1 << (2 * n - 1).bit_length()
    out = np.fft.irfft(np.abs(np.fft.rfft(d, size)) ** 2, size)[:n]
    return np.round(out / out[0], 12) * out[0]


def period(ink: np.ndarray, heights: np.ndarray | Callable[[], np.ndarray] | None = None) -> tuple[int, float, str]:
    """Line period, confidence and method; heights may be a function, which is called only if they are needed.

    The most prominent peak of the autocorrelation if it is sure enough, else 1.5 times the upper quartile of the heights of
    `plausible_components`, if there are three, else a fraction of the page.
    """
    n = len(ink)
    if n >= 20 and ink.std() >= 1e-6:
        d = ink - ink.mean()
        acf = lagged(d)
        acf = acf / acf[0]
        part = acf[4 : max(6, n // 3)]
        p = peaks(part, height=0.05, prominence=0.03)
        if len(p):
            best = p[prominences(part, p).argmax()]
            if part[best] >= 0.10:
                return int(best) + 4, float(part[best]), "autocorrelation"
    heights = heights() if callable(heights) else heights
    if heights is not None and len(heights) >= 3:
        return max(8, int(np.percentile(heights, 75) * 1.5)), 0.0, "cc_height"
    return max(8, n // 50), 0.0, "heuristic"


def smoothed(ink: np.ndarray, width: int) -> np.ndarray:
    """Centred mean with zeros beyond the ends, over the whole signal at most."""
    width = min(width, len(ink))
    return np.convolve(ink, np.ones(width) / width, "same")


def by_level(ink: np.ndarray, line: int) -> list[tuple[int, int]]:
    """Runs of rows whose smoothed ink is at least half the lower fifth of what is above zero; short gaps don't end one."""
    smooth = smoothed(ink, max(3, line // 2))
    above = smooth[smooth > 0]
    level = np.percentile(above, 20) * 0.5 if len(above) else 1.0
    gap, found, start, low = max(2, line // 5), [], None, 0
    for y, high in enumerate((smooth >= level).tolist()):
        if high:
            start, low = (y if start is None else start), 0
        elif start is not None:
            low += 1
            if low >= gap:
                found.append((start, y - low))
                start = None
    if start is not None:
        found.append((start, len(ink) - 1))
    return found


SEGMENT = "page_id long, line_index int, y1 int, y2 int, period int, confidence double, method string"


def segments(ink: np.ndarray, heights: np.ndarray | Callable[[], np.ndarray] | None = None) -> tuple[list[tuple[int, int]], int, float, str]:
    """Begin and end of each text line of one profile, cut at the valleys of the smoothed one; period, confidence, method.

    A profile without ink has none.
    """
    p, sure, method = period(ink, heights)
    line = max(4, int(RATIO * p))
    smooth = smoothed(ink, max(3, line // 3))
    active = smooth[smooth > np.percentile(smooth, 10)]
    depth = 0.06 * (float(np.median(active)) if len(active) else 1.0)
    cuts = [-1, *peaks(-smooth, distance=max(4, p // 2), prominence=depth).tolist(), len(ink)]
    found = [(a + 1, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if b - a - 1 >= max(4, line // 4) and ink[a + 1 : b].max() > 0]
    if len(found) <= 1 and (ink > 0).any():
        method += "+fallback"
        found = by_level(ink, line)
    return absorbed(found, line), p, sure, method


def _rows(page, ink: np.ndarray) -> pd.DataFrame:
    found, p, sure, method = segments(ink)
    return pd.DataFrame({"page_id": page, "line_index": range(len(found)), "y1": [a for a, _ in found], "y2": [b for _, b in found], "period": p, "confidence": sure, "method": method})


def line_segments(profile: DataFrame) -> DataFrame:
    """Text lines of each page of (page_id, y, ink).

    A page is one group and must fit a task, as an image's rows do; the work grows as n log n.  Keys whose rows nothing
    bounds don't belong here.
    """
    return profile.groupBy("page_id").applyInPandas(lambda df: _rows(df.page_id.iloc[0], df.sort_values("y").ink.to_numpy(float)), SEGMENT)


def line_segments_of_rows(pages: DataFrame) -> DataFrame:
    """Text lines of pages (page_id, ink array<double>), a page a row: nothing is grouped or shuffled.

    A page whose array is null or empty has none; rows that repeat a page_id are pages of their own.
    """

    def run(batches):
        for df in batches:
            for page, ink in zip(df.page_id, df.ink, strict=True):
                if ink is not None and len(ink):
                    yield _rows(page, np.asarray(ink, float))

    return pages.select("page_id", "ink").mapInPandas(run, SEGMENT)


def plausible(boxes: DataFrame, page: str, area: str) -> DataFrame:
    """Boxes of at least a fifth of their page's median area; the median interpolates."""
    m = boxes.groupBy(page).agg(F.percentile(area, F.lit(0.5)).alias("__m"))
    return boxes.join(m, page).where(F.col(area) >= F.col("__m") * NOISE).drop("__m")


def plausible_components(components: DataFrame, page: str, page_height: str) -> DataFrame:
    """Components (height, area) that may be letters."""
    return components.where((F.col("area") > 10) & (F.col("height") > 3) & (F.col("height") < 0.8 * F.col(page_height)))


def component_periods(components: DataFrame, page: str, page_height: str) -> DataFrame:
    """(page, period): the upper quartile of plausible heights, by half more, at least 8; pages with three and more of them."""
    upper = F.percentile("height", F.lit(0.75))
    found = plausible_components(components, page, page_height).groupBy(page).agg(F.count("*").alias("n"), upper.alias("h"))
    return found.where("n >= 3").select(page, F.greatest(F.lit(8), F.floor(F.col("h") * 1.5).cast("int")).alias("period"))


def padded(x1, y1, x2, y2, pad_h, pad_v, width, height):
    """A box grown by its pads, within the image."""
    return F.struct(F.greatest(x1 - pad_h, F.lit(0)).alias("x1"), F.greatest(y1 - pad_v, F.lit(0)).alias("y1"), F.least(x2 + pad_h, width).alias("x2"), F.least(y2 + pad_v, height).alias("y2"))
