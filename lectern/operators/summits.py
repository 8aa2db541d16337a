"""Peaks of signals of any length, by blocks: no page has to fit a task.

A block of a signal is told in one row: its runs of equal values that may be peaks, its extremes, and the values that are
records seen from either end.  What a block can't tell of a peak, how low the signal falls before it next gets higher, is
asked from the extremes of the page's other blocks and then from the one block that holds the higher value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import package, shared
from .signal import lowest

#: Rows of a block at least, blocks of a page at most, and open sides that one task looks up.
WIDTH, BLOCKS, SIDES = 1 << 14, 1 << 20, 1 << 20

RUN = "start bigint, stop bigint, value double, before double, after double, left double, left_open boolean, right double, right_open boolean"
RECORDS = "array<struct<value double, low double>>"
BLOCK = f"page {{page}}, block bigint, n bigint, top double, low double, inner_ array<struct<{RUN}>>, edges array<struct<{RUN}>>, tails {RECORDS}, heads {RECORDS}"


def records(v: np.ndarray) -> list[tuple[float, float]]:
    """Values that are higher than all after them, the lowest first, each with the lowest value after it (infinite at the end)."""
    back = v[::-1]
    top, low = np.maximum.accumulate(back), np.minimum.accumulate(back)
    at = np.flatnonzero(np.r_[True, top[1:] > top[:-1]])
    return list(zip(back[at].tolist(), np.r_[np.inf, low][at].tolist(), strict=True))


def told(x: np.ndarray, height: float | None) -> tuple[list, list, list, list]:
    """Inner peaks, edge runs and the records of both ends of a block's values."""
    start = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1]
    stop, v = np.r_[start[1:], len(x)] - 1, x[start]
    m = len(v)
    left, right = lowest(v), lowest(v[::-1])[::-1]
    left_open, right_open = v >= np.maximum.accumulate(v), v >= np.maximum.accumulate(v[::-1])[::-1]
    before, after = np.r_[np.nan, v[:-1]], np.r_[v[1:], np.nan]

    def run(i: int) -> tuple:
        edge = lambda y: None if np.isnan(y) else float(y)
        return (int(start[i]), int(stop[i]), float(v[i]), edge(before[i]), edge(after[i]), float(left[i]), bool(left_open[i]), float(right[i]), bool(right_open[i]))

    high = np.ones(m, bool) if height is None else v >= height
    inner = np.flatnonzero(high & (before < v) & (after < v))
    return [run(i) for i in inner], [run(i) for i in sorted({0, m - 1})], records(v), records(v[::-1])


def blocks(rows: DataFrame, page: str, at: str, value: str, width: int, height: float | None) -> DataFrame:
    """One row a block of `width` positions, told as above; runs are numbered from the block's begin."""
    kind = rows.schema[page].dataType.simpleString()

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values("at")["value"].to_numpy(float)
        inner, edges, tails, heads = told(x, height)
        return pd.DataFrame([(key[0], key[1], len(x), x.max(), x.min(), inner, edges, tails, heads)], columns=["page", "block", "n", "top", "low", "inner_", "edges", "tails", "heads"])

    r = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(at).isNotNull())
    r = r.select(F.col(page).alias("page"), F.col(at).cast("bigint").alias("at"), F.col(value).cast("double").alias("value"))
    r = r.withColumn("block", F.floor(F.col("at") / F.lit(width)))
    return r.groupBy("page", "block").applyInPandas(run, BLOCK.format(page=kind))


def numbered(told_: DataFrame) -> DataFrame:
    """Blocks with their number in the page and that of their first row; the window reads narrow rows, one a block."""
    w = Window.partitionBy("page").orderBy("block")
    return told_.select("page", "block", (F.row_number().over(w) - 1).alias("seq"), (F.sum("n").over(w) - F.col("n")).alias("base"))


def candidates(told_: DataFrame, height: float | None) -> DataFrame:
    """Local maxima: those inside blocks, and runs that reach a block's end, put together with what they go on as."""
    place = ["page", "first", "last", "start", "stop", "value", "before", "after", "left", "left_open", "right", "right_open"]

    def runs(name: str) -> DataFrame:
        r = told_.select("page", "seq", "base", F.explode(name).alias("r")).select("page", "seq", "base", "r.*")
        return r.withColumns({"start": F.col("start") + F.col("base"), "stop": F.col("stop") + F.col("base"), "first": F.col("seq"), "last": F.col("seq")})

    # the edges of a block are in `edges` alone: an inner peak has a run on either side within its block
    w = Window.partitionBy("page").orderBy("start")
    e = runs("edges").withColumn("new", F.when((F.lag("value").over(w) == F.col("value")) & (F.lag("seq").over(w) != F.col("seq")), 0).otherwise(1))
    e = e.withColumn("g", F.sum("new").over(w))
    at_start = lambda c: F.min_by(c, "start").alias(c)
    at_stop = lambda c: F.max_by(c, "start").alias(c)
    e = e.groupBy("page", "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("value").alias("value"), *map(at_start, ("before", "left", "left_open")), *map(at_stop, ("after", "right", "right_open")))
    v = Window.partitionBy("page").orderBy("g")
    e = e.withColumns({"before": F.coalesce("before", F.lag("value").over(v)), "after": F.coalesce("after", F.lead("value").over(v))})
    e = e.where("before < value and after < value")
    found = runs("inner_").select(place).unionByName(e.select(place))
    if height is not None:
        found = found.where(F.col("value") >= height)
    return found.withColumn("pos", F.floor((F.col("start") + F.col("stop")) / 2)).drop("before", "after", "start", "stop")


def decided(pos: np.ndarray, value: np.ndarray, status: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """Status (0 open, 1 kept, 2 dropped) after what can be said here: a peak with none taller that is open near it is kept,
    one near a kept one is dropped.  Arrays are in the order of places; of equal heights the later one is the taller."""
    status = status.copy()
    rank = np.empty(len(pos), np.int64)
    order = np.lexsort((pos, value))
    rank[order] = np.arange(len(pos))
    a, b = np.searchsorted(pos, pos - distance, "right"), np.searchsorted(pos, pos + distance)
    for i in order[::-1]:
        if own[i] and status[i] == 0:
            near = status[a[i] : b[i]]
            if (near == 1).any():
                status[i] = 2
            elif not ((near == 0) & (rank[a[i] : b[i]] > rank[i])).any():
                status[i] = 1
    return status


def spaced(found: DataFrame, distance: int, folder: str, width: int = WIDTH) -> DataFrame:
    """(page, pos) of peaks that stay when the tallest ones take away those less than `distance` rows off.

    Cells of places decide what they can, with a copy of what lies within `distance` of them, until nothing is open.  The
    tallest open peak is always decided, and a chain of ever taller ones is followed through a whole cell in a round.
    """
    width, kind = max(width, distance), found.schema["page"].dataType.simpleString()

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        df["now"] = decided(df.pos.to_numpy(), df.value.to_numpy(), df.status.to_numpy(), df.own.to_numpy(), distance)
        return df[df.own][["page", "pos", "value", "status", "now"]]

    cell, off = F.floor(F.col("pos") / F.lit(width)), F.pmod("pos", F.lit(width))
    live, kept, turn = found.select("page", "pos", "value", F.lit(0).cast("bigint").alias("status")), [], 0
    while True:
        to = F.array_compact(F.array(cell, F.when(off < distance, cell - 1), F.when(off >= width - distance, cell + 1)))
        r = live.withColumn("cell", F.explode(to)).withColumn("own", F.col("cell") == cell)
        r = r.groupBy("page", "cell").applyInPandas(run, f"page {kind}, pos bigint, value double, status bigint, now bigint")
        r = shared.saved(r, folder, f"turn{turn}")
        kept.append(r.where("status = 0 and now = 1").select("page", "pos"))
        if r.where("now = 0").isEmpty():
            break
        live = r.where((F.col("now") == 0) | ((F.col("now") == 1) & ((off < distance) | (off >= width - distance)))).select("page", "pos", "value", F.col("now").alias("status"))
        turn += 1
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def ahead(top: np.ndarray, low: np.ndarray, at: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (at, height), the last place before `at` with a top above the height, or -1, and the lowest low between.

    Places are looked up in a tree of pairwise extremes: up while a left neighbour is no higher, then down to the place.
    """
    tops, lows = [top], [low]
    while len(tops[-1]) > 1:
        odd = len(tops[-1]) & 1
        t, lo = np.pad(tops[-1], (0, odd), constant_values=-np.inf), np.pad(lows[-1], (0, odd), constant_values=np.inf)
        tops.append(np.maximum(t[::2], t[1::2]))
        lows.append(np.minimum(lo[::2], lo[1::2]))
    i, least = at.copy(), np.full(len(at), np.inf)
    node, level = np.full(len(at), -1), np.full(len(at), -1)
    for k in range(len(tops)):
        look = np.flatnonzero((level < 0) & (i & 1 == 1))
        n = i[look] - 1
        hit = tops[k][n] > height[look]
        node[look[hit]], level[look[hit]] = n[hit], k
        least[look[~hit]] = np.minimum(least[look[~hit]], lows[k][n[~hit]])
        i >>= 1
    for k in range(len(tops) - 1, 0, -1):
        look = np.flatnonzero(level == k)
        right = 2 * node[look] + 1
        inside = np.minimum(right, len(tops[k - 1]) - 1)
        has = (right == inside) & (tops[k - 1][inside] > height[look])
        passed = ~has & (right == inside)
        least[look[passed]] = np.minimum(least[look[passed]], lows[k - 1][inside[passed]])
        node[look], level[look] = np.where(has, right, 2 * node[look]), k - 1
    return node, least


def based(sides: DataFrame, told_: DataFrame, folder: str) -> DataFrame:
    """(page, pos, low) of each open side (page, pos, side, seq, value, low): the lowest value before the next higher one.

    A page's sides are dealt into shares of SIDES; each share goes to a task with the extremes of the page's blocks.  The
    blocks that hold the higher values are then joined from stored tables, so a block that many ask is split.
    """
    kind = told_.schema["page"].dataType.simpleString()
    per = sides.groupBy("page", "seq").agg(F.count("*").alias("k"))
    per = per.withColumn("share", F.floor((F.sum("k").over(Window.partitionBy("page").orderBy("seq")) - F.col("k")) / SIDES))
    dealt = sides.join(shared.saved(per, folder, "shares"), ["page", "seq"])
    many = per.groupBy("page").agg(F.max("share").alias("share"))
    known = told_.select("page", "seq", "top", "low").join(many, "page").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), "share")))

    def run(mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        all_ = all_.sort_values("seq")
        top, low, out = all_.top.to_numpy(), all_.low.to_numpy(), []
        for left in (True, False):
            m = mine[mine.side == ("left" if left else "right")]
            at = m.seq.to_numpy() if left else len(top) - 1 - m.seq.to_numpy()
            to, least = ahead(top if left else top[::-1], low if left else low[::-1], at.astype(np.int64), m.value.to_numpy())
            to = to if left else np.where(to < 0, -1, len(top) - 1 - to)
            out.append(pd.DataFrame({"page": m.page, "pos": m.pos, "side": m.side, "value": m.value, "low": np.minimum(m.low, least), "seq": to}))
        return pd.concat(out)

    schema = f"page {kind}, pos bigint, side string, value double, low double, seq bigint"
    asked = shared.saved(dealt.groupBy("page", "share").cogroup(known.groupBy("page", "share")).applyInPandas(run, schema), folder, "asked")
    ends = told_.select("page", F.col("seq").cast("bigint").alias("seq"), "tails", "heads")
    met = asked.where("seq >= 0").join(ends, ["page", "seq"])
    seen = F.when(F.col("side") == "left", F.col("tails")).otherwise(F.col("heads"))
    last = F.element_at(F.filter(seen, lambda r: r["value"] > F.col("value")), 1)["low"]
    met = met.select("page", "pos", F.least("low", last).alias("low"))
    return met.unionByName(asked.where("seq < 0").select("page", "pos", "low"))


def peaks(rows: DataFrame, page: str, at: str, value: str, height: float | None = None, distance: int = 1, prominence: float | None = None, width: int | None = None) -> DataFrame:
    """(page, pos, value, prominence) of local maxima by height, then distance, the tallest first, then prominence.

    `at` is an integer, distinct within a page; `pos` counts a page's rows from 0 in its order.  Of a flat top the middle row
    counts.  Rows without a place or a value (null, NaN) are left out; a null page is a page; a page of under three rows, or
    of one value, has no peak; an empty table gives an empty one; other columns don't matter, whatever their names.
    """
    spark = rows.sparkSession
    package.send(spark)
    rows = rows.select(page, at, value)
    if width is None:
        ends = rows.agg(F.max(at).cast("bigint").alias("b"), F.min(at).cast("bigint").alias("a")).first()
        width = WIDTH if ends.a is None else max(WIDTH, -(-(ends.b - ends.a + 1) // BLOCKS))
    folder = shared.new_folder(spark, "peaks")
    # pages are told as JSON, so that a null page has a key that tables can be joined by
    kind = rows.schema[page].dataType
    keyed = rows.select(F.to_json(F.struct(F.col(page).alias("k"))).alias("page"), F.col(at).alias("at"), F.col(value).alias("value"))
    raw = shared.saved(blocks(keyed, "page", "at", "value", width, height), folder, "raw")
    told_ = shared.saved(raw.join(numbered(raw), ["page", "block"]), folder, "blocks")
    found = shared.saved(candidates(told_, height), folder, "candidates")
    if distance > 1:
        found = shared.saved(found.join(spaced(found, distance, folder, width), ["page", "pos"], "left_semi"), folder, "spaced")
    left = found.where("left_open").select("page", "pos", F.lit("left").alias("side"), F.col("first").alias("seq"), "value", F.col("left").alias("low"))
    right = found.where("right_open").select("page", "pos", F.lit("right").alias("side"), F.col("last").alias("seq"), "value", F.col("right").alias("low"))
    known = found.where("not left_open").select("page", "pos", F.col("left").alias("low")).unionByName(found.where("not right_open").select("page", "pos", F.col("right").alias("low")))
    sides = shared.saved(left.unionByName(right), folder, "sides")
    base = known.unionByName(based(sides, told_, folder)).groupBy("page", "pos").agg(F.max("low").alias("low"))
    out = found.join(base, ["page", "pos"]).withColumn("prominence", F.col("value") - F.col("low"))
    if prominence is not None:
        out = out.where(F.col("prominence") >= prominence)
    back = F.from_json("page", f"k {kind.simpleString()}")["k"]
    return out.select(back.alias("page"), "pos", "value", "prominence")
