"""Peaks and absorbed segments by blocks, against the plain readings of whole pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import signal, summits

STAIRS = [float(i // 2 + (3 if i % 2 else 0)) for i in range(300)]
SHAPES = {
    "noise": np.random.default_rng(7).normal(0, 5, 900).round(2).tolist(),
    "ties": np.random.default_rng(8).integers(0, 4, 900).astype(float).tolist(),
    "flat": [0.0] + [2.0] * 200 + [1.0] * 40 + [2.0] * 90 + [0.5],
    "rising": STAIRS,
    "falling": STAIRS[::-1],
    "one_tall": [float(i % 3) for i in range(150)] + [99.0] + [float(i % 5) for i in range(150)],
    "constant": [1.0] * 100,
    "two": [1.0, 2.0],
}


def expected(x, height, distance, prominence):
    x = np.array(x)
    p = signal.peaks(x, height, distance, prominence)
    return {(int(i), x[i], round(float(s), 9)) for i, s in zip(p, signal.prominences(x, p), strict=True)}


@pytest.mark.parametrize("height,distance,prominence,width", [(None, 1, None, 16), (1.0, 7, 0.5, 16), (None, 40, None, 32)])
def test_peaks_by_blocks_are_those_of_whole_pages(spark, height, distance, prominence, width):
    rows = [(name, 10 * i - 500, v) for name, x in SHAPES.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, t long, v double").repartition(5)
    got = summits.peaks(df, "name", "t", "v", height, distance, prominence, width).collect()
    assert len({(r.page, r.pos) for r in got}) == len(got)
    for name, x in SHAPES.items():
        assert {(r.pos, r.value, round(r.prominence, 9)) for r in got if r.page == name} == expected(x, height, distance, prominence), name


def test_odd_rows_of_signals(spark):
    rows = [(None, i, v, 1) for i, v in enumerate([0.0, 5.0, 1.0, None, float("nan"), 4.0, 0.0])] + [(None, None, 99.0, 1), (3, 0, 1.0, 1)]
    df = spark.createDataFrame(rows, "page long, at long, value double, pos int")
    got = sorted(tuple(r) for r in summits.peaks(df, "page", "at", "value").collect())
    assert got == [(None, 1, 5.0, 5.0), (None, 3, 4.0, 3.0)]
    assert summits.peaks(df.where("false"), "page", "at", "value", distance=3).collect() == []


def test_last_higher_block_is_found():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 33):
        top, low = rng.integers(0, 9, n).astype(float), rng.integers(-9, 0, n).astype(float)
        at, height = rng.integers(0, n, 200), rng.integers(0, 10, 200).astype(float)
        to, least = summits.ahead(top, low, at, height)
        for a, h, t, m in zip(at, height, to, least, strict=True):
            want = max([j for j in range(a) if top[j] > h], default=-1)
            assert (t, m) == (want, min(low[want + 1 : a], default=np.inf))


def test_absorbing_by_cells_is_the_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(signal, "WIDE", 64)
    rng, rows = np.random.default_rng(5), []
    for page in range(40):
        at = 0
        for _ in range(rng.integers(1, 30)):
            high = int(rng.integers(1, 6 if page % 8 == 0 else 14))
            rows.append((page if page else None, at, at + high - 1, 10))
            at += high + int(rng.integers(0, 5))
    got = signal.absorb(spark.createDataFrame(rows, "page int, a int, b int, line int"), "page", "a", "b", "line").collect()
    for page in {r[0] for r in rows}:
        want = signal.absorbed([(a, b) for p, a, b, _ in rows if p == page], 10)
        assert sorted((r.a, r.b) for r in got if r.page == page) == want
    assert signal.absorb(spark.createDataFrame([], "page int, a int, b int, line int"), "page", "a", "b", "line").count() == 0


def test_hot_block_is_not_a_hot_task(spark):
    """All open sides ask the one block with the highest value: the answer comes from a join of stored tables."""
    x = np.r_[[1000.0], np.random.default_rng(1).normal(0, 1, 4000).cumsum()]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "p int, t int, v double")
    got = summits.peaks(df, "p", "t", "v", width=64).withColumn("prominence", F.round("prominence", 6)).collect()
    assert {(r.pos, r.prominence) for r in got} == {(p, round(s, 6)) for p, _, s in expected(x, None, 1, None)}
