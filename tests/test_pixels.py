"""Preparing page images, against plain versions that look at every pixel's neighbourhood."""

import numpy as np
import pytest

from lectern.operators import pixels


def page_of_lines(angle: float, h: int = 420, w: int = 520) -> np.ndarray:
    """Dark bars that fall by `angle` degrees to the right, with gaps as between words."""
    y, x = np.mgrid[0:h, 0:w]
    a = np.deg2rad(angle)
    down, along = (y - h / 2) * np.cos(a) - (x - w / 2) * np.sin(a), (x - w / 2) * np.cos(a) + (y - h / 2) * np.sin(a)
    ink = (np.mod(down, 40) < 12) & (np.mod(along, 130) < 115) & (np.abs(along) < w * 0.4)
    return np.where(ink, 30, 220).astype(np.uint8)


def rows(spark, pages):
    return spark.createDataFrame([(i, p.shape[0], p.shape[1], p.tobytes(), "clash") for i, p in enumerate(pages)], "page_id long, height int, width int, grey binary, text string")


def test_planted_angles_are_found_and_taken_back(spark):
    planted = [-12.0, -3.4, -0.2, 0.0, 0.9, 2.5, 7.8, 20.0]
    found = sorted(pixels.straightened(rows(spark, [page_of_lines(a) for a in planted])).collect())
    assert [r.text for r in found] == ["clash"] * len(planted)
    for a, r in zip(planted, found, strict=True):
        assert abs(r.skew - a) <= 0.5
        if abs(r.skew) < pixels.SKEWED:
            assert bytes(r.grey) == page_of_lines(a).tobytes()
    again = pixels.skews(rows(spark, [np.frombuffer(r.grey, np.uint8).reshape(r.height, r.width) for r in found]))
    assert all(abs(r.skew) <= 0.5 for r in again.collect())


def test_odd_pages_stay(spark):
    df = spark.createDataFrame([(1, 5, 5, None), (2, 0, 0, b""), (None, 1, 1, b"\x07"), (4, 30, 30, bytes([200]) * 900)], "page_id long, height int, width int, grey binary")
    got = {r.page_id: (r.skew, r.grey if r.grey is None else bytes(r.grey)) for r in pixels.straightened(df).collect()}
    assert got == {1: (None, None), 2: (None, b""), None: (None, b"\x07"), 4: (None, bytes([200]) * 900)}
    assert pixels.prepared(df).count() == 4 and pixels.prepared(df.where("false")).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (7, 40), (33, 25), (60, 51)])
def test_background_is_the_plain_closing(shape):
    g = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)

    def plain(x, take):
        return np.array([[take(x[max(0, i - 12) : i + 13, max(0, j - 12) : j + 13]) for j in range(shape[1])] for i in range(shape[0])])

    closed = plain(plain(g, np.max), np.min)
    assert (pixels.background(g) == closed).all()
    assert (pixels.cleaned(g) == 255 - (closed.astype(int) - g)).all() and (closed >= g).all()


@pytest.mark.parametrize("shape", [(3, 5), (41, 64), (80, 70)])
def test_contrast_is_that_of_tiles_pixel_by_pixel(shape):
    g = np.random.default_rng(2).normal(120, 20, shape).clip(0, 255).astype(np.uint8)
    h, w = shape
    th, tw = -(-h // 8), -(-w // 8)
    fold = lambda i, n: 0 if n == 1 else min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))

    def mapped(r, c):
        n = [0] * 256
        for i in range(r * th, r * th + th):
            for j in range(c * tw, c * tw + tw):
                n[g[fold(i, h), fold(j, w)]] += 1
        most = max(1, int(2.0 * th * tw / 256))
        over = sum(max(0, k - most) for k in n)
        n = [min(k, most) + over // 256 for k in n]
        rest = over % 256
        for k in range(0, 256, max(1, 256 // rest) if rest else 256):
            if rest:
                n[k] += 1
                rest -= 1
        return np.rint(np.cumsum(n) * (255 / (th * tw))).clip(0, 255)

    maps = [[mapped(r, c) for c in range(8)] for r in range(8)]
    want = np.zeros(shape)
    for i in range(h):
        for j in range(w):
            y, x = i / th - 0.5, j / tw - 0.5
            a, b = int(np.floor(y)), int(np.floor(x))
            m = lambda r, c: maps[min(max(r, 0), 7)][min(max(c, 0), 7)][g[i, j]]  # noqa: B023, E731
            fx, fy = x - b, y - a
            want[i, j] = (m(a, b) * (1 - fx) + m(a, b + 1) * fx) * (1 - fy) + (m(a + 1, b) * (1 - fx) + m(a + 1, b + 1) * fx) * fy
    assert (pixels.levelled(g) == np.rint(want).clip(0, 255)).all()


def test_a_faded_page_spreads_by_no_more_than_the_clip_allows():
    faded = np.random.default_rng(4).normal(120, 4, (400, 400)).round().clip(0, 255).astype(np.uint8)
    assert 1.5 * faded.std() < pixels.levelled(faded).std() < 4 * faded.std()
