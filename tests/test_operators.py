import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import align, changes, distance, image, noise, page_table, report, rules, signal, split, stages, tfidf


def page(spark, preds, truth, page_id=1):
    p = spark.createDataFrame([(page_id, i, x) for i, x in enumerate(preds)], "page_id long, pred_idx int, pred string")
    g = spark.createDataFrame([(page_id, i, x) for i, x in enumerate(truth)], "page_id long, gt_idx int, gt string")
    return p, g


def path_of(p, g):
    """Plain table, for comparison."""

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    best = {(0, 0): (0, "")}
    for i in range(len(p) + 1):
        for j in range(len(g) + 1):
            options = []
            if i and j:
                options.append((best[i - 1, j - 1][0] + lev(p[i - 1].lower(), g[j - 1].lower()), 0, best[i - 1, j - 1][1] + "M"))
            if i:
                options.append((best[i - 1, j][0] + len(p[i - 1]), 1, best[i - 1, j][1] + "P"))
            if j:
                options.append((best[i, j - 1][0] + len(g[j - 1]), 2, best[i, j - 1][1] + "G"))
            if options:
                c, _, x = min(options, key=lambda o: o[:2])
                best[i, j] = (c, x)
    return best[len(p), len(g)]


EXTRA_TRUTH = (["hello world", "this is a test", "final line"], ["hello world", "EXTRA NOISE LINE", "this is a test", "final line"])
EXTRA_BOX = (["TITLE HEADER NOT IN GT", "cion Señor por sus rectissimos", "tos juyzios de darme tiempo", "que en vuestra educacion lo mani"], ["tro Señor por sus rectisimos", "tos juyzios de darme tiempo", "que en vuestra educacion lo mani"])


@pytest.mark.parametrize(("case", "cost", "edits", "ref", "seq", "counts"), [(EXTRA_TRUTH, 16, 0, 35, (25, 41), (0, 2, 3)), (EXTRA_BOX, 26, 4, 87, (74, 87), (1, 3, 4))])
def test_alignment_goldens(spark, case, cost, edits, ref, seq, counts):
    p, g = page(spark, *case)
    rows = align.align_pages(p, g)
    r = align.aggregate_rates(rows, "page_id").first()
    assert (r.edits, r.ref_len) == (edits, ref)
    assert (r.skipped, r.shifted, r.total) == counts
    assert {x.path_cost for x in rows.collect()} == {cost}
    s = align.sequential_rate(p, g, "page_id").first()
    assert (s.edits, s.ref_len) == seq


def test_alignment_edges(spark):
    p, g = page(spark, ["ab", "abc"], [])
    rows = sorted(align.align_pages(p, g).collect(), key=lambda r: r.pred_idx)
    assert [(r.matched_gt_idx, r.cer, r.edit_distance, r.skipped) for r in rows] == [(-1, 2.0, 2, True), (-1, 3.0, 3, True)]
    assert align.align_pages(*page(spark, [], ["x"])).count() == 0


def test_alignment_forms_agree(spark):
    r = random.Random(11)
    cases = [([("".join(r.choice("abC ") for _ in range(r.randint(0, 6)))) for _ in range(r.randint(1, 5))], ["".join(r.choice("abC ") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 5))]) for _ in range(40)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(cases)], "page_id long, p array<string>, g array<string>")
    a = {x.page_id: tuple(x.a) for x in df.select("page_id", align.alignment_path(F.col("p"), F.col("g")).alias("a")).collect()}
    assert a == {i: path_of(*c) for i, c in enumerate(cases)}
    for t, (cost, path) in zip(page_table._tables(cases), (path_of(*c) for c in cases), strict=True):
        assert as_path(t) == (cost, path)


def as_path(table):
    """Cost and path letters of a table's matches."""
    cost, match = table.best()
    out, j = [], 0
    for i in match.tolist():
        if i >= 0:
            out.append("G" * (i - j) + "M")
            j = i + 1
        else:
            out.append("P")
    return cost, "".join(out) + "G" * (len(table.lg) - j)


@pytest.mark.parametrize(("band", "cells", "pairs"), [(1, 1 << 26, 1 << 16), (1, 1, 7), (2, 40, 50), (64, 30, 1)])
def test_bands_and_kept_rows_change_nothing(monkeypatch, band, cells, pairs):
    """Narrow bands, tables beyond what is held, and few pairs at once: the plain table's matches, ties included."""
    for k, v in (("BAND", band), ("CELLS", cells), ("PAIRS", pairs)):
        monkeypatch.setattr(page_table, k, v)
    r = random.Random(band)
    line = lambda k: "".join(r.choice("abC ") for _ in range(r.randint(0, k)))
    for n in range(60):
        g = [line(6) for _ in range(r.randint(0, 14))]
        p = [x for x in g if r.random() < 0.8] if n % 2 else [line(6) for _ in range(r.randint(1, 14))]
        p = [x[: r.randint(0, 6)] + r.choice(["", "a"]) for x in p] + [line(4)] * (n % 3)
        cost, path = path_of(p, g)
        got = as_path(page_table.Table(p, g))
        # a skipped prediction and a skipped truth line between two matches may stand in either order
        assert got[0] == cost and [i for i, c in enumerate(got[1].replace("G", "")) if c == "M"] == [i for i, c in enumerate(path.replace("G", "")) if c == "M"] and got[1].replace("P", "") == path.replace("P", "")


def test_a_long_page_takes_little():
    """2,000 x 2,000 lines: within a band, and all cells of the table in bytes."""
    r = random.Random(4)
    g = ["".join(r.choice("abcdefghij ") for _ in range(50)) for _ in range(2000)]
    p = [x[:10] + "z" + x[11:] for i, x in enumerate(g) if i % 50]
    tracemalloc.start()
    cost, match = page_table.Table(p, g).best()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cost == len(p) + 50 * 40 and match.tolist() == [i for i in range(2000) if i % 50] and peak < 300 << 20


def test_few_distances_of_a_page_are_taken(monkeypatch):
    """Pages of 30 lines, with a shift and misread letters: as the whole table says, from a small part of its distances."""
    r, asked = random.Random(9), []
    take = page_table.between
    monkeypatch.setattr(page_table, "between", lambda a, b: asked.extend(a) or take(a, b))
    pages = []
    for _ in range(12):
        g = ["".join(r.choice("abcdefghij ") for _ in range(40)) for _ in range(30)]
        pages.append((["heading", *(x[:9] + "z" + x[10:] for i, x in enumerate(g) if i % 7)], g))
    for t, (p, g) in zip(page_table._tables(pages), pages, strict=True):
        assert as_path(t) == path_of(p, g)
        assert t.distances().tolist() == [len(x) if j < 0 else distance._by_rows(np.array([*x]), np.array([*g[j]])) for x, j in zip(p, t.best()[1], strict=True)]
    assert 0 < len(asked) < 12 * 30 * 30 / 4


def test_pages_that_are_not_settled_in_time(monkeypatch):
    """Letters' counts that say nothing, and no rounds: the whole table is taken."""
    monkeypatch.setattr(page_table, "ROUNDS", 0)
    p, g = ["ab", "ba", "abab"], ["ba", "ab", "baba", "aabb"]
    t = page_table.Table(p, g)
    assert as_path(t) == path_of(p, g) and t.distances().tolist() == [len(x) if j < 0 else distance._by_rows(np.array([*x]), np.array([*g[j]])) for x, j in zip(p, t.best()[1], strict=True)]


def test_stage_rates_of_texts_without_rows(spark):
    """Distances of null, equal, repeated and long texts, and the rates from them, without one table of the JVM a pair."""
    texts = [("abc", "abd"), ("abc", "abd"), (None, "x"), ("same", "same"), ("", "abc"), ("ñ" * 70, "n" * 70), ("a" * 5000, "b")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "k int, a string, b string")
    got = {r.k: r.d for r in align.text_distances(rows, {"d": ("a", "b")}).collect()}
    assert got == {r.k: r.d for r in rows.select("k", F.levenshtein("a", "b").alias("d")).collect()}
    p, g = spark.createDataFrame([(1, 0, "Éa", "ea")], "page_id long, pred_idx int, raw string, last string"), [(1, 0, "ea")]
    pairs = align.align_pages(p.select("page_id", "pred_idx", F.col("last").alias("pred")), spark.createDataFrame(g, "page_id long, gt_idx int, gt string"))
    out = align.stage_rates(pairs, p, ["raw", "last"], most=0.8)
    assert "levenshtein" not in out._jdf.queryExecution().toString()
    assert {(r.stage, r.cer, r.norm_cer, r.lines, r.excluded) for r in out.collect()} == {("raw", 0.5, 0.0, 1, 0), ("last", 0.0, 0.0, 1, 0)}


def test_distances_by_bits():
    r = random.Random(6)
    s = ["".join(r.choice("abé日") for _ in range(r.choice([0, 1, 3, 63, 64, 65, 128, 129, 200]))) for _ in range(40)]
    s += [x[:5] + "z" + x[6:] for x in s]
    a, b = np.array([[r.randrange(80), r.randrange(80)] for _ in range(300)]).T
    want = [plain_distance(s[i], s[j]) for i, j in zip(a, b, strict=True)]
    assert distance.distances(s, a, b).tolist() == want
    for name, value in (("LONG", 100), ("VECTORS", 60), ("MASKS", 40)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(distance, name, value)
            assert distance.distances(s, a, b).tolist() == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("bound", "reach", "rings", "part"), [(8 << 20, (1, 2, 4, 8), 1 << 16, 4096), (300, (1, 2, 4, 8), 1 << 16, 4096), (300, (1,), 40, 2), (300, (), 1 << 16, 1)])
def test_nearest(spark, monkeypatch, bound, reach, rings, part):
    """One array, or grams in growing distance and then pivots: the same as comparing all."""
    for name, value in (("CANDIDATE_BYTES", bound), ("REACH", reach), ("RINGS", rings), ("PART", part), ("PIVOTS", 5)):
        monkeypatch.setattr(align, name, value)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdE ") for _ in range(n))
    truth = [word(r.randint(0, 40)) for _ in range(40)] + ["abc", "abd", "ABC", "", None]
    preds = [x for x in truth[:20]] + ["ABC", "ab", "xy", "", None, "zzzzzzzzzzzzzzzzzzzzzzzz", "abc"]
    for t in truth[:30]:
        w = list(t)
        for _ in range(r.randint(1, 6)):
            w.insert(r.randrange(len(w) + 1), r.choice("xyz"))
        preds.append("".join(w))
    g = spark.createDataFrame([(100 - i, t) for i, t in enumerate(truth)], "gt_idx long, gt string")
    p = spark.createDataFrame([(i, t) for i, t in enumerate(preds)], "k int, pred string")
    want = {}
    for k, x in enumerate(preds):
        near = [(plain_distance(x.lower(), t.lower()), 100 - i, t) for i, t in enumerate(truth) if t is not None] if x is not None else []
        want[k] = min(near) if near else (None, None, None)
    assert {r.k: (r.distance, r.matched_idx, r.matched_gt) for r in align.nearest(p, g).collect()} == want
    assert {(r.distance, r.matched_idx) for r in align.nearest(p, g.where("false")).collect()} == {(None, None)}


def test_nearest_of_many_with_strangers(spark, monkeypatch):
    """1,500 texts, a third of them like no line, against 1,500 lines beyond the array's bound: by bits, all compared."""
    monkeypatch.setattr(align, "CANDIDATE_BYTES", 1000)
    r = random.Random(19)
    word = lambda: "".join(r.choice("etaoinshr ") for _ in range(r.randint(20, 60)))
    lines = [word() for _ in range(1500)]
    texts = [lines[i][:k] + r.choice("xyz") + lines[i][k + r.randint(0, 2) :] if i % 3 else word() for i, k in ((i, r.randint(0, 20)) for i in range(1500))]
    a, b = np.divmod(np.arange(1500 * 1500), 1500)
    d = distance.distances(texts + lines, a, b + 1500).reshape(1500, 1500)
    g = spark.createDataFrame(list(enumerate(lines)), "gt_idx long, gt string")
    p = spark.createDataFrame(list(enumerate(texts)), "k int, pred string")
    out = align.nearest(p, g)
    assert {r.k: (r.distance, r.matched_idx) for r in out.collect()} == {i: (int(d[i].min()), int(d[i].argmin())) for i in range(1500)}


def test_positional(spark):
    p, g = page(spark, ["a", "b"], ["x", "y", "z"])
    p, g = p.withColumnRenamed("pred_idx", "pos"), g.withColumnRenamed("gt_idx", "pos")
    assert align.unmatched(p, g, ["page_id", "pos"]).first().gt == "z"
    assert align.positional(g, p.withColumnRenamed("pred", "t"), ["page_id", "pos"], "t").where("not matched").first().t == ""


KNOWN = "vuestra benignidad se si la de fue una casa sobre el juyzio que haber iglesia"


@pytest.mark.parametrize(("x", "y"), [("vueftra Benignidad profeguid", "vuestra Benignidad profeguid"), ("cobraçen", "cobrazen"), ("haçer  la guerra,", "hazer  la guerra,"), ("fobre el juyzio", "sobre el juyzio"), ("Dif  (vna) Cafa.", "Dif  (una) Casa."), ("la Fe, y", "la Se, y"), ("", "")])
def test_rules(spark, x, y):
    known = rules.word_list(spark, KNOWN)
    assert rules.apply_rules(spark.createDataFrame([(1, x)], "k int, line string"), known, ["k"]).first().corrected == y


def test_lines_are_not_shuffled_for_the_rules(spark, monkeypatch):
    """Many ranges of changed tokens, odd white space, null and empty lines, repeated tokens; no line or token of one is dealt."""
    monkeypatch.setattr(rules, "RANGE", 1)
    known = rules.word_list(spark, "seruir vno fue como usar")
    lines = [(1, "servir  uno\tfve "), (2, None), (3, ""), (4, "   "), (5, "nada uno, uno. (fve) como\u00a0vsar"), (6, "servir\nservir")]
    out = rules.apply_rules(spark.createDataFrame(lines, "k int, line string"), known, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Generate", "Repartition"))
    assert {r.k: r.corrected for r in out.collect()} == {1: "seruir  vno\tfue ", 2: None, 3: "", 4: "   ", 5: "nada vno, vno. (fue) como\u00a0usar", 6: "seruir\nseruir"}


def test_words_of_one_hash():
    """Ranges that hold several words of a hash, words that only share one, and an empty range."""
    table = lambda *rows: pa.table({"h": pa.array([r[0] for r in rows], pa.int64()), "token": pa.array([r[1] for r in rows], pa.string()), "corrected": pa.array([r[2] for r in rows], pa.string())}).combine_chunks()
    ranges = {0: table((-4, "a", "A"), (-4, "b", "B"), (-4, "c", "C"), (8, "d", "D")), 1: table()}
    words, h = pa.array(["c", "x", "d", "a", "e", "b", "f"]), np.array([-4, -4, 8, -4, 9, -4, 10])
    place, new = rules._looked_up(words, h, ranges, 2)
    assert {words[i].as_py(): w.as_py() for i, w in zip(place.tolist(), new, strict=True)} == {"a": "A", "b": "B", "c": "C", "d": "D"}


def test_changes(spark):
    df = spark.createDataFrame([(1, "el rey fe fue", "el rey se fue"), (2, "Ano, dos", "ano dos"), (3, None, "x")], "k int, a string, b string")
    rows = {(r.k, r.original, r.corrected, r.is_ocr_error) for r in changes.change_rows(df, ["k"], "a", "b").collect()}
    assert (1, "fe", "se", False) in rows and not any(k == 3 for k, *_ in rows)
    f = changes.nested_counts(changes.surface_forms(changes.change_rows(df, ["k"], "a", "b"))).collect()
    assert {r.corrected: r.originals for r in f} == {"ano": {"Ano,": 1}}
    assert [(r.original, r.corrected) for r in changes.spelling_errors(changes.change_rows(df, ["k"], "a", "b")).collect()] == [("fe", "se")]


def test_moving_average(spark):
    s = spark.createDataFrame([(1, y, float(y == 3)) for y in range(8)], "p int, y int, v double")
    for w, places in ((2, {3, 4}), (3, {2, 3, 4}), (4, {2, 3, 4, 5}), (5, {1, 2, 3, 4, 5})):
        got = signal.moving_average(s, "p", "y", "v", w).collect()
        assert {r.y for r in got if r.smooth} == places
        assert all(r.smooth in (0, 1 / w) for r in got)
        assert [r.smooth for r in sorted(got, key=lambda r: r.y)] == pytest.approx(np.convolve([0, 0, 0, 1, 0, 0, 0, 0], np.ones(w) / w, "same").tolist())


def test_islands(spark):
    high = [0, 1, 1, 0, 1, 0, 0, 1, 0]
    s = spark.createDataFrame([(1, y, h) for y, h in enumerate(high)], "p int, y int, h int")
    assert {(r.start, r.stop) for r in signal.islands(s, "p", "y", "h = 1", 2).collect()} == {(1, 4), (7, 8)}


def test_autocorrelation(spark):
    x = [float(y % 5) for y in range(40)]
    s = spark.createDataFrame([(1, y, v) for y, v in enumerate(x)] + [(2, y, 1.0) for y in range(30)], "p int, y int, v double")
    got = {(r.p, r.lag): r.acf for r in signal.autocorrelation(s, "p", "y", "v", 10).collect()}
    d = np.array(x) - np.mean(x)
    assert {p for p, _ in got} == {1}
    assert [got[1, k] for k in range(11)] == pytest.approx([(d[: 40 - k] @ d[k:]) / (d @ d) for k in range(11)])


def test_peaks_and_segments(spark):
    assert signal.peaks(np.array([0, 2, 2, 0, 1, 0])).tolist() == [1, 4]
    assert signal.peaks(np.array([0, 3, 0, 2, 0, 5, 0]), distance=3).tolist() == [1, 5]
    assert signal.peaks(np.array([0, 3, 2.9, 3.1, 0]), prominence=0.5).tolist() == [3]
    assert signal.absorbed([(0, 2), (5, 20), (22, 24)], 10) == [(0, 24)]
    ink = [(1, y, 100.0 if y % 20 < 12 else 0.0) for y in range(200)]
    got = signal.line_segments(spark.createDataFrame(ink, "page_id long, y int, ink double")).collect()
    assert [(r.line_index, r.y1, r.y2) for r in got] == [(i, a, b) for i, (a, b, *_) in enumerate(plain_segments([v for *_, v in ink])[0])]
    assert len(got) == 10 and got[0].period == 20 and got[0].method == "autocorrelation"
    assert signal.absorbed([(0, 2), (4, 5)], 20) == [] and signal.absorbed([(0, 2)], 10) == [(0, 2)] and signal.absorbed([(0, 2), (4, 20)], 10) == [(0, 20)]


def plain_peaks(x, height=None, distance=1, prominence=None):
    """Flat tops and all, one by one; (place, prominence)."""
    found = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            found.append((i + j) // 2)
    found = [i for i in found if height is None or x[i] >= height]
    kept = []
    for i in sorted(found, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        a, b = i, i
        while a > 0 and x[a - 1] <= x[i]:
            a -= 1
        while b + 1 < len(x) and x[b + 1] <= x[i]:
            b += 1
        p = x[i] - max(min(x[a : i + 1]), min(x[i : b + 1]))
        if prominence is None or p >= prominence:
            out.append((i, p))
    return out


def plain_segments(ink, heights=()):
    n = len(ink)
    mean = sum(ink) / n
    d = [v - mean for v in ink]
    period, method, sure = max(8, n // 50), "heuristic", 0.0
    best = None
    if n >= 20 and (sum(v * v for v in d) / n) ** 0.5 >= 1e-6:
        acf = [sum(d[i] * d[i + k] for i in range(n - k)) for k in range(n)]
        acf = [v / acf[0] for v in acf]
        p = plain_peaks(acf[4 : max(6, n // 3)], height=0.05, prominence=0.03)
        if p:
            best = max(p, key=lambda q: (q[1], -q[0]))[0] + 4
    if best is not None and acf[best] >= 0.10:
        period, method, sure = best, "autocorrelation", acf[best]
    elif len(heights) >= 3:
        period, method = max(8, int(np.percentile(heights, 75) * 1.5)), "cc_height"
    line = max(4, int(period * 0.75))

    def smooth(w):
        return np.convolve(ink, np.ones(min(w, n)) / min(w, n), "same").tolist()

    s = smooth(max(3, line // 3))
    active = [v for v in s if v > np.percentile(s, 10)]
    depth = 0.06 * (float(np.median(active)) if active else 1.0)
    cuts = [-1, *[i for i, _ in plain_peaks([-v for v in s], distance=max(4, period // 2), prominence=depth)], n]
    found = [(a + 1, b - 1) for a, b in zip(cuts, cuts[1:]) if b - a - 1 >= max(4, line // 4) and max(ink[a + 1 : b]) > 0]
    if len(found) <= 1 and any(v > 0 for v in ink):
        method += "+fallback"
        s = smooth(max(3, line // 2))
        level = np.percentile([v for v in s if v > 0], 20) / 2
        high = [i for i, v in enumerate(s) if v >= level]
        found, gap = [], max(2, line // 5)
        for i in high:
            if found and i - found[-1][1] <= gap:
                found[-1][1] = i
            else:
                found.append([i, i])
        if found and n - 1 - found[-1][1] < gap:
            found[-1][1] = n - 1
        found = [tuple(x) for x in found]
    if len(found) > 1:
        parts, out = list(found), []
        while parts:
            a, b = parts.pop(0)
            if b - a + 1 >= 0.6 * line:
                out.append((a, b))
            elif out:
                out[-1] = (out[-1][0], b)
            elif parts:
                parts[0] = (a, parts[0][1])
        found = out
    return found, period, sure, method


def made_profiles():
    r = np.random.default_rng(4)
    for k in range(60):
        n = int(r.integers(5, 260))
        step = int(r.integers(7, 40))
        y = np.arange(n)
        kind = k % 6
        ink = {0: np.where(y % step < step * 0.6, 50.0, 0.0), 1: 30 + 20 * np.sin(2 * np.pi * y / step), 2: r.integers(0, 60, n).astype(float), 3: np.where(r.random(n) < 0.1, 40.0, 0.0), 4: np.where((y // 13) % 3 == 0, 0.0, 25.0) + r.integers(0, 4, n), 5: np.zeros(n) if k % 12 == 5 else np.full(n, 7.0)}[kind]
        yield np.round(ink, 3), r.integers(4, 30, int(r.integers(0, 6))).astype(float)


def test_segments_are_those_of_a_plain_reading():
    seen = set()
    for ink, heights in made_profiles():
        got, period, sure, method = signal.segments(ink, heights)
        want = plain_segments(ink.tolist(), heights)
        assert (got, period, method) == (want[0], want[1], want[3]) and sure == pytest.approx(want[2])
        seen.add(method)
    assert {"autocorrelation", "cc_height", "heuristic+fallback", "cc_height+fallback"} <= seen


def test_long_signals_take_no_square_of_time():
    r, n = np.random.default_rng(1), 200_000
    ink = 50 + 40 * np.sin(np.arange(n) * 2 * np.pi / 40) + r.normal(0, 8, n)
    begin = time.process_time()
    found, p, sure, method = signal.segments(ink)
    assert time.process_time() - begin < 20
    assert abs(p - 40) <= 2 or p % 40 in (0, 1, 39)
    assert method == "autocorrelation" and sure > 0.5 and found
    for x in (r.integers(0, 9, 300).astype(float), r.normal(size=300), np.arange(300.0)):
        p = signal.peaks(x)
        for k, v in zip(p, signal.prominences(x, p), strict=True):
            higher = np.flatnonzero(x > x[k])
            a, b = max([0, *higher[higher < k]]), min([len(x) - 1, *higher[higher > k]])
            assert v == x[k] - max(x[a : k + 1].min(), x[k : b + 1].min())
    d = r.normal(size=signal.DIRECT + 5)
    assert signal.lagged(d) == pytest.approx(np.correlate(d, d, "full")[len(d) - 1 :], abs=1e-6)


def test_segments_of_rows_are_those_of_groups(spark):
    signals = {1: [100.0 if y % 20 < 12 else 0.0 for y in range(200)], 2: [5.0], 3: [float(y * y % 17) for y in range(90)]}
    grouped = spark.createDataFrame([(k, y, v) for k, x in signals.items() for y, v in enumerate(x)], "page_id long, y int, ink double")
    rows = spark.createDataFrame([*signals.items(), (4, []), (5, None)], "page_id long, ink array<double>")
    want = sorted(map(tuple, signal.line_segments(grouped).collect()))
    assert want and sorted(map(tuple, signal.line_segments_of_rows(rows).collect())) == want


def test_registered_segments_push_nothing_through_a_group(spark, tmp_path):
    from lectern.plans import queries

    word = "casa " * 12
    spark.createDataFrame([(7, word * 30), (8, ""), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.line_segments(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan
    rows = got.collect()
    assert {r.page_id for r in rows} == {7} and max(r.y2 for r in rows) == 29


def test_image(spark):
    page = np.full((200, 100), 255, np.uint8)
    for k, y in enumerate(range(10, 200, 20)):
        page[y : y + 10, 20 : 80 - k] = 0
    df = spark.createDataFrame([(1, 200, 100, bytearray(page.tobytes()))], "page_id long, height int, width int, grey binary")
    rows = sorted(image.text_lines(df).collect(), key=lambda r: r.line_index)
    assert [(r.x1, r.x2) for r in rows] == [(20, 79 - k) for k in range(10)] and all(r.padded.x1 == 15 for r in rows)
    assert [image.binarised(page).sum(1).tolist()] == [[x.ink for x in sorted(image.profiles(df).collect(), key=lambda x: x.y)]]
    c = image.component_table(df).collect()
    assert sorted((r.height, r.area) for r in c) == sorted((10, 10 * (60 - k) - (4 if k < 9 else 2)) for k in range(10))  # the last block's lower corners lie on the edge
    p = signal.component_periods(image.component_table(df), "page_id", "page_height").first()
    assert p.period == 15


def test_components_are_those_of_a_flood():
    r = np.random.default_rng(7)
    for density in (0.2, 0.45, 0.7):
        ink = r.random((30, 25)) < density
        left, want = {(int(y), int(x)) for y, x in zip(*np.nonzero(ink))}, []
        while left:
            front, part = [left.pop()], []
            while front:
                y, x = front.pop()
                part.append(y)
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        front.append(q)
            want.append((max(part) - min(part) + 1, len(part)))
        h, a = image.components(ink)
        assert sorted(zip(h.tolist(), a.tolist())) == sorted(want)
    assert image.components(np.zeros((3, 3), bool))[0].tolist() == []


def test_boxes_of_drawn_lines(spark):
    """A page drawn from lines is read as that many lines, each as wide as its text."""
    text = ["casa grande de la plaza", "los libros que fueron", "uno dos tres cuatro", "la tierra y el mar"] * 3
    df = image.drawn(spark.createDataFrame([(1, text), (2, []), (3, None)], "k long, lines array<string>"), "k", "lines")
    rows = sorted((r.line_index, r.x1, r.x2, r.y1, r.y2) for r in image.text_lines(df).where("page_id = 1").collect())
    assert [r[0] for r in rows] == list(range(12)) and all(abs(x2 - x1 - 4 * len(text[i])) <= 8 for i, x1, x2, *_ in rows)
    assert image.text_lines(df).where("page_id <> 1").count() == 0


def test_split(spark):
    assert split.numbered_pages(list(range(1, 21))) == {5, 6, 15, 20}
    n = spark.range(10000).where(split.in_validation(F.col("id"))).count()
    assert 1800 < n < 2200


def test_training_pairs(spark):
    df = spark.createDataFrame([("a ", "a", "b"), ("b", "b", "b"), ("x", None, "y"), (" ", None, "y"), ("z", "q", " ")], "ocr_output string, rule_corrected string, ground_truth string")
    gold = spark.createDataFrame([("b",), (" y",), ("",)], "gold string")
    noisy = spark.createDataFrame([("b", "d"), ("b", "b"), ("", "x")], "gold string, noisy string")
    rows = split.training_pairs(df, gold, noisy).collect()
    assert Counter(r.kind for r in rows) == {"real": 2, "rule": 2, "identity": 2, "synthetic": 1}
    assert {(r.source, r.target) for r in rows} == {("correct: a", "b"), ("correct: x", "y"), ("correct: b", "b"), ("correct: y", "y"), ("correct: d", "b")}
    assert sorted(map(tuple, split.repeated(df, 3).groupBy("copy").count().collect())) == [(k, 5) for k in range(3)]


def test_augmented_pairs_are_all_kinds(spark, tmp_path):
    from lectern.plans import queries

    t = [(c, n, f" la casa número {c} de los señores {n} ") for c in range(5) for n in range(4)]
    spark.createDataFrame(t, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.kind: r.pairs for r in queries.augmented_pairs(spark, str(tmp_path)).collect()}
    lines = spark.createDataFrame([(c, n, x.strip()) for c, n, x in t], "conv_id long, turn int, text string")
    noisy = noise.synthetic(lines, "text", ["conv_id", "turn"], queries.misreadings(spark), 5)
    assert got == {"real": 20, "rule": 20, "identity": 20, "synthetic": noisy.where("gold <> noisy").count()} and got["synthetic"] > 60


def test_changes_by_brute_force(spark, tmp_path):
    """Replaced words of a turn and its next, against a plain diff of equal numbers of words."""
    from lectern.plans import queries

    turns = [(1, 0, "el rey fe fue a Ser"), (1, 1, "el rey se fue a ser"), (1, 2, "uno uno dos"), (2, 0, "solo")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.original, r.corrected, r.start, r.end, r.is_ocr_error) for r in queries.text_changes(spark, str(tmp_path)).collect()}
    assert {(1, 0, "fe", "se", 7, 9, False), (1, 0, "Ser", "ser", 16, 19, True)} <= got and not any(x[0] == 2 for x in got)


TABLE = [("word", 0, "t", "7"), ("word", 1, "t", "never"), ("word", 2, "ß", "ss"), ("type", 0, "xy", "z"), ("type", 1, "k", "h"), ("type", 2, "k", "x"), ("type", 3, "x", "y"), ("type", 4, "xx", "x"), ("edit", 0, "k", "lc")]


@pytest.fixture(scope="module")
def readings(spark):
    return noise.readings(spark.createDataFrame(TABLE, "kind string, place int, seen string, read string"))


def forms(spark, f, text, n, *args):
    """How often each noisy form of a text comes from n salts."""
    return Counter(r[0] for r in spark.range(n).select(f(F.lit(text), F.concat(F.lit("s"), F.col("id").cast("string")), *args)).collect())


def test_noise_is_the_same_everywhere(spark):
    table = spark.createDataFrame(TABLE, "kind string, place int, seen string, read string")
    df = spark.createDataFrame([(i, "la casa de los señores fue vista") for i in range(20)], "k long, line string")
    a, b = ({(r.k, r.copy): r.noisy for r in noise.synthetic(d, "line", ["k"], table).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 100 and len(set(a.values())) > 20
    odd = spark.createDataFrame([(None, None), (None, ""), (1, " "), (2, "x" * 20_000)], "k long, line string")
    got = Counter((r.gold, len(r.noisy) if r.noisy is not None else None) for r in noise.synthetic(odd, "line", ["k"], table, 2).collect())
    assert got[None, None] == 2 and got["", 0] == 2 and noise.synthetic(df.limit(0), "line", ["k"], table).count() == 0


def test_noise_of_words(spark, readings):
    seen = forms(spark, noise.word_errors, "tu  Qa", 4000, readings)
    split = [k.split(" ") for k in seen.elements()]
    assert {len(x) for x in split} == {3} and all(x[1] == "" and x[0] != "tu" and x[2] != "Qa" for x in split)
    first = Counter(x[0] for x in split)
    assert first["7u"] / 4000 == pytest.approx(0.25, abs=0.03) and not any("never" in k for k in first)  # one error, in the first place
    both = sum(n for k, n in first.items() if k[0] == "7" and k[1:] != "u") / 4000
    assert both == pytest.approx(0.5, abs=0.03) and len(first) == 51  # 25 other letters behind t or 7, and 7u
    assert all(x[2][0] == "Q" or (x[2][0].isupper() and x[2][0].isascii()) for x in split)
    assert set(forms(spark, noise.word_errors, "ß", 50, readings)) == {"ss"} and set(forms(spark, noise.word_errors, "", 5, readings)) == {""}
    assert len(forms(spark, noise.word_errors, "7", 2000, readings)) == 26


def test_noise_of_old_type(spark, readings):
    n = 20_000
    near = lambda x, p: x / n == pytest.approx(p, abs=0.012)
    seen = forms(spark, noise.old_type, "k", n, readings)  # k to h is tried before k to x
    assert near(seen["h"], 0.12) and near(seen["x"], 0.88 * 0.12) and near(seen["kk"], 0.88**2 * 0.03) and near(seen["k"], 0.88**2 * 0.97)
    seen = forms(spark, noise.old_type, "xy", n, readings)  # the pair is tried before its first letter
    assert near(seen["z"], 0.12) and near(seen["yy"], 0.88 * 0.12 * 0.97)
    seen = forms(spark, noise.old_type, "xxx", n, readings)
    assert near(sum(v for k, v in seen.items() if len(k) == 1), 0)  # a pair takes the letter behind it along: never two of three
    seen = forms(spark, noise.old_type, " ", n, readings)
    assert near(seen[""], 0.97 * 0.04) and near(seen["  "], 0.03)


def test_noise_of_edits(spark, readings):
    n, q = 40_000, 0.03 / 4
    near = lambda x, p: x / n == pytest.approx(p, abs=0.003)
    seen = forms(spark, noise.edits, "kA", n, readings)
    assert near(seen["lcA"], q) and near(seen["A"], q) and near(seen["Ak"], q) and near(sum(v for k, v in seen.items() if len(k) == 3 and k[0] == "k" and k[2] == "A"), q)
    seen = forms(spark, noise.edits, "ab", n, readings)
    assert near(seen["ba"], 2 * q)  # without a like letter: exchanged
    seen = forms(spark, noise.edits, "Kk", 400, readings, 1.0)
    assert any(k.startswith("LC") for k in seen) and any(k.endswith("lc") for k in seen)
    long = forms(spark, noise.edits, "a" * 30_000, 2, readings)
    assert all(abs(len(k) - 30_000) < 120 for k in long)


def test_noise_is_of_three_kinds(spark, readings):
    line, n = "la casa de los", 3000
    salts = spark.range(n).select(F.col("id").cast("string").alias("s"), F.lit(line).alias("t"))
    kinds = [F.when(noise.noisy(F.col("t"), F.col("s"), readings) == f(F.col("t"), F.col("s"), readings), 1).otherwise(0) for f in (noise.word_errors, noise.old_type, noise.edits)]
    got = salts.select(*kinds).collect()
    assert all(any(r) for r in got) and sum(r[0] for r in got) / n == pytest.approx(0.33, abs=0.03)


def test_tables_of_readings_are_checked(spark):
    for bad in (("word", 0, "ab", "x"), ("type", 0, "abc", "x"), ("type", 0, "", "x")):
        with pytest.raises(ValueError):
            noise.readings(spark.createDataFrame([bad], "kind string, place int, seen string, read string"))
    empty = noise.readings(spark.createDataFrame([], "kind string, place int, seen string, read string"))
    assert set(forms(spark, noise.old_type, "ab", 200, empty)) <= {"ab", "aab", "abb", "aabb"}


def test_tfidf(spark, monkeypatch):
    df = spark.createDataFrame([(1, "uno dos", "uno dos"), (2, "tres", "cuatro"), (3, "", "")], "k int, a string, b string")
    got = {r.k: r.cosine for r in tfidf.cosines(df, "k", "a", "b", tfidf.word_terms).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}
    monkeypatch.setattr(tfidf, "SENT", 0)
    assert {r.k: r.cosine for r in tfidf.cosines(df, "k", "a", "b", tfidf.word_terms).collect()} == got
    assert df.select(tfidf.char_terms(F.lit("a bc")).alias("t")).first().t == [" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "]


def test_terms_of_sent_vocabularies_are_not_shuffled(spark, monkeypatch):
    """Rows that repeat a key, null texts and texts without terms; both ways say the same, and sent terms make no rows."""
    df = spark.createDataFrame([(1, "uno dos", "uno tres"), (2, "tres", None), (3, "", ""), (1, "dos", "dos"), (4, "uno uno", "uno dos")], "k int, a string, b string")
    out = tfidf.cosines(df, "k", "a", "b", tfidf.char_terms)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {r.k: r.cosine for r in out.collect()}
    assert out.count() == 4 and got[2] == got[3] == 0.0 and 0 < got[4] < 1
    monkeypatch.setattr(tfidf, "SENT", 0)
    assert {r.k: pytest.approx(r.cosine) for r in tfidf.cosines(df, "k", "a", "b", tfidf.char_terms).collect()} == got


def test_pages_are_read_once_for_their_lines(spark, monkeypatch):
    """One pass over pixels gives boxes and medians, and shuffles no pixels; components are sought only where the profile doesn't tell."""
    df = image.drawn(spark.createDataFrame([(1, ["un texto", "de tres", "lineas"]), (None, ["a"])], "k long, lines array<string>"), "k", "lines")
    out = image.text_lines(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 2
    assert {r.page_id for r in out.collect()} == {1}
    r = np.random.default_rng(3)
    for shape in [(1, 1), (1, 7), (9, 1), (2, 2), (17, 23)]:
        grey = r.integers(0, 256, shape).astype(np.uint8)
        p = np.pad(grey, 1, mode="edge")
        want = np.median([p[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3)], axis=0)
        assert np.array_equal(image.median3(grey), want)
    assert signal.period(np.tile([0.0, 0, 9, 9, 9, 9, 0, 0, 0, 0], 8), lambda: 1 / 0)[2] == "autocorrelation"
    assert signal.period(np.zeros(60), lambda: np.array([8, 8, 8])) == (12, 0.0, "cc_height")


def test_stages(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k int, t string")
    out = stages.run_stage(df, lambda: lambda s: s.str.upper(), "t", "u")
    assert {r.u for r in out.collect()} == {"A B", "C"}
    g = stages.guarded_stage(df.withColumn("c", F.lit("x y")), "t", "c", "z")
    assert {(r.z, r.status) for r in g.collect()} == {("x y", "success"), ("c", "word_count_mismatch")}
    def load():
        seen = []

        def service(x):
            seen.append(x)
            if x == "bad" or (x == "late" and seen.count(x) < 2):
                raise RuntimeError("please retry in 0.5s")
            return x.upper()

        return service

    asked = stages.called(spark.createDataFrame([("late",), ("bad",), (" ",), (None,)], "t string"), load, "t", "u", sleep=lambda s: None)
    assert {(r.u, r.status) for r in asked.collect()} == {("LATE", "success"), ("bad", "max_retries_exceeded"), (" ", "empty_input"), ("", "empty_input")}
    pre = spark.createDataFrame([(1, "P")], "k int, o string")
    assert {r.p for r in stages.precomputed(df, pre, ["k"], "t", "o", "p").collect()} == {"P", "c"}


def test_reports(spark):
    df = spark.createDataFrame([(0.1, 0.05), (0.15, 0.15), (0.2, 0.3), (0.12345, 0.1235)], "a double, b double")
    rows = df.select(report.band(F.col("a")).alias("x"), report.band(F.col("a"), "trained").alias("y"), report.improvement(F.col("a"), F.col("b")).alias("z")).collect()
    assert [tuple(r) for r in rows] == [("good", "good", "better"), ("fair", "fair", "worse" if 0.15 < 0.15 else "same"), ("fair", "poor", "worse"), ("fair", "fair", "worse")]
    images = spark.createDataFrame([(1, True), (2, False), (3, True)], "k int, readable boolean")
    texts = spark.createDataFrame([(1,), (2,), (4,), (4,)], "k int")
    assert {tuple(r) for r in report.skipped(images, texts, "k").collect()} == {(2, "unreadable"), (3, "no text"), (4, "no image")}
    left, right = (spark.createDataFrame(x, "page int, pos int") for x in ([(1, 0), (1, 1), (2, 0)], [(1, 1), (1, 2), (1, 3)]))
    got = {r.page: tuple(r)[1:] for r in report.run_summary(left, right, ["page", "pos"], "page").collect()}
    assert got == {1: (2, 3, 1, 1, 2), 2: (1, 0, 0, 1, 0), None: (3, 3, 1, 2, 2)}
    wide = spark.createDataFrame([("raw", 0.5, 2)], "stage string, cer double, lines int")
    assert [tuple(r) for r in report.long_report(wide, "stage", ["cer", "lines"]).collect()] == [("raw", "cer", 0.5), ("raw", "lines", 2.0)]
    assert [r.pos for r in report.head(right, 2, "page", "pos").collect()] == [1, 2]
