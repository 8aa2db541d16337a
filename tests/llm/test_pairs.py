"""Operators on pairs against brute force over all pairs."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, embed_dedup, ngram_join, store
from lectern.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def ready(spark):
    store.prepare(spark)


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def smallest(nodes, links):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def brute(rows, k, percent):
    s = [(i, shingles(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(s, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return smallest({i for i, _ in s}, links)


def joined(spark, rows, k, percent, schema="doc_id long, text string"):
    return ngram_join.components(spark.createDataFrame(rows, schema), k, percent).collect()


def near_copies(r, n, size, edits):
    base = [f"w{r.randrange(300)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_join_is_brute_force(spark, k, percent, seed):
    r = random.Random(seed)
    texts = near_copies(r, 60, 120, 6) + near_copies(r, 25, 60, 3) + [" ".join(f"v{r.randrange(2000)}" for _ in range(r.randrange(1, 80))) for _ in range(80)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{r.randrange(10**5)}" for _ in range(r.randrange(3, 60))) for _ in range(40)]
    texts += ["", None, " \t\n", "one", "one", "ONE", "one two", "One  two", texts[0], texts[0].upper(), "É é", "é é"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in joined(spark, rows, k, percent)}
    low = brute(rows, k, percent)
    assert got == {i: (len(shingles(t, k)), low[i]) for i, t in rows}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With tiles of a few rows every bucket is dealt out, in the nearest rounds and in the last."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "HUB", 3)
    r = random.Random(5)
    rows = list(enumerate(near_copies(r, 70, 60, 5) + near_copies(r, 30, 40, 4)))
    got = {x.doc_id: x.component_id for x in joined(spark, rows, 3, 90)}
    assert got == brute(rows, 3, 90)


def test_long_texts_whose_nearest_is_a_stranger(spark):
    """Bitmaps of very long texts say little: strangers that share a few rare words look nearer than the near copy."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(5)]
    body = lambda: passage + [f"c{r.randrange(3000)}" for _ in range(24000)]
    base = body()
    copy = list(base)
    for i in range(100, 24000, 70):
        copy[i] = f"c{r.randrange(3000)}"
    rows = list(enumerate([" ".join(x) for x in [base, copy, *(body() for _ in range(40))]]))
    assert brute(rows[:2], 3, 90) == {0: 0, 1: 0}
    got = {x.doc_id: x.component_id for x in joined(spark, rows, 3, 90)}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 42)}


def test_join_odd_rows(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (2, "x y z"), (7, "x y z"), (9, "very " * 60000 + "long"), (8, "very " * 60000 + "long")]
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in joined(spark, rows, 3, 90))
    # 2 repeats, so it ties both groups together
    assert {x[0]: x[2] for x in got if x[0]} == {1: 1, 2: 1, 7: 1, 8: 8, 9: 8}
    assert len(got) == 7 and [x for x in got if x[0] == 0] in ([(0, 2, 1)], [(0, 2, 0)])
    assert joined(spark, [], 3, 90) == []
    df = spark.createDataFrame([(1, "a b c", 5, "s")], "doc_id long, text string, id int, fp string")
    assert ngram_join.components(df).first().component_id == 1


def test_long_words_that_are_alike(spark):
    """Words that a polynomial modulo 2**64 can't tell apart are different words."""
    word = lambda swap: "".join("ba"[(i.bit_count() + swap) % 2] for i in range(2048))
    got = joined(spark, [(1, word(0)), (2, word(1)), (3, word(1))], 3, 90)
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 2, 3: 2}


def test_prefix_shares_enough():
    """Two sets over the threshold share at least the smaller number within their prefixes."""
    r = np.random.default_rng(0)
    for _ in range(300):
        universe = r.integers(1, 2**63, 80).astype(np.uint64)
        count = r.integers(1, 50, 80).astype(np.float32)
        a = r.permutation(80)[: r.integers(5, 70)]
        b = np.unique(np.concatenate([r.permutation(a)[: max(1, int(len(a) * 0.95))], r.permutation(80)[:2]]))
        if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
            continue
        got = []
        for x in (a, b):
            x = x[np.argsort(universe[x])]
            got.append(ngram_join.prefix(universe[x], count[x], 90))
        assert len(np.intersect1d(got[0][0], got[1][0])) >= min(got[0][1], got[1][1])


@pytest.mark.parametrize(("parts", "held"), [(1, 1 << 20), (13, 1 << 20), (3, 5)])
def test_components(spark, monkeypatch, parts, held):
    monkeypatch.setattr(components, "HELD", held)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(200, 200 + i) for i in range(40)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts), store.new_folder(spark, "cc")).collect()}
    want = smallest({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), store.new_folder(spark, "cc")).count() == 0


def vectors(n, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, 16))
    return [(i, (base[i % 6] + r.normal(size=16) * 0.35).tolist(), int(i % 3)) for i in range(n)]


def brute_vectors(rows, least=0.93):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for (a, (_, x, k)), (b, (_, y, m)) in itertools.combinations(enumerate(ok), 2) if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least]
    low = smallest({i for i, *_ in rows}, [(ok[a][0], ok[b][0]) for a, b in links])
    n = Counter(x for e in links for x in e)
    count = defaultdict(list)
    for a, (i, *_) in enumerate(ok):
        count[i].append(n[a])
    return {i: (sorted(count[i] + [0] * (sum(r[0] == i for r in rows) - len(count[i]))), low[i], low[i] == i) for i in low}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors(150, 4)
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, [x * 2 for x in rows[0][1]], 0), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] * 16, 0), (507, [None] * 16, 0), (508, [], 0), (509, [1.0], 0), (510, [2.0], 0), (511, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert by_id(embed_dedup.deduplicate(df)) == brute_vectors(rows)


def by_id(found):
    out = {}
    for r in found.collect():
        n, c, k = out.setdefault(r.vec_id, ([], r.component_id, r.kept))
        n.append(r.n_links)
        assert (c, k) == (r.component_id, r.kept)
    return {i: (sorted(n), c, k) for i, (n, c, k) in out.items()}


@pytest.mark.parametrize("block", [2048, 3])
def test_vectors_of_repeated_ids(spark, monkeypatch, block):
    """An id's vectors have counts of their own and are one node."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    e = np.eye(6).tolist()
    rows = [(1, e[0], 0), (1, e[1], 0), (1, e[2], 0), (2, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0], 0), (5, e[1], 0), (5, e[3], 0), (9, e[3], 0), (8, e[4], 0), (8, e[4], 0), (7, e[4], 0), (4, e[5], 1), (4, e[5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("digest", F.lit("d")).withColumn("a", F.lit(1))
    assert by_id(embed_dedup.deduplicate(df)) == brute_vectors(rows)


def test_vectors_odd(spark):
    schema = "vec_id long, embedding array<float>, label int, unit int"
    assert embed_dedup.deduplicate(spark.createDataFrame([], schema)).count() == 0
    r = embed_dedup.deduplicate(spark.createDataFrame([(None, [1.0], 1, 2)], schema)).first()
    assert (r.vec_id, r.n_links, r.component_id, r.kept) == (None, 0, None, False)


def test_bound_is_rigorous():
    r = np.random.default_rng(1)
    for d in (3, 64, 1200):
        u = r.normal(size=(40, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for least in (-0.2, 0.0, 0.1):
            assert (embed_dedup.linked(u, u, least) == (np.einsum("ik,jk->ij", u, u) >= least)).all()
