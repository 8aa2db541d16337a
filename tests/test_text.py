import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import metrics as M
from lectern.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("x", "n1", "n2"), [("Compañía  de Jesús", "compañia de jesus", "compania  de jesus"), ("ÇANTO ÁÉ ñ", "çanto ae ñ", "canto ae n"), ("ﬁel", "ﬁel", "fiel"), ("niño á", "niño a", "nino a"), ("", "", "")])
def test_folding(spark, x, n1, n2):
    assert one(spark, T.normalise(F.col("a")), a=x) == n1
    assert one(spark, T.fold_all(F.col("a")), a=x) == n2


def test_tokens_and_wrapping(spark):
    assert one(spark, T.tokens(F.col("a")), a="  a\tb \n c ") == ["a", "b", "c"]
    assert one(spark, T.tokens(F.col("a")), a="") == []
    assert one(spark, T.wrapped(F.col("a"), 2), a="a b c d e") == ["a b", "c d", "e"]
    assert one(spark, T.wrapped(F.col("a"), 2), a="") == []
    assert "".join(one(spark, T.with_spaces(F.col("a")), a="a  b\t c ")) == "a  b\t c "
    assert one(spark, T.word_punct(F.col("a")), a="año, (dos)...") == ["año", ",", "(", "dos", ")..."]
    assert one(spark, T.words(F.col("a")), a="de-la 3 Ñandú!") == ["de", "la", "Ñandú"]


def test_variants(spark):
    assert sorted(one(spark, T.variants(F.col("a"), "uv"), a="Vua")) == sorted(["Vua", "Vva", "Uua", "Uva"])
    assert one(spark, T.variants(F.col("a"), "uv"), a="casa") == ["casa"]
    assert one(spark, T.variants(F.col("a"), "uv"), a="uuuuuu") == ["uuuuuu"]
    assert one(spark, T.variants(F.col("a"), "fs"), a="s") == ["f", "s"]


def test_edges(spark):
    assert [one(spark, c, a="(de-la),") for c in T.edges(F.col("a"))] == ["(", "de-la", "),"]


def test_guard_and_cleaning(spark):
    g = T.guarded(F.col("a"), F.col("b"))
    assert tuple(one(spark, g, a="a b", b="c d")) == ("c d", "success")
    assert tuple(one(spark, g, a="a b", b="c")) == ("a b", "word_count_mismatch")
    assert tuple(one(spark, g, a=" ", b="c")) == (" ", "empty_input")
    assert tuple(one(spark, T.guarded(F.col("a"), F.col("b"), 2), a="a b", b="c d e")) == ("c d e", "success")
    assert one(spark, T.without_fences(F.col("a")), a="```text\nabc\n```") == "abc"
    assert one(spark, T.without_fences(F.col("a")), a='"abc"') == "abc"
    assert one(spark, T.escape_html(F.col("a")), a="<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, T.retry_seconds(F.col("a"), F.lit(1)), a="retry in 30.5s") == 31.5
    assert one(spark, T.retry_seconds(F.col("a"), F.lit(2)), a="later") == 30.0
    assert one(spark, T.same_letters(F.col("a"), F.col("b")), a="Año.", b="año") is True
    assert one(spark, T.same_letters(F.col("a"), F.col("b")), a="año", b="ano") is False
    assert one(spark, T.snippet(F.col("a"), F.lit(3), F.lit(4), 2), a="ab\ncdef") == "b cde"


def test_metric_goldens(spark):
    v = {"a": "el rey mando que fe hizieffe", "b": "el Rey mando que se hiziesse"}
    a, b = F.col("a"), F.col("b")
    assert one(spark, M.char_distance(a, b), **v) == 4
    assert one(spark, M.char_distance(F.lower(a), F.lower(b)), **v) == 3
    assert one(spark, M.pair_char_rate(a, b), **v) == pytest.approx(4 / 23)
    assert one(spark, M.pair_word_rate(a, b), **v) == pytest.approx(3 / 6)
    assert one(spark, M.bag_cosine(a, b), **v) == pytest.approx(0.5)
    assert one(spark, M.sentence_bleu(a, b), **v) == pytest.approx(0.312394, abs=1e-6)
    assert one(spark, M.jaccard(a, b), **v) == pytest.approx(3 / 9)
    e = {"a": "", "b": ""}
    assert [one(spark, f(a, b), **e) for f in (M.jaccard, M.bag_cosine, M.sentence_bleu, M.pair_char_rate, M.pair_word_rate)] == [0, 1, 0, 0, 0]
    assert one(spark, M.bag_cosine(a, b), a="x", b="") == 0


def test_word_distances_agree(spark):
    r = random.Random(3)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(80)]

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(M.word_distance(F.col("a"), F.col("b")).alias("w"), M.array_distance(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(g.w, g.x) for g in got] == [(plain(*p),) * 2 for p in rows]


def test_spans(spark):
    got = one(spark, T.spans(F.col("a")), a="  uno\t dos ñ")
    assert [(s.token, s.start, s.end) for s in got] == [("uno", 2, 5), ("dos", 7, 10), ("ñ", 11, 12)]
    assert one(spark, T.spans(F.col("a")), a="") == []


def test_counted_metrics(spark):
    """Pooled BLEU and the cosine of counts, where grams repeat and where they don't."""
    rows = [("the the the cat", "the cat sat on the mat"), ("a b c d e f", "a b c d x f"), ("", "x y"), ("é ñ .", "é ñ.")]
    df = spark.createDataFrame(rows, "h string, r string")
    counts = df.select(M.bleu_counts(F.col("h"), F.col("r")).alias("c")).collect()
    for (h, r), c in zip(rows, counts, strict=True):
        x, y = (__import__("re").findall(r"\w+|[^\w\s]+", t) for t in (h, r))
        for n in range(1, 5):
            gx, gy = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
            assert (c.c[f"m{n}"], c.c[f"t{n}"]) == (sum((gx & gy).values()), sum(gx.values()))
    total = [sum(c.c[k] for c in counts) for k in ("h", "r", "m1", "t1", "m2", "t2", "m3", "t3", "m4", "t4")]
    want = min(1, math.exp(1 - total[1] / total[0])) * math.exp(sum(math.log(total[i] / total[i + 1]) for i in (2, 4, 6, 8)) / 4)
    assert df.select(M.bleu_counts(F.col("h"), F.col("r")).alias("c")).agg(M.corpus_bleu("c").alias("b")).first().b == pytest.approx(want)
    for h, r, cosine in (("The the cat", "the cat", (2 * 1 + 1) / (5**0.5 * 2**0.5)), ("a b", "c d", None), ("ab", "", 0.0), ("ab cd", "cd ef", 0.5)):
        assert one(spark, M.count_cosine(F.col("h"), F.col("r")), h=h, r=r) == (cosine if cosine is None else pytest.approx(cosine))
    assert one(spark, M.half_even(F.lit(0.03125), 4), h="") == 0.0312
    e = df.agg(*M.corpus_rates("h", "r")).first()
    assert e.wer == pytest.approx((4 + 1 + 2 + 2) / (6 + 6 + 2 + 2))


def test_counts_of_long_texts(spark):
    r = np.random.default_rng(11)
    rows = [([str(x) for x in r.integers(0, 9, n)], [str(x) for x in r.integers(0, 9, m)]) for n, m in ((0, 0), (1, 0), (3, 9), (70, 5), (200, 300))]
    df = spark.createDataFrame([*rows, (["a", "a"] * 50, ["b"] * 70 + ["a"] * 3), ([""] * 80, [""] * 7)], "x array<string>, y array<string>")
    got = df.select("x", "y", M.clipped(F.col("x"), F.col("y")).alias("n"), M._merged(F.col("x"), F.col("y")).alias("m")).collect()
    for g in got:
        assert g.n == g.m == (Counter(g.x) & Counter(g.y)).total()


def test_bleu_of_twenty_thousand_words(spark):
    r = np.random.default_rng(12)
    a = r.integers(0, 500, 20_000)
    b = np.where(r.random(20_000) < 0.1, 7, a)
    df = spark.createDataFrame([(" ".join(map(str, a)), " ".join(map(str, b)))], "a string, b string")
    began = time.time()
    assert 0.6 < df.select(M.sentence_bleu(F.col("a"), F.col("b")).alias("s")).first().s < 0.8
    assert time.time() - began < 30
