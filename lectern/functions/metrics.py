"""Column functions that compare a hypothesis with a reference.  Same-named rates differ in what they divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokens, word_punct

#: So many distinct words of a pair get a character each; more go through the array distance.
ALPHABET = 180
#: N-grams of a text that are counted one by one; more are sorted.
LONG = 64


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def array_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays, row by row of the table; only one row is held."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(previous, x):
        # state: the row so far, whose last entry is the left neighbour
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.element_at(previous, 1) + 1),
            lambda out, j: F.concat(out, F.array(F.least(F.element_at(out, -1) + 1, F.element_at(previous, j + 1) + 1, F.element_at(previous, j) + F.when(F.element_at(b, j) == x, 0).otherwise(1)))),
        )

    full = F.element_at(F.aggregate(a, first, row), -1)
    return F.when(F.size(b) == 0, F.size(a)).when(F.size(a) == 0, F.size(b)).otherwise(full)


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: each distinct word becomes a character for the native function."""

    def of(x, y, known):
        coded = lambda z: F.array_join(F.transform(z, lambda w: F.chr(F.array_position(known, w) + 40)), "")
        return F.when(F.size(known) <= ALPHABET, F.levenshtein(coded(x), coded(y))).otherwise(array_distance(x, y))

    return let(of, x=a, y=b, known=F.array_distinct(F.concat(a, b)))


def line_rate(distance: Column, reference: Column) -> Column:
    """Distance by the reference's length, at least 1; over 1 where much was inserted."""
    return distance / F.greatest(F.length(reference), F.lit(1))


def no_space(x: Column) -> Column:
    return F.translate(x, " \n", "")


def pair_char_rate(a: Column, b: Column) -> Column:
    """Distance without spaces by the longer length: symmetric, at most 1, 0 for two empty ones."""
    return F.levenshtein(no_space(a), no_space(b)) / F.greatest(F.length(no_space(a)), F.length(no_space(b)), F.lit(1))


def pair_word_rate(a: Column, b: Column) -> Column:
    return word_distance(tokens(a), tokens(b)) / F.greatest(F.size(tokens(a)), F.size(tokens(b)), F.lit(1))


def _grams(x: Column, n: int) -> Column:
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.array_join(F.slice(x, i, F.lit(n)), "\x01"))).otherwise(F.array().cast("array<string>"))


def _times(x: Column, g: Column) -> Column:
    return F.size(F.filter(x, lambda y: y == g))


def _merged(x: Column, y: Column) -> Column:
    """The sum over n-grams of the lesser of both counts, by one sort of both sides and one pass: for long texts."""
    tagged = lambda a, side: F.transform(a, lambda g: F.struct(g.alias("g"), F.lit(side).alias("s")))
    lesser = lambda acc: F.least(acc["x"], acc["y"])

    def step(acc, v):
        same = acc["g"] == v["g"]
        more = lambda k, add: (F.when(same, acc[k]).otherwise(0) + add).alias(k)
        return F.struct(v["g"].alias("g"), more("x", 1 - v["s"]), more("y", v["s"]), (acc["n"] + F.when(same, 0).otherwise(lesser(acc))).alias("n"))

    start = F.struct(F.lit("").alias("g"), *[F.lit(0).alias(k) for k in ("x", "y", "n")])
    return F.aggregate(F.array_sort(F.concat(tagged(x, 0), tagged(y, 1))), start, step, lambda acc: acc["n"] + lesser(acc))


def clipped(gh: Column, gr: Column) -> Column:
    """How many of the n-grams gh are matched in gr, each as often as it is there; grams that come once need no counting."""

    def counted(x, y):
        return F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(_times(x, g), _times(y, g)))

    few = F.when(F.size(gh) <= LONG, counted(gh, gr)).otherwise(_merged(gh, gr))
    return F.when(F.size(F.array_distinct(gh)) == F.size(gh), F.size(F.array_intersect(gh, gr))).otherwise(few)


def bleu_counts(hypothesis: Column, reference: Column) -> Column:
    """What corpus_bleu sums: lengths of both sides in words and marks, and matches and totals of orders 1 to 4."""

    def of(h, r):
        parts = [F.size(h).alias("h"), F.size(r).alias("r")]
        for n in range(1, 5):
            parts += [let(lambda gh, gr: clipped(gh, gr), gh=_grams(h, n), gr=_grams(r, n)).alias(f"m{n}"), F.greatest(F.size(h) - (n - 1), F.lit(0)).alias(f"t{n}")]
        return F.struct(*parts)

    return let(of, h=word_punct(hypothesis), r=word_punct(reference))


def corpus_bleu(counts: str) -> Column:
    """BLEU of a group of lines from the sums of their `bleu_counts`: orders 1 to 4 pooled, not smoothed; 0 where one has no match."""
    total = lambda k: F.sum(F.col(f"{counts}.{k}"))
    logs = sum((F.log(total(f"m{n}") / total(f"t{n}")) for n in range(1, 5)), F.lit(0.0))
    none = F.least(*[total(f"m{n}") for n in range(1, 5)]) == 0
    short = F.least(F.lit(1.0), F.exp(1.0 - total("r") / total("h")))
    return F.when(none, 0.0).otherwise(short * F.exp(logs / 4))


def sentence_bleu(hypothesis: Column, reference: Column) -> Column:
    """Orders 1 to 4, clipped counts, one added to matches and totals, short hypotheses discounted; 0 if one is empty."""

    def order(gh, gr):
        return F.log((clipped(gh, gr) + 1.0) / (F.greatest(F.size(gh), F.lit(1)) + 1.0))

    def of(h, r):
        logs = F.lit(0.0)
        for n in range(1, 5):
            logs = logs + let(order, gh=_grams(h, n), gr=_grams(r, n))
        short = F.least(F.lit(1.0), F.exp(1.0 - F.size(r) / F.greatest(F.size(h), F.lit(1))))
        return F.when((F.size(h) == 0) | (F.size(r) == 0), 0.0).otherwise(short * F.exp(logs / 4))

    return let(of, h=tokens(hypothesis), r=tokens(reference))


def _cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays' counts, null if one is empty."""
    plain = lambda z: F.size(F.array_distinct(z)) == F.size(z)
    square = lambda z: F.when(plain(z), F.size(z)).otherwise(F.aggregate(F.array_distinct(z), F.lit(0), lambda acc, w: acc + _times(z, w) * _times(z, w)))
    dot = F.when(plain(x) & plain(y), F.size(F.array_intersect(x, y))).otherwise(F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, w: acc + _times(x, w) * _times(y, w)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), dot / (F.sqrt(square(x).cast("double")) * F.sqrt(square(y).cast("double"))))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of word counts; 1 if both are empty, 0 if one is."""
    return let(lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(_cosine(x, y), F.lit(0.0))), x=tokens(a), y=tokens(b))


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of counts of lower-cased words of two characters and more; 0 if one side has none, null if both have none."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return let(lambda x, y: F.when((F.size(x) > 0) | (F.size(y) > 0), F.coalesce(_cosine(x, y), F.lit(0.0))), x=words(a), y=words(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct words; 0 if both are empty."""
    x, y = tokens(a), tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def bundle(a: Column, b: Column) -> Column:
    """The pairwise metrics together, rounded to four places for display."""
    parts = {"cer": pair_char_rate(a, b), "wer": pair_word_rate(a, b), "cosine": bag_cosine(a, b), "bleu": sentence_bleu(a, b), "jaccard": jaccard(a, b)}
    return F.struct(*[half_even(v, 4).alias(k) for k, v in parts.items()])


def count_bundle(a: Column, b: Column) -> Column:
    """The pairwise rates with the cosine of counts, rounded to four places for display."""
    parts = {"cer": pair_char_rate(a, b), "wer": pair_word_rate(a, b), "cosine": count_cosine(a, b)}
    return F.struct(*[half_even(v, 4).alias(k) for k, v in parts.items()])


def half_even(x: Column, places: int) -> Column:
    """Rounded to the nearest, ties (of the shortest decimal that names the number) to even."""
    return F.bround(x.cast("decimal(38,20)"), places).cast("double")


def corpus_rates(a: str, b: str) -> list[Column]:
    """Aggregates of a table of lines: summed edits by summed reference units, for characters and for words."""
    words = lambda c: tokens(F.col(c))
    return [
        micro(char_distance(F.col(a), F.col(b)), F.length(b)).alias("cer"), micro(word_distance(words(a), words(b)), F.size(words(b))).alias("wer"),
    ]


def micro(edits: Column, lengths: Column) -> Column:
    """Summed edits by summed lengths."""
    return F.coalesce(F.sum(edits), F.lit(0)) / F.greatest(F.coalesce(F.sum(lengths), F.lit(0)), F.lit(1))


def macro(rates: Column) -> Column:
    """Mean of per-line rates, 0 over no lines; rounded so that the order of addition does not show."""
    return F.round(F.coalesce(F.avg(rates), F.lit(0.0)), 9)
