"""Cosine similarity of hypothesis and reference by TF-IDF over words or character n-grams, text by text or as explode, group and join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: Bytes of terms, with 16 for each, that are sent to every task.
SENT = 8 << 20
#: Texts whose terms are weighed at once.
ROWS = 64


def word_terms(x: Column) -> Column:
    """Lower-cased words of two characters and more."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def char_terms(x: Column, least: int = 2, most: int = 4) -> Column:
    """Character n-grams inside words, each word with a space on either side."""
    padded = F.transform(F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w, n):
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(least, most + 1)])))


def _by_rows(texts: DataFrame, key: str, seen: pa.Table, n: int) -> DataFrame:
    """key and cosine of rows (key, s, t) with the terms of either side; seen: every term and its df.  Nothing is shuffled."""
    idf, known = np.log((1 + n) / (1 + seen["df"].to_numpy())) + 1, seen["term"].combine_chunks()
    name, kind = texts.schema[key].name, texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                size = [pc.fill_null(pc.list_value_length(part.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("s", "t")]
                coded = pa.concat_arrays([part.column(c).flatten() for c in ("s", "t")]).dictionary_encode()
                kinds, m = len(coded.dictionary), part.num_rows
                weight = idf[pc.index_in(coded.dictionary, known).to_numpy(zero_copy_only=False)] if kinds else np.zeros(0)
                place = np.repeat(np.tile(np.arange(m), 2), np.concatenate(size)) * kinds + coded.indices.to_numpy(zero_copy_only=False)
                x, y = (np.bincount(p, minlength=m * kinds).reshape(m, kinds) * weight for p in np.split(place, [size[0].sum()]))
                xy, xx, yy = ((p * q).sum(1) for p, q in ((x, y), (x, x), (y, y)))
                both = (xx > 0) & (yy > 0)
                cosine = np.divide(xy, np.sqrt(xx) * np.sqrt(yy), out=np.zeros(m), where=both)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(cosine)], names=[key, "cosine"])

    return texts.mapInArrow(run, f"`{name}` {kind}, cosine double")


def cosines(rows: DataFrame, key: str, a: str, b: str, terms) -> DataFrame:
    """key, once each, and cosine: weights are counts times ln((1 + n) / (1 + df)) + 1, fitted on both sides together.

    0 where a side has no term; rows that repeat a key are one text.  How many texts hold a term is counted from each text's distinct
    terms and stored.  Up to SENT bytes of terms go to all tasks, which weigh a text's terms where they read it; more are joined
    from stored tables, where Spark splits a term that many texts hold.
    """
    folder = shared.new_folder(rows.sparkSession, "tfidf")
    found = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if found.most > 1:
        of = lambda c: F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: terms(x)))
        texts = rows.groupBy(key).agg(F.collect_list(a).alias("s"), F.collect_list(b).alias("t")).select(key, of("s").alias("s"), of("t").alias("t"))
    else:
        texts = rows.select(key, terms(F.col(a)).alias("s"), terms(F.col(b)).alias("t"))
    none = F.array().cast("array<string>")
    each = F.concat(*(F.coalesce(F.array_distinct(c), none) for c in ("s", "t")))
    df = shared.saved(texts.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("df")), folder, "terms")
    n = 2 * found.n
    if df.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("bytes")).first().bytes <= SENT:
        return _by_rows(texts, key, df.toArrow(), n)
    idf = df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    one = lambda side, c: texts.select(key, F.lit(side).alias("side"), F.explode(c).alias("term"))
    tf = one(0, "s").unionAll(one(1, "t")).groupBy(key, "side", "term").agg(F.count("*").alias("tf"))
    met = shared.saved(tf, folder, "counts").join(idf, "term")
    w = met.groupBy(key, "term").agg(F.sum(F.when(F.col("side") == 0, F.col("tf") * F.col("idf"))).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("tf") * F.col("idf"))).alias("y"))
    s = w.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return rows.select(key).distinct().join(s, key, "left").select(key, F.coalesce(F.col("dot") / (F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)).alias("cosine"))
