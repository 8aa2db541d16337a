"""Quality by importance: the ratio of two hashed n-gram models, of target text and of raw text, sampled by Gumbel top-k.

Both models are arrays of fixed size that count hashed words, word pairs and three-byte grams: the raw one over all
documents, the target one over labelled good ones.  Nothing else enters a document's importance: it is that of `temper`
n-grams of its mean log ratio, whatever its length, so a long text of one kind weighs no more than a short one.  Adding to
each log importance a Gumbel number, hashed from its id, and taking the k largest samples k documents without replacement in
proportion to importance.  A smaller `temper` draws more evenly; `effective_size` says of how many equal documents the
weights are worth.  k is a count or a share of all rows; by default the share of good ones among the labels, and one standard
error of it.  The k-th largest key is found by counting digits of the keys, in a few passes over narrow rows; nothing is
sorted or gathered.

Defined cases: a text without n-grams (null, empty) has log importance 0; texts of any length count whole; a document's key
depends on its id and text alone, so repeated rows share it; all rows whose key is the k-th largest are in the sample, so it
has more than k rows where some tie there; a null id hashes as the word null; without labels every document is kept, and none
is preferred without good ones; an empty table gives an empty one; other columns are ignored, and pass through unchanged
where whole rows are asked for, whatever they are named.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, text
from .mixing import uniform

BITS = 16
#: Labelled good documents that are used at most: those whose ids hash lowest.
SAMPLE = 20_000
PRIOR = 5.0
#: The number of n-grams that a document's mean log ratio counts for.
TEMPER = 256.0
KINDS = 3
U = np.uint64


def grams(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams and where each row's begin (and the end): words, pairs of words, grams of three bytes."""
    h, count = text.word_hashes(data, at)
    edge = np.concatenate([[0], np.cumsum(count)])
    shift = U(64 - BITS)
    out = [((h >> shift).astype(np.int32), edge)]
    two = text.mix(h[:-1] * U(3) + h[1:])
    two[h[:-1] == h[1:]] = U(0)
    for x, edge, k in (((two >> shift).astype(np.int32), edge, 1), (_three(data), at, 2)):
        inside = np.ones(len(x), bool)
        for b in range(1, k + 1):
            last = edge[1:-1] - b
            inside[last[(last >= 0) & (last < len(x))]] = False
        size = np.maximum(np.diff(edge) - k, 0)
        out.append((x[inside] + np.int32(k << BITS), np.concatenate([[0], np.cumsum(size)])))
    return out


def _three(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    x = (d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - BITS)).astype(np.int32)


class Model:
    """Log ratios of buckets, the share of good documents among labelled ones, and the tempering."""

    def __init__(self, ratio: np.ndarray, share: float = 1.0, temper: float = TEMPER):
        self.ratio, self.share, self.temper = ratio, share, temper

    def weight(self, mean: np.ndarray) -> np.ndarray:
        """Log importance of each row."""
        return self.temper * mean

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each row, and its number of n-grams.  The kinds of n-gram weigh alike."""
        total, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        for bucket, edge in grams(data, at):
            size = np.diff(edge)
            full = np.flatnonzero(size)
            if len(full):
                total[full] += np.add.reduceat(self.ratio[bucket], edge[full])
            n += size
        return total / np.maximum(n, 1), n


def labels_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Ids and labels; an id with both is bad."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__i")).agg(F.min(F.col(label_col)).cast("int").alias("__q"))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target to raw probability in each bucket, drawn towards 0 where the target is expected to have few counts."""
    t, r = (a.reshape(KINDS, -1).astype(np.float64) for a in (target, raw))
    expected = r * (t.sum(1, keepdims=True) / np.maximum(r.sum(1, keepdims=True), 1))
    return np.log((t + PRIOR) / (expected + PRIOR)).ravel()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, temper: float = TEMPER) -> Model:
    """Count both models in one pass over all documents; target text are at most `most` labelled good ones."""
    one = labels_of(labels, id_col, label_col)
    n, good = one.agg(F.count("*"), F.coalesce(F.sum("__q"), F.lit(0))).first()
    share = min(1.0, good / n + (good / n * (1 - good / n) / n) ** 0.5) if n else 1.0
    target = F.broadcast(one.where("__q = 1").orderBy(F.xxhash64("__i"), "__i").limit(most))
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    marked = rows.join(target, "__i", "left").select("text", "__q")

    def count(batches):
        total = {k: np.zeros(KINDS << BITS, np.int64) for k in ("raw", "target")}
        for batch, data, at in text.pieces(batches):
            good = np.array([q == 1 for q in batch.column("__q").to_pylist()])
            for bucket, edge in grams(data, at):
                total["raw"] += np.bincount(bucket, minlength=KINDS << BITS)
                total["target"] += np.bincount(bucket[np.repeat(good, np.diff(edge))], minlength=KINDS << BITS)
        yield arrays.rows(total)

    got = arrays.collected(marked.mapInArrow(count, arrays.ROWS), KINDS << BITS)
    if "target" not in got or "raw" not in got:
        return Model(np.zeros(KINDS << BITS), share if n else 1.0, temper)
    return Model(log_ratio(got["target"], got["raw"]), share, temper)


def _noise(ident: Column, seed: int) -> Column:
    """A Gumbel number that the id and the seed give."""
    u = (uniform(F.lit("gumbel"), ident.cast("string"), F.lit(str(seed))) * float(1 << 52) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scored(docs: DataFrame, model: Model, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams, log_ratio (mean), log_weight and gumbel_key of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def score(batches):
        for batch, data, at in text.pieces(batches):
            s, n = shared.value.score(data, at)
            w = shared.value.weight(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s), pa.array(w), pa.array(w + batch.column(2).to_numpy())], names=[id_col, "n_grams", "log_ratio", "log_weight", "gumbel_key"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), _noise(F.col(id_col), seed).alias("noise")).mapInArrow(score, f"`{id_col}` {kind}, n_grams long, log_ratio double, log_weight double, gumbel_key double")


def sampled(docs: DataFrame, model: Model, end: Cut, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the sample that `end` closes, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = T.StructType([T.StructField("row", docs.schema), T.StructField("key", T.DoubleType())])

    def with_text(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pc.struct_field(b.column(0), [text_col])], names=["row", "noise", "text"])

    def score(batches):
        for batch, data, at in text.pieces(with_text(batches)):
            w = shared.value.weight(shared.value.score(data, at)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w + batch.column(1).to_numpy())], names=["row", "key"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _noise(F.col(id_col), seed).alias("noise"))
    return rows.mapInArrow(score, row).where(end.holds(F.col("key"))).select("row.*")


def in_order(key: Column) -> Column:
    """The key in billionths, as a long: what orders the sample."""
    return F.round(key * 1e9).cast("long")


def kth_largest(rows: DataFrame, key_col: str, k: int, digit: int = 16) -> int | None:
    """The k-th largest of a long column, digit by digit from the top: each pass counts at most 2**digit values."""
    if k <= 0:
        return None
    chosen, left, prefix = rows.select(F.col(key_col).alias("x")), k, None
    for shift in range(64 - digit, -1, -digit):
        part = chosen if prefix is None else chosen.where(F.shiftright("x", shift + digit) == prefix)
        counts = sorted(((r.d, r.n) for r in part.groupBy(F.shiftright("x", shift).alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 2**digit rows
        for d, n in counts:
            if n >= left:
                prefix = d
                break
            left -= n
        else:
            return None
    return prefix


class Cut:
    """Where the sample of k rows ends: keys from `key` on are in; all, or none, where there is no such key."""

    def __init__(self, key: int | None, k: int):
        self.key, self.k = key, k

    def holds(self, key: Column) -> Column:
        return F.lit(self.k > 0) if self.key is None else F.coalesce(in_order(key) >= self.key, F.lit(False))


def cut(scores: DataFrame, k: int | None = None, share: float = 1.0) -> Cut:
    """The end of the k largest keys; without k, of a share of all rows."""
    if k is None:
        k = math.ceil(share * scores.count())
    return Cut(kth_largest(scores.select(in_order(F.col("gumbel_key")).alias("x")), "x", k), k)


def effective_size(scores: DataFrame) -> float:
    """The square of the sum of the weights by the sum of their squares: as many documents if all weigh alike, one if one weighs all."""
    top = scores.agg(F.max("log_weight")).first()[0]
    if top is None:
        return 0.0
    w = F.exp(F.col("log_weight") - top)
    total, squares = scores.agg(F.sum(w), F.sum(w * w)).first()
    return total * total / squares
