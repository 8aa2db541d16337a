"""Language identification: multinomial naive Bayes over hashed character n-grams of one to three characters.

The counts of each language's n-grams are arrays of fixed size, summed over all labelled documents.  The matrix of log
probabilities is broadcast: its size is languages x buckets x 4 bytes, whatever the corpus.  Batches are scored by array
operations over the n-grams that occur.

A posterior alone tells one learned language from another, not from the rest: it nears 1 after a few words of anything.
`fit_floors` adds, for each language, the least mean log probability per n-gram that a text of it may have, from labelled
texts that the judging model hasn't seen; `keep` then rejects texts in no learned language and letter soup.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if no document has a label;
texts of any length count whole; rows with a null id are scored like others, and repeated rows count and are scored each;
ties go to the language first in order; an empty table gives an empty one; other columns are ignored by `identify` and pass
`keep` unchanged, whatever they are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, text

BITS = 16
ORDERS = (1, 2, 3)
ALPHA = 0.1
UND = "und"
MAX_LANGS = 1000
#: A text may have MARGIN nats an n-gram less than the median held-out text of its language, or FACTOR times the distance
#: from that median to the lower quartile where this is more; a text of n n-grams may have SLACK / sqrt(n) less still.
MARGIN, FACTOR, SLACK = 1.25, 3.0, 6.0
#: Held-out texts are counted by mean log probability, in so many steps a nat and as many steps in all.
STEP, STEPS = 32, 1024


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, where each text's begin (and the end), and whether it has a letter."""
    low = [t.lower() if t else "" for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in low], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    letter = np.concatenate([[0], np.cumsum(text.letters()[cp])])
    has = letter[at[1:]] > letter[at[:-1]]
    n = len(cp)
    left = np.repeat(at[1:], size) - np.arange(n)
    out = np.full((n, len(ORDERS)), -1, np.int32)
    wide = cp.astype(np.uint64)
    for j, k in enumerate(ORDERS):
        if n < k:
            continue
        x = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ wide[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        bucket = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        out[: n - k + 1, j] = np.where(left[: n - k + 1] >= k, bucket, -1)
    keep = out >= 0
    begin = np.concatenate([[0], np.cumsum(keep.sum(1))])[at]
    return out[keep], begin, has


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.logs, self.prior = langs, logs, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the likeliest language, its probability, its number, its mean log probability an n-gram, the n-grams."""
        n = len(texts)
        if not self.langs:
            return [UND] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        bucket, begin, has = grams(texts)
        size = np.diff(begin)
        score = np.tile(self.prior, (n, 1))
        full = np.flatnonzero(size)
        if len(full):
            for j in range(len(self.langs)):
                score[full, j] += np.add.reduceat(self.logs[j][bucket], begin[full], dtype=np.float64)
        best = score.argmax(1)
        p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        mean = (score[np.arange(n), best] - self.prior[best]) / np.maximum(size, 1)
        return [self.langs[b] if h else UND for b, h in zip(best, has, strict=True)], np.where(has, p, 0.0), best, mean, size


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count over all rows that `train` selects whose text and language are not null."""
    return _model(_counts(_labelled(docs, train, text_col, lang_col)))


def _labelled(docs: DataFrame, train: Column, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), train.alias("t")).where("t and text is not null and lang is not null").drop("t")


def _counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """By `lang`: how often each bucket occurs, and the number of rows."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch, _, _ in text.pieces(batches):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            bucket, begin, _ = grams(batch.column("text").to_pylist())
            seen = np.bincount((np.repeat(code, np.diff(begin)) << BITS) + bucket, minlength=len(names) << BITS).reshape(len(names), -1)
            for i, k in enumerate(names):
                a = total.setdefault(k, np.zeros((1 << BITS) + 1, np.int64))
                a[:-1] += seen[i]
                a[-1] += int((code == i).sum())
        if total:
            yield arrays.rows(total)

    return arrays.collected(rows.mapInArrow(count, arrays.ROWS), (1 << BITS) + 1)


def _model(counts: dict[str, np.ndarray], most: int = MAX_LANGS) -> Model:
    langs = sorted(counts)
    if len(langs) > most:
        raise ValueError(f"{len(langs)} languages; the broadcast matrix is bounded at {most}")
    c = np.array([counts[k] for k in langs], np.float64).reshape(len(langs), (1 << BITS) + 1)
    logs = np.log((c[:, :-1] + ALPHA) / (c[:, :-1].sum(1, keepdims=True) + ALPHA * (1 << BITS))) if langs else np.zeros((0, 1))
    return Model(langs, logs.astype(np.float32), np.log(c[:, -1] / c[:, -1].sum()) if langs else np.zeros(0))


def fit_floors(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[Model, np.ndarray]:
    """The model of `fit`, and for each of its languages the least mean log probability an n-gram, before SLACK.

    Labelled texts are halved by a hash of the text, so that copies stay together, and each is scored in its own language
    by the counts of the other half alone: every one is held out once.  The floor of a language is the median of these less
    the larger of MARGIN and FACTOR times the distance to the lower quartile; a quarter of bad texts does not move it.  A
    language seen in one half only is judged by an untrained model, whose floor lets nearly everything through.
    """
    rows = _labelled(docs, train, text_col, lang_col)
    rows = rows.withColumn("lang", F.concat(F.pmod(F.xxhash64("text"), F.lit(2)).cast("string"), "lang"))
    counts = _counts(rows)
    whole: dict[str, np.ndarray] = {}
    for k, c in counts.items():
        whole[k[1:]] = whole[k[1:]] + c if k[1:] in whole else c
    model, half = _model(whole), _model(counts, 2 * MAX_LANGS)
    at = {k: i for i, k in enumerate(half.langs)}
    # the last row is of a language that the other half lacks
    logs = np.vstack([half.logs, np.full((1, 1 << BITS), -BITS * np.log(2), np.float32)]) if at else np.zeros((1, 1 << BITS), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((at, logs))

    def held(batches):
        at, logs = shared.value
        total: dict[str, np.ndarray] = {}
        for batch, _, _ in text.pieces(batches):
            langs = batch.column("lang").to_pylist()
            bucket, begin, has = grams(batch.column("text").to_pylist())
            size = np.diff(begin)
            row = np.array([at.get("10"[int(k[0])] + k[1:], len(logs) - 1) for k in langs])
            value = np.concatenate([[0.0], np.cumsum(logs[np.repeat(row, size), bucket], dtype=np.float64)])
            mean = (value[begin[1:]] - value[begin[:-1]]) / np.maximum(size, 1)
            step = np.clip(np.ceil(-mean * STEP), 0, STEPS - 1).astype(np.int64)
            for k, i in zip(langs, np.where(has, step, -1).tolist(), strict=True):
                if i >= 0:
                    total.setdefault(k[1:], np.zeros(STEPS, np.int64))[i] += 1
        if total:
            yield arrays.rows(total)

    seen = arrays.collected(rows.mapInArrow(held, arrays.ROWS), STEPS)
    floors = np.full(len(model.langs), -BITS * np.log(2) - MARGIN)
    for j, k in enumerate(model.langs):
        if k in seen:
            c = np.cumsum(seen[k])
            median, low = (-int(np.searchsorted(c, c[-1] * q)) / STEP for q in (0.5, 0.75))
            floors[j] = median - max(MARGIN, FACTOR * (median - low))
    return model, floors


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def score(batches):
        for batch, _, _ in text.pieces(batches):
            lang, p = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"`{id_col}` {kind}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, langs: list[str] | None = None, text_col: str = "text", floors: np.ndarray | None = None) -> DataFrame:
    """The rows, all columns unchanged, whose language is told with probability `least` (and is one of `langs`).

    With the floors of `fit_floors`, the text must also be as likely in that language as its floor asks for.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, floors))

    def chosen(batches):
        model, floors = shared.value
        for batch, _, _ in text.pieces(batches, text_col):
            lang, p, best, mean, size = model.judged(batch.column(text_col).to_pylist())
            likely = np.ones(len(lang), bool) if floors is None or not len(floors) else mean >= floors[best] - SLACK / np.sqrt(np.maximum(size, 1))
            yield batch.filter(pa.array([k != UND and q >= least and bool(x) and (langs is None or k in langs) for k, q, x in zip(lang, p, likely, strict=True)], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)
