"""Scoring by an interpolated modified Kneser-Ney model of n-grams, counted in Spark and mapped into workers' memory.

Counting: each task reduces its own text to distinct n-grams with counts, cut by hash into ranges; a range's parts meet in
one task, which writes the range as sorted hash arrays.  What the n-grams say about the grams one word shorter (how often
these end one, and as contexts their followers' counts, and how many followers they have once, twice and more) is again
reduced by task before it is dealt by the shorter gram's hash, and so on down to words.  A hot word is so a row of each
task at most.  Scoring: workers map the arrays of the ranges into memory, and each chunk of text looks up its distinct
grams in order.

With k words, c the count (of the longest grams) or the number of distinct words before it (of shorter ones), h the context:
p(w|h) = max(c(hw) - D(c), 0) / c(h) + (D1 n1(h) + D2 n2(h) + D3 n3+(h)) / c(h) * p(w|h less its first word), and for a single
word the last term is by 1 / (V + 1), V the number of distinct training tokens.  The order is a parameter, two by default,
because pairs are what fits the disk limit: see the README.

Defined cases: a null or empty text is one end token; an unseen context gives the shorter one's probability; an unseen word
has the last term alone; an empty training set leaves the uniform model; a null id is scored, and trained on unless `train`
says no (null is no); repeated rows count and score each; texts of any length count whole; an empty table gives an empty
one; other columns are ignored, whatever they are named.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

U = np.uint64
END = U(0xE0D5E0D5E0D5E0D5)
BEGIN = U(0xBE61BE61BE61BE61)
#: Tokens that a task gathers before it reduces them to distinct n-grams, and n-grams of a range before it adds them up.
GATHER, MERGE = 3 << 19, 1 << 18
#: Bytes of input for each range of hashes; a range's arrays are a few times that.
RANGE_BYTES = 8 << 20
#: Ranges at most, and those whose arrays a worker has mapped at a time.
RANGES, MAPS = 1 << 20, 1 << 12
LEAST = 0.1
STATS = ("raw", "cont", "total", "one", "two", "more")
RECORD = np.dtype([(k, "<i8") for k in STATS])


def tokens(data: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each token (ends included) and the order - 1 before it (or the begin mark), and each row's tokens."""
    h, count = text.word_hashes(data, at)
    w = np.insert(h, np.cumsum(count), END)
    n = count + 1
    place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    words = [w]
    for j in range(1, order):
        before = np.full(len(w), BEGIN, U)
        before[j:][place[j:] >= j] = w[:-j][place[j:] >= j]
        words.insert(0, before)
    return words, n


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    out = words[0]
    for w in words[1:]:
        out = text.mix(out * U(0x9E3779B97F4A7C15) + w)
    return out


def add_up(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct grams in the order of their hashes, and the sums of their values."""
    if not len(words[0]):
        return words, [v.astype(np.int64) for v in values]
    order = np.argsort(gram_hash(words))
    words = [w[order] for w in words]
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    return [w[first] for w in words], [np.add.reduceat(v[order], first, dtype=np.int64) for v in values]


class Sums:
    """Adds up grams with their values as they come; holds little more than the distinct ones."""

    def __init__(self, least: int):
        self.least, self.parts, self.size, self.done = least, [], 0, 0

    def add(self, words: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.parts.append((words, values))
        self.size += len(words[0])
        if self.size >= max(self.least, 2 * self.done):
            self.reduce()

    def reduce(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if len(self.parts) > 1 or not self.done:  # a single part needn't be in the order of hashes
            columns = [*map(np.concatenate, zip(*[[*w, *v] for w, v in self.parts], strict=True))]
            k = len(self.parts[0][0])
            self.parts = []
            self.parts = [add_up(columns[:k], columns[k:])]
            self.size = self.done = len(self.parts[0][0][0])
        return self.parts[0]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _width(v: np.ndarray) -> int:
    """The least bytes that hold each of these numbers."""
    return next(x for x in (1, 2, 4, 8) if x == 8 or int(v.max(initial=0)) < 1 << 8 * x)


def _record(widths: bytes) -> np.dtype:
    """A gram's entry in its file, whose last bytes are these widths: the count, or a shorter gram's numbers."""
    return np.dtype(f"<u{widths[0]}") if len(widths) == 1 else np.dtype([(k, f"<u{x}") for k, x in zip(STATS, widths, strict=True)])


def _pack(words: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Words, then each column of values in its narrowest width, behind the number of words to a gram and the widths."""
    widths = [_width(v) for v in values]
    head = bytes([len(words), len(values), *widths])
    return b"".join([head, *[w.tobytes() for w in words], *[v.astype(f"<u{x}").tobytes() for v, x in zip(values, widths, strict=True)]])


def _unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    k, m = blob[:2]
    widths = [8] * k + [*blob[2 : 2 + m]]
    at = 2 + m
    n = (len(blob) - at) // sum(widths)
    out = []
    for x in widths:
        out.append(np.frombuffer(blob, f"<u{x}", n, at))
        at += n * x
    return out[:k], [v.astype(np.uint32) if v.itemsize < 8 else v.astype(np.int64) for v in out[k:]]


#: Rows of a stage: parts of a range (data), or what a finished range of grams of `length` words is (file and its counts).
COUNTS = ("grams", "c1", "c2", "c3", "c4", "tokens", "words")
ROWS = "range int, data binary, length int, file binary, " + ", ".join(f"{k} long" for k in COUNTS)
NAMES = ["range", "data", "length", "file", *COUNTS]


def _parts(words: list[np.ndarray], values: list[np.ndarray], ranges: int):
    """A row for each range of the grams; within one, ordered by the first word, so that equal contexts compress."""
    r = _range_of(gram_hash(words), ranges)
    order = np.lexsort((words[0], r))
    edge = np.searchsorted(r[order], np.arange(ranges + 1))
    for i in np.flatnonzero(np.diff(edge)).tolist():
        at = order[edge[i] : edge[i + 1]]
        blob = _pack([w[at] for w in words], [v[at] for v in values])
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * len(COUNTS)], names=NAMES)


def _finished(number: int, k: int, name: bytes, counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([name], pa.binary()), *[pa.array([int(counts.get(k, 0))], pa.int64()) for k in COUNTS]], names=NAMES)


def _by_range(batches, finished: list[pa.RecordBatch]):
    """Ranges of a partition that is sorted by range, one after another, added up.

    Rows of longer grams' finished ranges, at most one for each length and range, are put into `finished`.
    """
    now, sums = None, None
    for b in batches:
        if (done := b.column("file").is_valid()).true_count:
            finished.append(b.filter(done))
            b = b.filter(b.column("file").is_null())
        for i, blob in zip(b.column("range"), b.column("data"), strict=True):
            if (i := i.as_py()) != now:
                if sums is not None:
                    yield now, *sums.reduce()
                now, sums = i, Sums(MERGE)
            sums.add(*_unpack(blob.as_py()))
    if sums is not None:
        yield now, *sums.reduce()


def _file(folder: str, order: int, number: int, name: bytes) -> str:
    return f"{folder}/{order}/{number}-{name.hex()}.bin"


class Model:
    """What the driver keeps: names of the arrays of each length of gram, 16 bytes a range, and a few sums.

    The arrays stay in the shared folder.
    """

    def __init__(self, folder: str, order: int, ranges: int, names: dict[int, np.ndarray], sums: dict[int, dict[str, int]]):
        self.folder, self.order, self.ranges, self.names, self.sums = folder, order, ranges, names, sums

    @staticmethod
    def discounts(n: list[int]) -> tuple[float, float, float]:
        """Chen and Goodman's three discounts from the numbers of n-grams seen once to four times, kept within LEAST..k.

        So no word has probability 0, however odd the numbers of a small corpus are.
        """
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], LEAST), float(k)) if n[k - 1] else k * 0.5 for k in (1, 2, 3))


def train(docs: DataFrame, chosen: Column, folder: str, text_col: str = "text", input_bytes: int | None = None, order: int = 2) -> Model:
    """Count over all rows that `chosen` selects; arrays go to `folder`.  order: words of the longest grams, two or more."""
    rows = docs.where(chosen).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if input_bytes is None:
        input_bytes = store.input_bytes(docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGE_BYTES)
    ranges = int(max(4, min(RANGES, input_bytes // RANGE_BYTES + 1)))

    def longest(batches):
        with store.tidied():
            sums = Sums(GATHER)
            for _, data, at in text.pieces(batches):
                words, _ = tokens(data, at, order)
                sums.add(*add_up(words, [np.ones(len(words[0]), np.uint32)]))
                if sums.done >= GATHER // 2:
                    yield from _parts(*sums.reduce(), ranges)
                    sums = Sums(GATHER)
            if sums.parts:
                yield from _parts(*sums.reduce(), ranges)

    def level(k: int):
        """Write each range's grams of k words, and pass on what they say about shorter ones, and finished ranges."""

        def run(batches):
            with store.tidied():
                before: list[pa.RecordBatch] = []
                for i, words, values in _by_range(batches, before):
                    yield from finished(i, words, values)
                yield from before

        def finished(i: int, words: list[np.ndarray], values: list[np.ndarray]):
            n = values[0] if k == order else values[STATS.index("cont")]
            raw = values[0]
            name = uuid.uuid4().bytes
            if k == order:
                table = np.minimum(n, 0xFFFFFFFF)
                widths = bytes([_width(table)])
                table = table.astype(_record(widths))
            else:
                widths = bytes(map(_width, values))
                table = np.zeros(len(n), _record(widths))
                for field, v in zip(STATS, values, strict=True):
                    table[field] = v
            store.write_file(_file(folder, k, i, name), [gram_hash(words).tobytes(), table.tobytes(), widths])
            del table
            seen = n > 0
            counts = {"grams": int(seen.sum()), "tokens": int(raw.sum()), "words": int((raw > 0).sum())}
            yield _finished(i, k, name, counts | {f"c{j}": int((n == j).sum()) for j in (1, 2, 3, 4)})
            if k > 1 and seen.any():
                words, n, raw = [w[seen] for w in words], n[seen], raw[seen]
                none = np.zeros(len(n), np.uint32)
                sums = Sums(1)
                sums.add(*add_up(words[1:], [raw, np.ones(len(n), np.uint32), none, none, none, none]))
                sums.add(*add_up(words[:-1], [none, none, n, n == 1, n == 2, n > 2]))
                yield from _parts(*sums.reduce(), ranges)

        return run

    found, sums, names = rows.mapInArrow(longest, ROWS), {}, {}
    for k in range(order, 0, -1):  # parts go from one exchange to the next and are stored nowhere else
        found = found.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(level(k), ROWS)
    found = store.saved(found.drop("data"), folder, "ranges")
    for k in range(order, 0, -1):
        files = found.where(F.col("length") == k)
        total = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
        sums[k] = total.asDict()
        names[k] = np.zeros((ranges, 16), np.uint8)
        for r in files.select("range", "file").collect():  # 16 bytes for each of RANGES at most
            names[k][r.range] = np.frombuffer(r.file, np.uint8)
    return Model(folder, order, ranges, names, sums)


class Scorer:
    """A worker's view: arrays are mapped when a range is first asked for, and given up when many others were since."""

    def __init__(self, model: Model):
        self.m, self.open = model, OrderedDict()
        self.d = {k: np.array([0.0, *Model.discounts([s[f"c{i}"] for i in (1, 2, 3, 4)])]) for k, s in model.sums.items()}
        one = model.sums[1]
        self.n, self.v, self.pairs = one["tokens"], one["words"], model.sums[2]["grams"]
        self.back = (self.d[1][1] * one["c1"] + self.d[1][2] * one["c2"] + self.d[1][3] * (one["grams"] - one["c1"] - one["c2"])) / max(self.pairs, 1)

    def _arrays(self, k: int, i: int):
        if (k, i) not in self.open:
            if len(self.open) >= MAPS:
                self.open.popitem(last=False)
            raw = store.mapped(_file(self.m.folder, k, i, self.m.names[k][i].tobytes()))
            fields = 1 if k == self.m.order else len(STATS)
            raw, kind = raw[:-fields], _record(raw[-fields:].tobytes())
            n = len(raw) // (8 + kind.itemsize)
            self.open[k, i] = (raw[: 8 * n].view("<u8"), raw[8 * n :].view(kind))
        self.open.move_to_end((k, i))
        return self.open[k, i]

    def _find(self, k: int, h: np.ndarray) -> np.ndarray:
        """The entries of sorted distinct hashes of grams of k words; zeros where there is none."""
        out = np.zeros(len(h), np.uint32 if k == self.m.order else RECORD)
        r = _range_of(h, self.m.ranges)
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(r)], strict=False):
            i = int(r[a])
            if not self.m.names[k][i].any():
                continue
            key, value = self._arrays(k, i)
            if not len(key):
                continue
            j = np.minimum(np.searchsorted(key, h[a:b]), len(key) - 1)
            hit = key[j] == h[a:b]
            out[a:b][hit] = value[j[hit]]
        return out

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each row."""
        order = self.m.order
        words, n = tokens(data, at, order)
        _, index, inverse = np.unique(gram_hash(words), return_index=True, return_inverse=True)
        words = [w[index] for w in words]
        p = raw = count = None
        for k in range(1, order):
            # grams of k words: those predicted, and those that are the context of one more
            h, back = np.unique(np.concatenate([gram_hash(words[order - k :]), gram_hash(words[order - k - 1 : order - 1])]), return_inverse=True)
            info = self._find(k, h)
            own, context = info[back[: len(index)]], info[back[len(index) :]]
            if k == 1:
                raw = own["raw"].astype(np.float64)
                p = np.maximum(own["cont"] - self.d[1][np.minimum(own["cont"], 3)], 0) / max(self.pairs, 1) + (self.back if self.pairs else 1.0) / (self.v + 1)
            else:
                p = self._interpolated(k, own["cont"], count, p)
            count = context
        h, back = np.unique(gram_hash(words), return_inverse=True)
        p = self._interpolated(order, self._find(order, h)[back], count, p)
        base = np.log10((raw + 0.5) / (self.n + 0.5 * (self.v + 1)))
        begin = np.cumsum(n) - n
        total_of = lambda x: np.add.reduceat(x[inverse], begin)
        return n, total_of((raw > 0).astype(np.int64)), total_of(base), total_of(np.log10(p))

    def _interpolated(self, k: int, c: np.ndarray, context: np.ndarray, low: np.ndarray) -> np.ndarray:
        d, c, total = self.d[k], c.astype(np.float64), context["total"].astype(np.float64)
        seen = total > 0
        safe = np.where(seen, total, 1.0)
        gamma = (d[1] * context["one"] + d[2] * context["two"] + d[3] * context["more"]) / safe
        return np.where(seen, np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / safe + gamma * low, low)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        with store.tidied():
            scorer = Scorer(shared.value)
            for batch, data, at in text.pieces(batches):
                n, known, base, s = scorer.score(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), scorer.n, np.int64)), pa.array(base), pa.array(s), pa.array(10 ** (-s / n))], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
