"""How text filters interact: what each one removes, in every order of them, and which of it another removes as well.

Each text gets a mask, a bit for each filter that it fails.  All but the last come from the text alone; the last one, whether
a smaller id has the identical text, comes from radix tries:

1. A task inserts the texts that it reads into a compressed trie, which holds the rows of a text at its terminal.  A row
   with a larger id than another there is decided; a text goes on once a trie, with its rows of the smallest id.
2. Texts are dealt by ranges of a prefix of their own.  Prefixes begin with FIRST characters; one whose texts differ and take
   more than a range's share of all is four times as long, until none does.  Copies of one text share their prefix.
3. Each range is inserted into one trie with the smallest id of all at the terminals, and traversed for the flags.

Masks are then counted by part and label; all orders are read from these counts (at most 32 a part), never from rows.

Defined cases: a null text is an empty one (which fails nothing but the least number of words, and is identical to others); a
null part is the empty string; a row with a null id has no label, and neither is a copy nor makes one; rows that repeat an id
are no copies of each other, and all count; labels that repeat an id hold if one of them does; texts of any length count whole;
an empty table gives an empty one; other columns are ignored, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

#: Bytes of text in a task's trie before it is emptied, and in one range.
TRIE, RANGE = 8 << 20, 32 << 20
#: Characters of the first prefixes, and how many prefixes may be lengthened (their hashes go to all tasks, 8 bytes each).
FIRST, LENGTHENED = 16, 1 << 18
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


class Text:
    """What filters ask of a text; words are runs of bytes other than 9-13 and 32."""

    def __init__(self, whole: str):
        self.chars, self.raw = len(whole), whole.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    def without(self, these: bytes) -> int:
        return len(self.raw.translate(None, these))


#: Filters by letter, as conditions of failure; the letter after the last is that of identical texts.
FILTERS: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: len(t.words) < 50,
    "B": lambda t: 100 * len(set(t.words)) < 65 * len(t.words),
    "C": lambda t: 100 * (len(t.raw) - t.without(_UPPER)) > 5 * t.chars,
    "D": lambda t: t.without(_SIGNS) < len(t.raw),
}
COPY = "E"


class Node:
    __slots__ = ("label", "children", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.rows = label, {}, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a begin b[at:]: steps that double, then halves of the one that differs."""
    low, step, most = 0, 16, min(len(a), len(b) - at)
    while low + step <= most and a[low : low + step] == b[at + low : at + low + step]:
        low, step = low + step, 2 * step
    high = min(low + step, most)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed trie over bytes; a terminal holds rows (id, part, mask) with their number."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def terminal(self, key: bytes) -> Node:
        node, i = self.root, 0
        while i < len(key):
            child = node.children.get(key[i])
            if child is None:
                child = node.children[key[i]] = Node(key[i:])
                return child
            if not key.startswith(child.label, i):
                k = _common(child.label, key, i)
                above = node.children[key[i]] = Node(child.label[:k])
                child.label = child.label[k:]
                above.children[child.label[0]] = child
                child = above
            i += len(child.label)
            node = child
        return node

    def insert(self, key: bytes, row: tuple, n: int) -> None:
        end = self.terminal(key)
        if end.rows is None:
            end.rows = {}
            self.bytes += len(key)
        self.bytes += 100 * (row not in end.rows)
        end.rows[row] = end.rows.get(row, 0) + n

    def terminals(self) -> Iterator[tuple[bytes, dict[tuple, int], object]]:
        """Each text with its rows and the smallest of their ids."""
        left = [(self.root, b"")]
        while left:
            node, above = left.pop()
            key = above + node.label
            if node.rows is not None:
                yield key, node.rows, min((i for i, *_ in node.rows if i is not None), default=None)
            left.extend((c, key) for c in node.children.values())


def _batches(rows: Iterator[tuple], kind: pa.DataType, body: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, n, body) in batches of at most about 1 MB."""
    names, types = ["id", "part", "mask", "n", "body"], [kind, pa.string(), pa.int32(), pa.int64(), pa.string()]
    some, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[j] for r in some], t) for j, t in enumerate(types[: 4 + body])], names=names[: 4 + body])
    for r in rows:
        some.append(r)
        size += 100 + (len(r[4]) if r[4] is not None else 0)
        if size > 1 << 20:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def _read(docs: DataFrame, filters: tuple, id_kind: str) -> DataFrame:
    """id, part, mask, n, body of every row: body is the text of those that the task's tries leave undecided."""
    copy = 1 << len(filters)

    def emptied(trie: Trie):
        for key, rows, low in trie.terminals():
            for (i, part, mask), n in rows.items():
                if i is None or i != low:
                    yield i, part, mask | (copy if i is not None else 0), n, None
                else:
                    yield i, part, mask, n, key.decode()

    def run(batches):
        trie, kind = Trie(), None
        for batch, _, _ in text.pieces(batches):
            kind = batch.schema.field(0).type
            for i, part, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = Text(whole or "")
                trie.insert(t.raw, (i, part, sum(1 << j for j, fails in enumerate(filters) if fails(t))), 1)
            if trie.bytes > TRIE:
                yield from _batches(emptied(trie), kind, True)
                trie = Trie()
        if kind is not None:
            yield from _batches(emptied(trie), kind, True)

    return docs.mapInArrow(run, f"id {id_kind}, part string, mask int, n long, body string")


def prefix(rows: DataFrame, total: int, most: int = RANGE) -> Column:
    """The prefix of `body` by which texts are dealt: lengthened where differing texts of one prefix take over `most` bytes."""
    most, size = max(most, total // LENGTHENED), FIRST
    at = lambda n: F.substring("body", 1, n)
    found, left = [], rows.select("body")
    while True:
        whole = F.xxhash64("body")
        heavy = left.groupBy(at(size).alias("p")).agg(F.sum(F.octet_length("body")).alias("b"), (F.min(whole) != F.max(whole)).alias("differ")).where(f"b > {most} and differ").select(F.xxhash64("p").alias("h"))
        hashes = [r.h for r in heavy.collect()]  # total / most at most
        if not hashes:
            break
        found.append((size, hashes))
        left, size = left.where(F.xxhash64(at(size)).isin(hashes)), 4 * size
    out = at(size)
    for n, hashes in reversed(found):
        out = F.when(~F.xxhash64(at(n)).isin(hashes), at(n)).otherwise(out)
    return out


def _flagged(rows: DataFrame, copy: int, id_kind: str) -> DataFrame:
    """id, part, mask, n of rows that come by ranges of texts: one trie a range, traversed for the copies."""

    def flags(trie: Trie):
        for _, rows, low in trie.terminals():
            for (i, part, mask), n in rows.items():
                yield i, part, mask | (copy if i != low else 0), n, None

    def run(batches):
        trie, kind = Trie(), None
        for batch, _, _ in text.pieces(batches, "body"):
            kind = batch.schema.field(0).type
            for i, part, mask, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(body.encode(), (i, part, mask), n)
        if kind is not None:
            yield from _batches(flags(trie), kind, False)

    return rows.mapInArrow(run, f"id {id_kind}, part string, mask int, n long")


def masks(docs: DataFrame, filters: dict[str, Callable[[Text], bool]] | None = None, most: int = RANGE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask and n, how many rows have the three: bit j of mask says that they fail filter j, the last that they are copies."""
    spark, tests = docs.sparkSession, tuple((FILTERS if filters is None else filters).values())
    kind, copy = dict(docs.dtypes)[id_col], 1 << len(tests)
    read = _read(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")), tests, kind)
    rows = store.saved(read, store.new_folder(spark, "audit"), "rows")
    open_rows = rows.where("body is not null")
    total = open_rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // most + 1)
    dealt = open_rows.repartitionByRange(ranges, prefix(open_rows, total, total // ranges))
    return rows.where("body is null").drop("body").unionByName(_flagged(dealt, copy, kind)).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def audit(found: DataFrame, labels: DataFrame, letters: str = "".join(FILTERS) + COPY, id_col: str = "doc_id") -> DataFrame:
    """part, filter_order, step and the counts of each filter's step in each order, from the rows of `masks`.

    labels: `id_col`, quality and toxic.
    """
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = found.join(known, "id", "left")
    n = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "bad"))]
    parts = rows.groupBy("part", "mask").agg(*n).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("of"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))).alias("filter_order")
    steps = parts.select("part", "of", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    letter, before = F.substr("filter_order", F.col("step"), F.lit(1)), F.substr("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda s: sum((F.when(F.contains(s, F.lit(c)), 1 << j).otherwise(0) for j, c in enumerate(letters)), F.lit(0))
    steps = steps.select("part", "of", "filter_order", "step", bits(letter).alias("own"), bits(before).alias("gone"))

    def total(of: str, when: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        return F.aggregate("of", F.lit(0).cast("long"), lambda s, r: s + F.when(when(r["mask"]), r[of] * times(r["mask"])).otherwise(0)).alias(of)

    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    here = lambda m: has(m, "own") & ~has(m, "gone")
    every = F.lit(1)
    for i in range(2, len(letters) + 1):
        every *= i
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m, "own") & ~has(m, "gone")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: has(m, "own") & has(m, "gone")).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("bad", here).alias("toxic_lost"),
        total("n", lambda m: has(m, "own"), lambda m: (every / F.bit_count(m)).cast("long")).alias("shapley"),
    )
