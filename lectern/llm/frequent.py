"""The frequent segments of all texts, by summaries of bounded size that every segment is counted in (Misra and Gries).

A task keeps the counts of at most 4 x `size` segments; beyond that it takes the count of the `size`-th largest off all of
them and drops what is left with nothing.  So a count is too low by at most a `size`-th of the task's segments, and of all
segments of all texts those with a share over 2 / `size` are surely proposed.  What a task proposes is narrow and bounded
(`size` rows); texts and their other segments stay where they are.  Segments of LONGEST characters and more are left to
the exact path of whoever asks, so what the driver gets has a bound too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

LONGEST = 64


class Summary:
    def __init__(self, size: int):
        self.size, self.count, self.name = size, {}, {}

    def add(self, keys: list[int], counts: list[int], name: Callable[[int], str]) -> None:
        """Distinct keys with counts; name(i) gives the segment of keys[i], if it is new."""
        count = self.count
        for i, (k, n) in enumerate(zip(keys, counts, strict=True)):
            if k in count:
                count[k] += n
            else:
                count[k] = n
                self.name[k] = name(i)
        if len(count) > 4 * self.size:
            low = int(np.partition(np.fromiter(count.values(), np.int64, len(count)), -self.size)[-self.size])
            self.count = {k: n - low for k, n in count.items() if n > low}
            self.name = {k: self.name[k] for k in self.count}

    def top(self) -> list[tuple[str, int]]:
        chosen = sorted(self.count.items(), key=lambda x: (-x[1], x[0]))[: self.size]
        return [(self.name[k], n) for k, n in chosen]


def segments(texts: DataFrame, cut: Callable, size: int, most: int) -> list[str]:
    """The `most` most frequent of the segments that tasks propose; ties go to the first in order.

    texts: one string column `text`.  cut(): called once a task, gives a function from the texts of a batch to their
    joined string, the begin and end of each segment in it, and the segments' hashes.
    """

    def count(batches):
        seen, of = Summary(size), cut()
        for batch, _, _ in text.pieces(batches):
            joined, first, end, h = of(batch.column("text").to_pylist())
            short = end - first < LONGEST
            first, end, h = first[short], end[short], h[short]
            key, index, n = np.unique(h, return_index=True, return_counts=True)
            a, b = first[index].tolist(), end[index].tolist()
            seen.add(key.tolist(), n.tolist(), lambda i: joined[a[i] : b[i]])  # noqa: B023
        top = seen.top()
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    rows = texts.where("text is not null").mapInArrow(count, "word string, n long")
    return [r.word for r in rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]  # of bounded number and length
