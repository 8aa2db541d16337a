"""Connected components of an edge table: forests of each task's own edges, then large-star and small-star steps."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) of the edges' nodes but the roots, by hooking and jumping over whole arrays."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        apart = high != low
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    other = root != np.arange(len(node))
    return node[other], node[root[other]]


#: Edges that a task holds before it reduces them to a forest.
HELD = 1 << 20


def within_tasks(edges: DataFrame) -> DataFrame:
    """The edges, those of a task replaced by stars of the trees that they make: no more of them, and nothing is shuffled."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= HELD:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["a", "b"])
                    held = []
                size = sum(len(x) for x, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, forest(*map(np.concatenate, zip(*held, strict=True))))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node reachable.

    Edges point from the larger node to the smaller.  A large-star step moves each edge's lower end to the smallest node
    that this points to; a small-star step ties all that a node points to to the smallest of them.  Minima are aggregated
    map-side, and stored before they are joined back: a side that was aggregated in the same plan would keep Spark from
    splitting the rows of a node that many edges end at.  Each step's edges are a table in `folder`, so a lost executor
    costs one step.
    The steps end when one changes nothing: each makes a node point lower or takes an edge away.
    """
    e = store.saved(within_tasks(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), folder, "edges")
    before = _summary(e)
    for step in count():
        if not before[0]:
            break
        low = store.saved(e.groupBy("a").agg(F.min("b").alias("m")), folder, f"low{step}")
        large = e.join(low.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = store.saved(large, folder, f"large{step}")
        low = store.saved(large.groupBy("a").agg(F.min("b").alias("m")), folder, f"least{step}")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = store.saved(within_tasks(small), folder, f"step{step}")
        now = _summary(e)
        if now == before:
            break
        before = now
    roots = e.select("b").distinct()
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
