"""Near-duplicate embeddings by int8 tile products with an error bound for each vector.

Unit vectors are rounded to 8-bit numbers times a scale of their own; the exact length of what rounding took away bounds
how far a product of rounded vectors can be from the true cosine.  Within a label, blocks of vectors meet tile by tile; a
tile's products leave most pairs surely below the threshold or surely above it, and only those in doubt are computed again
in double precision.  A tile returns link counts and a spanning forest of its links, never its pairs; equal vectors are
one class with a multiplicity from the start.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and null labels, link with
nothing; so do vectors of different length; a null id links with nothing, has no component and is not kept; rows that
repeat an id are vectors of their own in counts (their copies count as other vectors) and one node in components, and each
is kept if its id is; an empty table gives an empty one; other columns are ignored, whatever they are named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components

BLOCK = 2048
SLACK = 1e-9
DOUBT = 200_000


def _units(batches):
    """Class digest, dimension and unit vector of each row, null where it links with nothing."""
    for batch in batches:
        column = batch.column("embedding")
        at = column.offsets.to_numpy()
        flat = column.values.cast(pa.float64())
        holes = np.concatenate([[0], np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False))])
        flat = flat.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        digest, dim, unit = [], [], []
        for i, (label, vec_id) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vec_id").to_pylist(), strict=True)):
            v = flat[at[i] : at[i + 1]]
            ok = valid[i] and label is not None and vec_id is not None and len(v) and holes[at[i + 1]] == holes[at[i]] and np.isfinite(v).all()
            top = np.abs(v).max() if ok else 0.0
            if not top > 0:
                digest.append(None), dim.append(None), unit.append(None)
                continue
            digest.append(hashlib.md5(v.tobytes() + label.encode()).digest())
            dim.append(len(v))
            u = v / top
            unit.append((u / np.sqrt(u @ u)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], names=["vec_id", "label", "digest", "dim", "unit"])


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounded rows, their scales, and the lengths of the rounding errors."""
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    return q, s, np.sqrt(((u - q * s[:, None]) ** 2).sum(1))


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least `least`, exactly as double precision has it."""
    qa, sa, ea = quantised(a)
    qb, sb, eb = quantised(b)
    exact = np.float32 if a.shape[1] <= 1040 else np.float64  # sums of 8-bit products below 2**24 are exact in 32 bits
    near = (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64) * sa[:, None] * sb[None, :]
    error = ea[:, None] * (1 + eb[None, :]) + eb[None, :] + SLACK
    out = near - error >= least
    i, j = np.nonzero((near + error >= least) & ~out)
    for k in range(0, len(i), DOUBT):
        x, y = i[k : k + DOUBT], j[k : k + DOUBT]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= least
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of each node but the roots in a symmetric link matrix."""
    left = links.any(1)
    out = []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        front = links[root] & left
        while front.any():
            left &= ~front
            out += [(i, root) for i in np.flatnonzero(front).tolist()]
            front = links[front].any(0) & left
    return out


def _tile(digest: pa.Array, ids: np.ndarray, mult: np.ndarray, side: np.ndarray, u: np.ndarray, least: float) -> pa.RecordBatch:
    """Counts by class and forest of one tile; side 2: a block with itself, else blocks 0 and 1."""
    if (side == 2).any():
        m = linked(u, u, least)
        np.fill_diagonal(m, False)
        m |= m.T
        count, tree = m @ mult, forest(m)
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        m = linked(u[a], u[b], least) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        count = np.zeros(len(ids), np.int64)
        count[a], count[b] = m @ mult[b], m.T @ mult[a]
        some_a, some_b = m.any(1), m.any(0)
        a, b, m = a[some_a], b[some_b], m[some_a][:, some_b]
        both = np.zeros((len(a) + len(b),) * 2, bool)
        both[: len(a), len(a) :], both[len(a) :, : len(a)] = m, m.T
        at = np.concatenate([a, b])
        tree = [(at[i], at[j]) for i, j in forest(both)]
    has = np.flatnonzero(count)
    m = len(tree)
    ends = [pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[[e[k] for e in tree]] if m else [], pa.int64())]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([digest.take(pa.array(has)), pa.nulls(m, pa.binary())]), pa.array(np.concatenate([count[has], np.zeros(m, np.int64)])), *ends], names=["digest", "n", "a", "b"])


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between an id that has several vectors and the first ids of their classes."""
    several = rows.where("digest is not null").groupBy("vec_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("vec_id")
    return rows.join(several, "vec_id").join(classes.select("digest", "rep"), "digest").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))


def deduplicate(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    folder = store.new_folder(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    rows = store.saved(rows.mapInArrow(_units, "vec_id long, label string, digest binary, dim int, unit binary"), folder, "units")
    classes = rows.where("digest is not null").groupBy("digest", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("unit").alias("unit"))
    classes = store.saved(classes, folder, "classes")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "digest", "rep", "mult", "unit")

    def tiles(batches):
        key, held = None, []

        def done():
            t = pa.Table.from_batches(held)
            u = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, -1)
            return _tile(t.column("digest").combine_chunks(), t.column("rep").to_numpy(), t.column("mult").to_numpy(), t.column("side").to_numpy(), u, least)

        for batch in batches:
            k = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "i", "j")), strict=True))
            at = 0
            while at < len(k):
                end = at
                while end < len(k) and k[end] == k[at]:
                    end += 1
                if k[at] != key and held:
                    yield done()
                    held = []
                key = k[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield done()

    tile = ["label", "dim", "i", "j"]
    found = store.saved(dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(tiles, "digest binary, n long, a long, b long"), folder, "found")
    counts = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("digest is null").select("a", "b").unionAll(_same_ids(rows, classes)), folder)
    known = classes.select("digest", "rep", "mult").join(counts, "digest", "left").join(parts, F.col("node") == F.col("rep"), "left")
    known = known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
