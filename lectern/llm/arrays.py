"""Large count arrays of fixed size, summed over all tasks: rows of (name, slice, counts) instead of a row per count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 14
ROWS = "name string, slice int, counts binary"


def rows(arrays: dict[str, np.ndarray], first: int = 0) -> pa.RecordBatch:
    """Slices of int64 arrays that hold anything; first is the number of the arrays' first slice."""
    name, number, blob = [], [], []
    for k, a in arrays.items():
        for i in range(0, len(a), SLICE):
            if (part := a[i : i + SLICE]).any():
                name.append(k)
                number.append(first + i // SLICE)
                blob.append(part.astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(number, pa.int32()), pa.array(blob, pa.binary())], names=["name", "slice", "counts"])


def parts(name: str, a: np.ndarray, slices: int = 16):
    """The rows of one array, a few slices at a time, so that a large array isn't held twice more."""
    for i in range(0, len(a), slices * SLICE):
        yield rows({name: a[i : i + slices * SLICE]}, i // SLICE)


def summed(parts: DataFrame) -> DataFrame:
    """One row per name and slice, in four or eight bytes a count; each task keeps only its own slices' sums."""

    def add(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for k, i, blob in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                a = np.frombuffer(blob, "<i8")
                if (k, i) in total:
                    total[k, i] += a
                else:
                    total[k, i] = a.copy()
        if total:
            blobs = [a.astype("<i4" if a.max() < 1 << 31 else "<i8").tobytes() for a in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.int32()), pa.array(blobs, pa.binary())], names=["name", "slice", "counts"])

    return parts.repartition("name", "slice").mapInArrow(add, ROWS)


def collected(parts: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The sums as arrays of `size` on the driver: their total size is fixed by the number of names, not by the rows."""
    out: dict[str, np.ndarray] = {}
    for name, i, blob in summed(parts).collect():
        part = out.setdefault(name, np.zeros(size, np.int64))[i * SLICE : (i + 1) * SLICE]
        part[:] = np.frombuffer(blob, "<i4" if len(blob) == 4 * len(part) else "<i8")
    return out
