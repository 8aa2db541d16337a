"""The folder that driver and executors share, and files of ours in it.

Spark's own readers and writers handle tables; the archives, automata and hash arrays of the operators here are
plain files, which tasks write and read through pyarrow's file systems by URI.  A task names its file uniquely and
returns the name as a row, so a task that runs again after a lost executor leaves at worst an unused file.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..sources import package

#: Arrow batches to workers have so many rows and bytes at most, or are one row.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}
#: Rows of a scan's batch, which holds whole texts; and column chunks come by plain reads, since vectored ones keep a direct buffer as large as a chunk for each thread.
READ = {"spark.sql.parquet.columnarReaderBatchSize": "512", "parquet.hadoop.vectored.io.enabled": "false"}


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once, and keep batches and buffers of long texts small (settings of this session)."""
    package.send(spark)
    for k, v in (BATCH | READ).items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def tidied():
    """Around a task: at its end the allocators give back what they keep, since workers live on between tasks."""
    try:
        yield
    finally:
        with contextlib.suppress(OSError, AttributeError):
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI: spark.checkpoint.dir, or a local one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_lectern_root", None)
        if root is None:
            root = spark.sparkContext._lectern_root = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
    return root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later stages start from it, whatever executors are lost."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def write_file(uri: str, parts) -> int:
    """Write byte strings one after another; returns the length."""
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    n = 0
    with system.open_output_stream(path, compression=None) as f:
        for p in parts:
            n += f.write(p)
    return n


def open_write(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes as a memory map.

    Where the shared folder is no mounted one, the file is fetched to the worker's temporary folder, mapped, and unlinked
    at once, so nothing stays behind.
    """
    system, path = pafs.FileSystem.from_uri(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile() as own, system.open_input_stream(path, compression=None) as f:
        while b := f.read(1 << 22):
            own.write(b)
        own.flush()
        return np.memmap(own.name, np.uint8, "r") if os.path.getsize(own.name) else np.zeros(0, np.uint8)


def input_bytes(df: DataFrame, unknown: int) -> int:
    """The size of a table's files by the plan's statistics; `unknown` where it comes from no files."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else unknown
