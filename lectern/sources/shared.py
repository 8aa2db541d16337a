"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI, or a local folder where that is unset and all runs on one machine."""
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
