"""This package on the executors, for the functions that run there in Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def send(spark: SparkSession) -> None:
    """Send the package's code to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_sent", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        out = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        p = os.path.join(folder, n)
                        z.write(p, os.path.join("lectern", os.path.relpath(p, top)))
        sc.addPyFile(out)
        sc._lectern_sent = True
