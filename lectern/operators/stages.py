"""The seam for model stages: a function over batches, loaded once a worker, or a table of outputs made elsewhere."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import guarded


def run_stage(rows: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], source: str, target: str, partitions: int | None = None) -> DataFrame:
    """rows with `target`; `load` runs once a worker and returns a function of a batch of `source`.

    Few partitions bound how many workers call a service with a rate limit.
    """

    @F.pandas_udf("string")
    def stage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return (rows.coalesce(partitions) if partitions else rows).withColumn(target, stage(source))


def guarded_stage(rows: DataFrame, source: str, candidate: str, target: str, tolerance: int = 0) -> DataFrame:
    """rows with `target` and `status`: the candidate where it has as many words, else the source."""
    return rows.withColumn("__g", guarded(F.col(source), F.col(candidate), tolerance)).withColumns({target: F.col("__g.text"), "status": F.col("__g.status")}).drop("__g")


def precomputed(rows: DataFrame, outputs: DataFrame, keys: list[str], source: str, output: str, target: str) -> DataFrame:
    """rows with `target` from a table of outputs; the source's text where that has none."""
    return rows.join(outputs.select(*keys, F.col(output).alias(target)), keys, "left").withColumn(target, F.coalesce(target, source))


def called(rows: DataFrame, load: Callable[[], Callable[[str], str]], source: str, target: str, attempts: int = 3, least: float = 15.0, sleep: Callable[[float], None] = time.sleep, partitions: int | None = None) -> DataFrame:
    """rows with `target` and `status` from a service that may refuse: success, empty_input, or max_retries_exceeded with the source's text.

    After refusal number n it waits `least` * n seconds, or what the refusal asks for ("retry in 7.5s") and one more.  `load`
    runs once a worker; few partitions bound how many workers call at once.
    """

    def ask(service, text: str) -> tuple[str, str]:
        if not text.strip():
            return text, "empty_input"
        for n in range(1, attempts + 1):
            try:
                return service(text), "success"
            except Exception as e:  # the service's own errors are not known here
                asked = re.search(r"retry in (\d+\.?\d*)s", str(e))
                if n < attempts:
                    sleep(max(least * n, float(asked[1]) + 1 if asked else 0.0))
        return text, "max_retries_exceeded"

    @F.pandas_udf("text string, status string")
    def stage(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        service = load()
        for b in batches:
            yield pd.DataFrame([ask(service, x or "") for x in b], columns=["text", "status"])

    rows = (rows.coalesce(partitions) if partitions else rows).withColumn("__s", stage(source))
    return rows.withColumns({target: F.col("__s.text"), "status": F.col("__s.status")}).drop("__s")
