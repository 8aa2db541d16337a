"""Predictions as a stream: rates kept up to date by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PREDICTION = "page_id long, line_no int, ocr_output string, ground_truth string, ts timestamp"


def predictions(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Predictions that arrive as JSON files in a folder."""
    return spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", per_trigger).json(path)


def running_rates(rows: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Edits and lengths by page and event-time window; sums can be added to, unlike means, and state ends with the watermark."""
    edits, size = F.levenshtein("ocr_output", "ground_truth"), F.length("ground_truth")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "page_id").agg(F.sum(edits).alias("edits"), F.sum(size).alias("ref_len"), F.count("*").alias("lines"))


def start(rates: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand each batch's rates to `write`; the checkpoint folder lets a query that was lost go on."""
    return rates.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
