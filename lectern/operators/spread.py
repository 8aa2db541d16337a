"""Few rows with much work each: adaptive execution would put them into one task by their size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows over as many partitions as shuffles have, by the keys if there are any."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widened(rows: DataFrame) -> DataFrame:
    """A scanned table over as many partitions as shuffles have, where its files give fewer: one row group is one task's, however much work its rows are."""
    few = rows.rdd.getNumPartitions() < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread(rows) if few else rows
