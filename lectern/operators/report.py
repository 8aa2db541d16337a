"""Reports as rows: run summaries, skipped pages, stages and metrics, bands, improvements, heads in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import half_even

#: Error bands: the highest rate of good and of fair lines, for display and for training.
BANDS = {"shown": (0.10, 0.20), "trained": (0.10, 0.15)}


def band(rate: Column, kind: str = "shown") -> Column:
    good, fair = BANDS[kind]
    return F.when(rate <= good, "good").when(rate <= fair, "fair").otherwise("poor")


def improvement(before: Column, after: Column, places: int = 3) -> Column:
    """Whether a rate, as shown, fell, stayed or rose."""
    a, b = half_even(before, places), half_even(after, places)
    return F.when(b < a, "better").when(b == a, "same").otherwise("worse")


def run_summary(left: DataFrame, right: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Lines read, lines of text, pairs and remainders by page, and over all (page is null)."""
    sides = left.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(right.select(*keys, F.lit(0), F.lit(1)))
    place = sides.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return place.rollup(page).agg(
        F.sum("x").alias("image_lines"), F.sum("y").alias("text_lines"), F.sum(F.least("x", "y")).alias("matched"),
        F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("unmatched_image"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("unmatched_text"),
    )


def skipped(images: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, reason) of pages without text, without an image, or whose image can't be read (readable is false)."""
    one = images.groupBy(key).agg(F.max("readable").alias("readable")).join(texts.select(key, F.lit(True).alias("has")).distinct(), key, "full")
    reason = F.when(F.col("readable").isNull(), "no image").when(F.col("has").isNull(), "no text").when(~F.col("readable"), "unreadable")
    return one.select(key, reason.alias("reason")).where("reason is not null")


def long_report(wide: DataFrame, stage: str, metrics: list[str]) -> DataFrame:
    """(stage, metric, value) of a row a stage."""
    return wide.select(F.col(stage).alias("stage"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select("stage", "r.*")


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return rows.orderBy(*order).limit(n)
