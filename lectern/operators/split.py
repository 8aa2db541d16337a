"""Splits by page and by group, and the union of training pairs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_pages(ids: list[int], share: float = 0.2, seed: int = 42) -> set[int]:
    """The validation pages of a short list of page numbers: the first of a seeded shuffle."""
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    return set(ids[: max(1, int(len(ids) * share))])


def in_validation(group: Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a group falls into validation, by a hash: no list of groups, no order, the same at every size."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(group.cast("string"), F.lit("null")), F.lit(str(seed)))), 1, 13), 16, 10).cast("long")
    return h < int(share * (1 << 52))


def repeated(rows: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Every row `times` times, numbered from 0."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def training_pairs(preds: DataFrame, gold: DataFrame, synthetic: DataFrame | None = None, prefix: str = "correct: ") -> DataFrame:
    """(kind, source, target): outputs and rule-corrected outputs that differ from the truth, noise that differs from gold, and gold itself.

    preds: ocr_output, rule_corrected (null: the output), ground_truth; gold: gold; synthetic: gold, noisy.  All are trimmed,
    and pairs with a blank side go.
    """
    own = preds.select(F.trim("ocr_output").alias("o"), F.trim(F.coalesce("rule_corrected", "ocr_output")).alias("r"), F.trim("ground_truth").alias("target"))
    gold = gold.select(F.trim("gold").alias("target"))
    kinds = [
        own.select(F.lit("real").alias("kind"), F.col("o").alias("s"), "target").where("s <> target"),
        own.select(F.lit("rule").alias("kind"), F.col("r").alias("s"), "target").where("s <> target"),
        gold.select(F.lit("identity").alias("kind"), F.col("target").alias("s"), "target"),
    ]
    if synthetic is not None:
        kinds.append(synthetic.select(F.lit("synthetic").alias("kind"), F.col("noisy").alias("s"), F.trim("gold").alias("target")).where("s <> target"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.where("s <> '' and target <> ''").select("kind", F.concat(F.lit(prefix), "s").alias("source"), "target")
