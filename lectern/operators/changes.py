"""What a correction changed: replaced tokens with their place, and their division into surface forms and others."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHANGE = "array<struct<original:string,corrected:string,start:int,end:int>>"
_TOKEN = {True: re.compile(r"\w+|[^\w\s]+"), False: re.compile(r"\S+")}


def replacements(old: str, new: str, punctuation: bool, autojunk: bool) -> list[dict]:
    """The replaced token runs of two texts, with the place in the old one."""
    a, b = (list(_TOKEN[punctuation].finditer(x)) for x in (old, new))
    match = difflib.SequenceMatcher(None, [m.group() for m in a], [m.group() for m in b], autojunk=autojunk)
    return [{"original": old[a[i].start() : a[j - 1].end()], "corrected": new[b[k].start() : b[m - 1].end()], "start": a[i].start(), "end": a[j - 1].end()} for op, i, j, k, m in match.get_opcodes() if op == "replace"]


def text_changes(rows: DataFrame, old_col: str, new_col: str, punctuation: bool = True, autojunk: bool = False) -> DataFrame:
    """rows with `changes`: a pandas UDF, since the diff has no counterpart among expressions."""

    @F.pandas_udf(CHANGE)
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([replacements(a or "", b or "", punctuation, autojunk) for a, b in zip(old, new, strict=True)])

    return rows.withColumn("changes", diff(old_col, new_col))


def change_rows(rows: DataFrame, keys: list[str], old_col: str, new_col: str, **how) -> DataFrame:
    """One row per change: original, corrected, start, end, context, is_ocr_error (only punctuation, space or case)."""
    c = text_changes(rows, old_col, new_col, **how).select(*keys, old_col, F.explode("changes").alias("c")).select(*keys, old_col, "c.*")
    return c.select(*keys, "original", "corrected", "start", "end", T.snippet(F.col(old_col), F.col("start"), F.col("end")).alias("context"), T.same_letters(F.col("original"), F.col("corrected")).alias("is_ocr_error"))


def surface_forms(changes: DataFrame) -> DataFrame:
    """(corrected, original, n) of the changes of punctuation, space or case alone: forms of the same word."""
    return changes.where("is_ocr_error").groupBy("corrected", "original").agg(F.count("*").alias("n"))


def spelling_errors(changes: DataFrame) -> DataFrame:
    """The changes that differ in letters."""
    return changes.where("not is_ocr_error")


def nested_counts(forms: DataFrame) -> DataFrame:
    """(corrected, originals): a map of the originals' counts."""
    return forms.groupBy("corrected").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original", "n")))).alias("originals"))
