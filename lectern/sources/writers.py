"""Sinks: line tables, nested page documents, metric documents, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def line_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def page_documents(lines: DataFrame, page: str, order: str, columns: list[str]) -> DataFrame:
    """A row per page with its lines nested in order, and their number."""
    nested = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return lines.groupBy(page).agg(nested.alias("lines"), F.count("*").cast("int").alias("total_lines"))


def json_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def metrics_document(metrics: DataFrame) -> DataFrame:
    """One row with metrics by stage from (stage, CER, WER).  Samples are rows of a file of their own."""
    return metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("CER", "WER"))))).alias("metrics"))


def percent(x: Column) -> Column:
    """A share as a percentage with two places."""
    return F.format_string("%.2f%%", x * 100)


def text_lines(rows: DataFrame, path: str, order: str, text: str) -> None:
    """Lines in order, as text files."""
    rows.orderBy(order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def text_meta(rows: DataFrame, page: str, text: str, status: str) -> DataFrame:
    """What goes beside a page's text: lines, words, and how many lines have each status."""
    by = rows.groupBy(page, status).agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col(text)))).alias("w"))
    return by.groupBy(page).agg(F.sum("n").alias("lines"), F.sum("w").alias("words"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("statuses"))


def json_array(rows: DataFrame, path: str) -> None:
    """One JSON array a file, an element a row; a task writes its rows as they come."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + x])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def page_files(rows: DataFrame, path: str, folder: str, name: str, content: str) -> int:
    """Write each row's `content` to the file `name` in a folder of its own below `path`; returns how many.

    A file is written beside its place and then moved, so a task that is lost leaves no half of one, and one that runs again
    writes the same.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pafs.FileSystem.from_uri(path)
        n = 0
        for b in batches:
            for where, file, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system.create_dir(f"{top}/{where}", recursive=True)
                with system.open_output_stream(f"{top}/{where}/_{file}.{n}") as f:
                    f.write(data)
                system.move(f"{top}/{where}/_{file}.{n}", f"{top}/{where}/{file}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files = rows.select(F.col(folder).cast("string"), F.col(name).cast("string"), F.col(content).cast("binary"))
    return files.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
