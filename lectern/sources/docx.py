"""`spark.read.format("docx")`: the paragraphs of Word files as rows, read by the tasks straight from the files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import package

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SIGNS = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
SCHEMA = "path string, pos int, text string"
#: Bytes of files that one task reads, and rows of a batch.
SPLIT, BATCH = 64 << 20, 4096


def texts(source) -> Iterator[str]:
    """Texts of the paragraphs of one file; the document is parsed as it is unpacked, and what was read is let go.

    A paragraph within another, as in a text box, is one of its own and comes first.
    """
    with zipfile.ZipFile(source) as z, z.open("word/document.xml") as body:
        open_: list[list[str]] = []
        for event, x in ElementTree.iterparse(body, ("start", "end")):
            if x.tag == f"{WORD}p":
                if event == "start":
                    open_.append([])
                else:
                    yield "".join(open_.pop())
                    x.clear()
            elif event == "end" and open_:
                open_[-1].append(x.text or "" if x.tag == f"{WORD}t" else SIGNS.get(x.tag, ""))
                x.clear()


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files)
        self.files = files


class DocxReader(DataSourceReader):
    """Files are listed, and others than .docx refused, on the driver; tasks get files of about SPLIT bytes."""

    def __init__(self, options: dict, columns: list[str]):
        root, self.columns = options.get("path"), columns
        if not root:
            raise ValueError("a path to .docx files or a folder of them has to be given")
        self.root = root if "://" in root else f"file://{root}"
        system, top = pafs.FileSystem.from_uri(self.root)
        info = system.get_file_info(top)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(root)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(top, recursive=options.get("recursivefilelookup", options.get("recursiveFileLookup", "false")).lower() == "true"))
        found = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        wrong = [f.path for f in found if not f.path.lower().endswith(".docx")]
        if wrong:
            raise ValueError(f"{wrong[0]}: only .docx files can be read")
        self.files = [(f.path, f.size) for f in found]
        # paths are told as Spark's own sources tell them
        self.prefix = "file:" if self.root.startswith("file:") else self.root.removesuffix(top)

    def partitions(self) -> list[InputPartition]:
        parts, size = [[]], 0
        for path, n in self.files:
            if parts[-1] and size + n > SPLIT:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = {"path": pa.string(), "pos": pa.int32(), "text": pa.string()}
        schema = pa.schema([(c, types[c]) for c in self.columns])
        system, _ = pafs.FileSystem.from_uri(self.root)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            all_ = dict(zip(types, zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(all_[c], types[c]) for c in self.columns], schema=schema)

        for path in partition.files:
            with system.open_input_file(path) as f:
                for i, text in enumerate(texts(f)):
                    rows.append((self.prefix + path, i, text))
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class Docx(DataSource):
    """path, pos, text.  A schema of fewer of these columns reads only those; a folder's files, or one file, are the path."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        DocxReader(dict(self.options), [])  # what can't be read is refused before there is a plan
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(dict(self.options), [f.name for f in schema.fields])


def packed(paragraphs: Column) -> Column:
    """The bytes of a Word file that holds an array of texts as paragraphs; line ends and tabs are told by Word's elements."""
    escaped = lambda t: F.regexp_replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\r", "&#13;")
    cut = lambda t: F.regexp_replace(F.regexp_replace(escaped(t), "\n", "</w:t><w:br/><w:t xml:space=\"preserve\">"), "\t", "</w:t><w:tab/><w:t xml:space=\"preserve\">")
    body = F.transform(paragraphs, lambda t: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), cut(t), F.lit("</w:t></w:r></w:p>")))
    head = f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>'

    @F.pandas_udf("binary")
    def zipped(xml: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", text)
            return out.getvalue()

        return xml.map(one)

    return zipped(F.concat(F.lit(head), F.array_join(body, ""), F.lit("</w:body></w:document>")))


def register(spark: SparkSession) -> None:
    package.send(spark)
    spark.dataSource.register(Docx)


def paragraphs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, pos, text of the paragraphs of a .docx file or of a folder's; a file without paragraphs gives no row, and an
    empty paragraph an empty text."""
    register(spark)
    return spark.read.format("docx").option("recursiveFileLookup", str(recursive).lower()).load(path)
