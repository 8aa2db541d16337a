"""`df.write.format("crops")`: parts of grey pages as PNG files, all of a write's or none."""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import package

#: Columns of a write: where the crop goes below the path, the page's bytes and size, and the box (ends not included).
COLUMNS = ("folder", "name", "grey", "width", "x1", "y1", "x2", "y2")
MAGIC = b"\x89PNG\r\n\x1a\n"
#: Folders, or files of one, that are moved at a time when a write is committed; files that a task reads at a time, and folders a task.
MOVES, FILES, FOLDERS = 32, 1024, 2048
#: How often an abort takes its folder away again.
TRIES = 20


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG; rows are stored unfiltered."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.pad(np.ascontiguousarray(grey), ((0, 0), (1, 0)))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey PNG with unfiltered rows, as `png` writes them; others are refused."""
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG")
    at, body, size = len(MAGIC), b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"the checksum of {kind.decode()} is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:]


@dataclass
class Written(WriterCommitMessage):
    task: str
    folders: list[str]


class CropWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the write's own, each under a name of its own; the commit moves what finished tasks wrote
    to its place, and an abort takes the folder away, with what lost or failed tasks left in it.

    A folder of crops that one task wrote and that isn't there yet is moved as a whole, others file by file.
    """

    def __init__(self, options: dict, overwrite: bool):
        root = options["path"]
        self.root, self.overwrite = (root if "://" in root else f"file://{root}").rstrip("/"), overwrite
        self.own = f"_staged-{uuid.uuid4().hex}"
        system, top = pafs.FileSystem.from_uri(self.root)
        system.create_dir(f"{top}/{self.own}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = pafs.FileSystem.from_uri(self.root)
        task, folders, made = uuid.uuid4().hex, set(), set()

        def make(folder: str) -> None:
            """Level by level: a task that goes on after an abort finds no folder to write to, and fails."""
            if folder not in made:
                if folder:
                    make(folder.rpartition("/")[0])
                system.create_dir("/".join(x for x in (top, self.own, task, folder) if x), recursive=False)
                made.add(folder)

        for b in iterator:
            for r in b.select(list(COLUMNS)).to_pylist():
                page = np.frombuffer(r["grey"], np.uint8).reshape(-1, r["width"])
                part = page[r["y1"] : r["y2"], r["x1"] : r["x2"]]
                if not part.size:
                    raise ValueError(f"{r['folder']}/{r['name']}: the box is empty")
                make(r["folder"])
                with system.open_output_stream(f"{top}/{self.own}/{task}/{r['folder']}/{r['name']}") as f:
                    f.write(png(part))
                folders.add(r["folder"])
        return Written(task, sorted(folders))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = pafs.FileSystem.from_uri(self.root)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
                if f.base_name != self.own:
                    (system.delete_file if f.is_file else system.delete_dir)(f.path)
        tasks: dict[str, list[str]] = {}
        for m in messages:
            for folder in m.folders if m else ():
                tasks.setdefault(folder, []).append(m.task)
        above = {f[:i] for f in tasks for i, c in enumerate(f) if c == "/"}
        for parent in sorted(above) or [""]:
            system.create_dir(f"{top}/{parent}".rstrip("/"), recursive=True)

        def one_by_one(folder: str, task: str) -> None:
            system.create_dir(f"{top}/{folder}", recursive=True)
            for f in system.get_file_info(pafs.FileSelector(f"{top}/{self.own}/{task}/{folder}")):
                if f.is_file:
                    system.move(f.path, f"{top}/{folder}/{f.base_name}")

        def place(folder: str) -> None:
            whole = folder and len(tasks[folder]) == 1 and folder not in above and system.get_file_info(f"{top}/{folder}").type == pafs.FileType.NotFound
            if whole:
                try:
                    return system.move(f"{top}/{self.own}/{tasks[folder][0]}/{folder}", f"{top}/{folder}")
                except (OSError, NotImplementedError):  # stores that move files only
                    pass
            for task in tasks[folder]:
                one_by_one(folder, task)

        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(place, tasks):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = pafs.FileSystem.from_uri(self.root)
        for left in range(TRIES, -1, -1):
            try:
                if system.get_file_info(f"{top}/{self.own}").type == pafs.FileType.NotFound:
                    break
                system.delete_dir(f"{top}/{self.own}")
            except OSError:  # a task that is being ended wrote a file between the listing and the removal
                if not left:
                    raise
                time.sleep(0.1)


class Crops(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crops"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"crops need the columns {', '.join(missing)}")
        return CropWriter(dict(self.options), overwrite)


def write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the boxes of pages to `path`/folder/name; other columns don't matter.

    An empty box, or a page whose bytes don't fill its rows, fails the write, and no crop of it is left.  Names are distinct
    in a folder; of rows that repeat one, either stays.
    """
    package.send(rows.sparkSession)
    rows.sparkSession.dataSource.register(Crops)
    rows.select(*COLUMNS).write.format("crops").mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, grey of the PNG files below a folder that `write` left.

    Only the folders in the path are listed here; tasks list and read what is in them, many files a task.
    """
    package.send(spark)
    root = (path if "://" in path else f"file://{path}").rstrip("/")
    system, top = pafs.FileSystem.from_uri(root)
    held = [(f.base_name, f.is_file) for f in system.get_file_info(pafs.FileSelector(top)) if not f.base_name.startswith(("_", "."))]
    names = spark.createDataFrame(pa.table({"name": pa.array([n for n, _ in held], pa.string()), "is_file": pa.array([x for _, x in held], pa.bool_())}))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(held) // FOLDERS))

    def below(system, top: str, batches) -> Iterator[str]:
        """Paths of PNG files below the top."""
        for df in batches:
            for name, is_file in zip(df.name, df.is_file, strict=True):
                found = [name] if is_file else sorted(f.path[len(top) + 1 :] for f in system.get_file_info(pafs.FileSelector(f"{top}/{name}", recursive=True)) if f.is_file)
                yield from (x for x in found if x.endswith(".png") and not any(p.startswith(("_", ".")) for p in x.split("/")))

    def run(batches):
        system, top = pafs.FileSystem.from_uri(root)
        files = below(system, top, batches)
        while part := list(islice(files, FILES)):
            found = []
            for x in part:
                with system.open_input_stream(f"{top}/{x}") as f:
                    found.append(pixels(f.read()))
            yield pd.DataFrame({"path": [f"{root}/{x}" for x in part], "height": [x.shape[0] for x in found], "width": [x.shape[1] for x in found], "grey": [x.tobytes() for x in found]})

    return names.repartition(parts).mapInPandas(run, "path string, height int, width int, grey binary")
