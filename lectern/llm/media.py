"""Media columns: payloads kept by content address in tar shards, and rows that carry digest, shard, offset and length.

A text becomes a lossless 8-bit RGB image of 64 pixels a row (PNG; 192 bytes of the padded text a row).  A task adds each
image that is new to it to its own shard, so a row never moves its payload; where several tasks have stored the same
image, the index settles on the first place, and only that is read.  Metadata come from the image header alone, by range
reads of 33 bytes; features come from the payload, by reads of neighbouring ranges at once.

Defined cases: a null or empty text is one row of padding; texts of any length are stored whole, an image each; equal
texts have equal values, and one place; rows with a null id and repeated rows are stored like others; an empty table gives
an empty one; other columns are ignored, whatever they are named.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text
from .warc import ranges

ROW, WIDTH = 192, 64
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 5
#: Bytes of a shard, and images of which a task knows that it has stored them, at most.
SHARD, KNOWN = 1 << 30, 200_000


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 RGB pixels, unfiltered, so that the samples are the payload's bytes in order."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(raw: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or zlib.crc32(raw[12:29]) != struct.unpack(">I", raw[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIBB", raw[16:26])


def from_png(raw: bytes) -> bytes:
    """The samples of an image that `to_png` made, checked against its chunks' sums."""
    _, height, _, _ = header(raw)
    at, data = HEADER, []
    while True:
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IEND":
            break
        data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG row")
    return lines[:, 1:].tobytes()


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's payload; returns id, n_bytes, digest, shard, offset, length, itself stored in `folder`."""
    kind = dict(docs.dtypes)[id_col]

    def write(batches):
        out, name, at, seen = None, "", 0, {}
        try:
            for batch, data, edge in text.pieces(batches):
                raw = data.tobytes()
                cols: list[list] = [[], [], [], []]
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    payload = padded(raw[a:b])
                    own = hashlib.sha256(payload).digest()
                    if own not in seen:
                        if out is None or at >= SHARD:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            name, at, seen = f"{folder}/shards/{uuid.uuid4().hex}.tar", 0, {}
                            out = store.open_write(name)
                        png = to_png(payload)
                        digest = hashlib.sha256(png).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(png)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + png + bytes(-len(png) % 512))
                        if len(seen) >= KNOWN:
                            seen.clear()
                        seen[own] = (digest, name, at + len(head), len(png))
                        at += len(head) + len(png) + -len(png) % 512
                    for c, v in zip(cols, seen[own], strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=[id_col, "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return store.saved(rows.mapInArrow(write, f"`{id_col}` {kind}, n_bytes long, digest string, shard string, offset long, length long"), folder, "rows")


def places(rows: DataFrame) -> DataFrame:
    """One place of each digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def _in_order(places: DataFrame) -> DataFrame:
    return places.repartition("shard", F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("shard", "offset")


def read_headers(places: DataFrame) -> DataFrame:
    """digest, width, height, depth of each place, from its first 33 bytes."""

    def read(batches):
        opened, f = "", None
        for batch in batches:
            out = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if shard != opened:
                    opened, f = shard, store.open_read(shard)
                out.append(header(f.read_at(HEADER, offset))[:3])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *[pa.array([x[i] for x in out], pa.int32()) for i in range(3)]], names=["digest", "width", "height", "depth"])

    return _in_order(places).mapInArrow(read, "digest string, width int, height int, depth int")


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_payloads(places: DataFrame) -> DataFrame:
    """Digests, sums and features of each place's payload, computed from the stored bytes."""

    def read(batches):
        opened, f = "", None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length")), strict=True))
            out, i = [], 0
            for shard, start, end, n in ranges(rows):
                if shard != opened:
                    opened, f = shard, store.open_read(shard)
                data = f.read_at(end - start, start)
                for _, offset, length in rows[i : i + n]:
                    png = data[offset - start : offset - start + length]
                    width, height, depth, _ = header(png)
                    payload = from_png(png)
                    samples = np.frombuffer(payload, np.uint8)
                    feature = f"{width}x{height} rgb{depth} sum={int(samples.sum(dtype=np.int64))} max={int(samples.max())}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, hashlib.sha256(png).hexdigest(), feature))
                i += n
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *[pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)]], names=[x.split()[0] for x in FACTS.split(", ")])

    return _in_order(places).mapInArrow(read, FACTS)
