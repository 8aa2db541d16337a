"""WARC archives, index first: each record's file, offset, length, URL and digest are rows; reads go by those.

Writing: records are gzip members of their own, so any byte range of the index opens alone.  Records with equal payloads
are stored once: the one with the largest id is the response, the others are revisits that name it.  Reading: the chosen
index rows are sorted by file and offset, and neighbouring ranges are fetched by one read.

Defined cases: a null payload is the empty one; a null or empty URL gives a record without WARC-Target-URI; control
characters in URLs are percent-encoded; rows that repeat the largest id are all responses; a null id is never the largest,
and is a response only if no other id has that payload; payloads of any length are one record; an empty table gives an empty
index; other columns of the input are ignored, whatever they are named.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
DATE = "2000-01-01T00:00:00Z"
SHARD = 1 << 30
GAP, READ = 64 << 10, 4 << 20
#: Digests of payloads that occur twice which are broadcast at most.
HEADS = 200_000


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unique: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header without the payload."""
    name = page_id if page_id is not None else unique
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its HTTP message, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    own = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(own["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row into archives under `folder`; returns the index, itself stored there.

    Each payload's copies are found by a digest that is counted map-side.  Digests that occur twice are sent to all tasks, so
    that no payload moves, if there are at most HEADS; more are joined by a shuffle, whose skewed keys Spark can split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = rows.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = store.saved(heads, folder, "heads")
    rows = rows.join(F.broadcast(heads) if heads.count() <= HEADS else heads, "sha", "left").select("page_id", "url", "payload", F.unhex("sha").alias("sha"), F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))

    def write(batches):
        out, name, at = None, "", 0
        try:
            for batch in batches:
                cols = {k: [] for k in ("url", "digest", "kind", "file", "offset", "length")}
                for page_id, url, payload, sha, ref in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "sha", "refers_to")), strict=True):
                    if out is None or at >= SHARD:
                        if out is not None:
                            out.close()
                        name, at = f"{folder}/archive/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_write(name)
                    digest = base32(sha)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = z.compress(record(page_id, url, payload.encode(), digest, ref, f"{name[-40:-8]}-{at}")) + z.flush()
                    out.write(raw)
                    for k, v in (("url", url), ("digest", digest), ("kind", "response" if ref is None else "revisit"), ("file", name), ("offset", at), ("length", len(raw))):
                        cols[k].append(v)
                    at += len(raw)
                s = pa.string()
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(cols["url"], s), pa.array(cols["digest"], s), pa.array(cols["kind"], s), batch.column("refers_to"), pa.array(cols["file"], s), pa.array(cols["offset"], pa.int64()), pa.array(cols["length"], pa.int64())], names=["page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return store.saved(rows.mapInArrow(write, INDEX), folder, "index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ):
    """Neighbouring (file, offset, length) in order, joined to reads: yields file, start, end and the number of rows."""
    i = 0
    while i < len(rows):
        name, start, n = rows[i]
        end, j = start + n, i + 1
        while j < len(rows) and rows[j][0] == name and start <= rows[j][1] <= end + gap and max(end, rows[j][1] + rows[j][2]) - start <= most:
            end = max(end, rows[j][1] + rows[j][2])
            j += 1
        yield name, start, end, j - i
        i = j


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that the index rows name; digests and lengths come from the archives' bytes.

    A response's digest is computed from its payload and must equal the one in its header.
    """

    def read(batches):
        opened, f = "", None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            out, i = [], 0
            for name, start, end, n in ranges(rows):
                if name != opened:
                    opened, f = name, store.open_read(name)
                data = f.read_at(end - start, start)
                for _, offset, length in rows[i : i + n]:
                    own, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest, size = own["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if own["WARC-Type"] == "response" and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
                        raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                    ref = own.get("WARC-Refers-To")
                    out.append((own["WARC-Type"], int(ref.rpartition(":")[2][:-1]) if ref else None, size, digest))
                i += n
            kind, ref, size, digest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(kind, pa.string()), pa.array(ref, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    part = F.floor(F.col("offset") / (64 << 20))
    return index.repartition("file", part).sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
