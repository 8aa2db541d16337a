"""SentencePiece ids by a table of distinct chunks: where no piece crosses a space mark, words are segmented one by one.

A text with its marks is cut before each run of marks.  When no piece of the model holds a mark behind another character,
no merge can join two of these chunks, so each task segments a chunk once, when it first meets it, and joins ids and decoded
text back by position.  The table belongs to a task and is bounded (TABLE chunks, TABLE_CHARS characters; longer chunks
are segmented where they stand), so nothing is shuffled or broadcast and a lost executor costs its own tasks only.
A model that fits this not, or one that alters characters, gets its texts whole.

Defined cases: a null text is an empty one, whose ids are the end id alone; a mark character inside a text counts as a
space, as the library has it; strings of special tokens are ordinary text, and bytes stand for unknown characters; texts of
any length are encoded whole; repeated rows have equal results; an empty table gives an empty one; other columns are ignored,
whatever they are named, and null ids pass through.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

MARK = "▁"
TABLE, TABLE_CHARS, LONGEST = 300_000, 6_000_000, 200


@lru_cache(maxsize=4)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def separable(path: str) -> bool:
    """Whether texts may be cut before each run of marks: by the pieces, and by how the model writes every code point."""
    sp = model(path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in plain):
        return False
    points = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x110000))))
    return sp.normalize(points) == MARK + points.replace(" ", MARK) and sp.normalize("  a  b ") == "___a__b_".replace("_", MARK)


def chunks(whole: str) -> list[str]:
    """The text's chunks, each without the one mark that it begins with."""
    parts = whole.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, gap = [], ""
    for p in parts:
        if p:
            out.append(gap + p)
            gap = ""
        else:
            gap += " "
    if gap and whole:
        out.append(gap[:-1])
    return out


class Coder:
    """A task's table: a chunk's ids in decimal and its decoded text."""

    def __init__(self, path: str, cut: bool):
        self.sp, self.cut = model(path), cut
        self.table: dict[str, tuple[str, str]] = {}
        self.chars = 0

    def segmented(self, new: list[str]) -> list[tuple[str, str]]:
        ids = self.sp.encode(new, num_threads=1)
        if self.cut and "" in new:  # a mark alone, which the library has only behind other text
            ids[new.index("")] = self.sp.encode("a ")[len(self.sp.encode("a")) :]
        return [(" ".join(map(str, i)), s) for i, s in zip(ids, self.sp.decode(ids, num_threads=1), strict=True)]

    def look_up(self, parts: list[list[str]]) -> list[list[tuple[str, str]]]:
        """Ids and decoded text of the chunks of each text, by position."""
        table = self.table
        if len(table) > TABLE or self.chars > TABLE_CHARS:
            table.clear()
            self.chars = 0
        new = list({c for p in parts for c in p if c not in table})
        got = dict(zip(new, self.segmented(new), strict=True))
        for c, value in got.items():
            if len(c) <= LONGEST:
                table[c] = value
                self.chars += len(c)
        return [[table[c] if c in table else got[c] for c in p] for p in parts]

    def encode(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        """Ids with the end id, in decimal and with spaces between, and the decoded text."""
        end = str(self.sp.eos_id())
        if not self.cut:
            whole = self.segmented([t or "" for t in texts])
            return [f"{i} {end}" if i else end for i, _ in whole], [s for _, s in whole]
        rows = self.look_up([chunks(t) if t else [] for t in texts])
        return [" ".join([*(i for i, _ in r), end]) for r in rows], [" ".join([s for _, s in r]) for r in rows]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_tokens, ids (with the end id) and decoded of every row; with `digests`, SHA-256 of both instead (ids in decimal)."""
    kind, cut = dict(docs.dtypes)[id_col], separable(path)

    def run(batches):
        coder = Coder(path, cut)
        for batch, _, _ in text.pieces(batches):
            ids, shown = coder.encode(batch.column("text").to_pylist())
            n = pa.array([s.count(" ") + 1 for s in ids], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in y], pa.string()) for y in (ids, shown)]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                cols = [pa.array([[int(x) for x in s.split()] for s in ids], pa.list_(pa.int32())), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], names=[id_col, "n_tokens", "ids", "decoded"])

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {out}")
