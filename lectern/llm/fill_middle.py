"""Fill-in-middle texts: each text is cut at two unit boundaries and its middle moved to the end, behind marks.

One fullmatch of (unit)* keeps every repetition of its group, so the ends of that group are the ends of all units: their
number is n, and both cuts are read from them.  A row's draws are the first 32-bit numbers of a hash of seed and id, so a
lost task gives the same rows again.  `restored` undoes the form with expressions.

Defined cases: a null text is an empty one, which is plain, as is a text that holds a mark; a null id draws as the empty
string; rows that repeat an id draw alike; texts of any length are cut whole; an empty table gives an empty one; other
columns are ignored, whatever they are named.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def turned(whole: str, units: regex.Pattern, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[int, str, str, int | None, int | None]:
    """n, form, output and the lengths of prefix and middle; `units` is a pattern of one group that repeats."""
    found = units.fullmatch(whole)
    if found is None:
        raise ValueError("units have to cover every text")
    ends = [0, *found.ends(1)]
    n = len(ends) - 1
    if not whole or PREFIX in whole or SUFFIX in whole or MIDDLE in whole or h[2] % 100 >= rate:
        return n, "plain", whole, None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[low], ends[high]
    if h[3] % 100 < spm:
        return n, "spm", f"{SUFFIX}{whole[b:]}{PREFIX}{whole[:a]}{MIDDLE}{whole[a:b]}", a, b - a
    return n, "psm", f"{PREFIX}{whole[:a]}{SUFFIX}{whole[b:]}{MIDDLE}{whole[a:b]}", a, b - a


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, unit: str = LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form (plain, psm or spm), output, prefix_chars and middle_chars of every row.

    Of 100 texts `rate` are turned, and of these `spm` begin with the suffix; `unit` has to match all of any text when it is
    repeated, and no group of its own may hold captures.
    """
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n", "form", "output", "prefix_chars", "middle_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        units = regex.compile(f"({unit})*")
        for batch, _, _ in text.pieces(batches):
            rows = [turned(t or "", units, draws(seed, k), rate, spm) for k, t in zip(batch.column(0).to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of a form was made from: no part holds a mark, so the marks cut it in three."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(F.substr(output, F.lit(4)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[0], part[2], part[1])).when(form == "spm", F.concat(part[1], part[2], part[0])).otherwise(output)
