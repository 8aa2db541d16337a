"""Dictionaries and the substitution rules for old spellings, as joins of distinct tokens with a word table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared
from .spread import spread


def dictionary(texts: DataFrame, text_col: str) -> DataFrame:
    """Distinct normalised words of a text column.  What is known is decided by the caller, never by a default file."""
    return texts.select(F.explode(T.words(F.col(text_col))).alias("w")).select(T.word_key(F.col("w")).alias("word")).where("word <> ''").distinct()


def word_list(spark, words: str) -> DataFrame:
    """A dictionary from a string of words, such as a file's content."""
    return spark.createDataFrame([(w,) for w in words.split()], "w string").select(T.word_key(F.col("w")).alias("word")).distinct()


def out_of_vocabulary(words: DataFrame, known: DataFrame, word_col: str = "word", count_col: str = "n", *keys: str) -> DataFrame:
    """Tokens and unknown tokens by key; `words` has counts already, so only distinct words are joined."""
    marked = words.join(known.select(F.col("word").alias(word_col), F.lit(True).alias("__known")), word_col, "left")
    return marked.groupBy(*keys).agg(F.sum(count_col).alias("tokens"), F.coalesce(F.sum(F.when(F.col("__known").isNull(), F.col(count_col))), F.lit(0)).alias("unknown"))


def _changed(t: DataFrame, known: DataFrame) -> DataFrame:
    """(token, corrected) of distinct tokens for which a spelling is listed, as `corrections` says."""
    letters = F.regexp_replace("token", f"[^{T.EDGE}]", "")
    before, core, after = T.edges(F.col("token"))
    t = t.select("token", letters.alias("letters"), before.alias("before"), core.alias("core"), after.alias("after")).withColumn("word", T.word_key(F.col("letters")))
    open_ = t.where(F.length("letters") >= 2).join(known, "word", "left_anti").select("token", "before", "core", "after")
    spellings = F.flatten(F.transform(T.variants(F.col("core"), "uv"), lambda v: T.variants(v, "fs")))
    # a spelling has the letters of its core but for the exchanged ones, so only cores with a listed word of the same such form are spelled
    form = lambda c: F.translate(c, "vf", "us").alias("form")
    cores = open_.select("core").distinct().withColumn("form", form(T.word_key(F.col("core")))).join(known.select(form(F.col("word"))).distinct(), "form", "left_semi")
    cases = spread(cores).select("core", F.explode(spellings).alias("v")).where("v <> core").withColumn("word", T.word_key(F.col("v")))
    listed = cases.join(known, "word", "left_semi").groupBy("core").agg(F.collect_set("v").alias("hits"))
    # every step's choices are among the spellings of the core, so one lookup serves them all
    x = open_.join(listed, "core")
    x = x.withColumn("uv", F.array_min(F.array_intersect("hits", T.variants(F.col("core"), "uv")))).withColumn("base", F.coalesce("uv", "core"))
    x = x.withColumn("fs", F.array_min(F.filter(F.array_intersect("hits", T.variants(F.col("base"), "fs")), lambda v: v != F.col("base"))))
    return x.select("token", F.concat("before", F.coalesce("fs", "uv", F.array_min("hits")), "after").alias("corrected"))


def corrections(tokens: DataFrame, known: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, corrected) of every distinct token, after the line's cedillas were replaced.

    A token of fewer than two letters, or whose letters are listed, stays.  Otherwise its core is replaced by a listed
    spelling with u and v exchanged, then that by one with f and s exchanged; where neither is found, by one with both.
    What stands around the core stays.  Of several listed spellings the first in order is taken.
    """
    t = tokens.select(F.col(token_col).alias("token")).distinct()
    return t.join(_changed(t, known), "token", "left").withColumn("corrected", F.coalesce("corrected", "token"))


#: Bytes of changed tokens, with 48 for each, in a range of them.
RANGE = 8 << 20


def _ranges(fixed: DataFrame, folder: str, n: int) -> dict[int, str]:
    """Write (h, token, corrected) in n ranges, each a file that can be mapped, in the order of h; their names."""
    columns = ["h", "token", "corrected"]
    h = F.xxhash64("token")
    rows = fixed.select(F.pmod(h, F.lit(n)).cast("int").alias("range"), h.alias("h"), "token", "corrected")

    def run(key: tuple, held: pa.Table) -> pa.Table:
        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        name = f"{key[0].as_py()}-{uuid.uuid4().hex}.arrow"
        held = held.select(columns).sort_by("h").combine_chunks()
        with system.open_output_stream(f"{top}/{name}") as f, pa.ipc.new_file(f, held.schema) as out:
            out.write_table(held)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "name": [name]})

    found = rows.groupBy("range").applyInArrow(run, "range int, name string").collect()  # n rows
    return {r.range: r.name for r in found}


def _mapped(folder: str, name: str) -> pa.Table:
    """A range, mapped; where the folder is not mounted, from the task's own copy, which has no name any more."""
    system, top = pafs.FileSystem.from_uri(folder)
    if isinstance(system, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{top}/{name}")).read_all().combine_chunks()
    with tempfile.NamedTemporaryFile() as own:
        with system.open_input_stream(f"{top}/{name}") as f:
            while part := f.read(1 << 20):
                own.write(part)
        own.flush()
        return pa.ipc.open_file(pa.memory_map(own.name)).read_all().combine_chunks()


def _looked_up(words: pa.Array, h: np.ndarray, ranges: dict[int, pa.Table], n: int) -> tuple[np.ndarray, pa.Array]:
    """Which of some words are in the ranges, and what they become."""
    places, found, own = [np.zeros(0, np.int64)], [pa.array([], pa.string())], np.mod(h, n)
    for k, held in ranges.items():
        asked = np.flatnonzero(own == k)
        if not len(asked) or not held.num_rows:
            continue
        keys, tokens, corrected = (held.column(c).chunk(0) for c in ("h", "token", "corrected"))
        keys = keys.to_numpy()
        at = np.searchsorted(keys, h[asked])
        while len(asked):  # of different words with one hash, each looks at the next place
            there = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[asked])
            asked, at = asked[there], at[there]
            same = pc.equal(tokens.take(pa.array(at)), words.take(pa.array(asked))).to_numpy(zero_copy_only=False).astype(bool)
            places.append(asked[same])
            found.append(corrected.take(pa.array(at[same])))
            asked, at = asked[~same], at[~same] + 1
    return np.concatenate(places), pa.concat_arrays(found)


def apply_rules(lines: DataFrame, known: DataFrame, keys: list[str], text_col: str = "line") -> DataFrame:
    """lines with `corrected`: white space is kept, tokens are replaced by their corrections.

    Distinct tokens are counted out map-side and stored; those that the rules change go to files in the shared folder, by ranges
    of their hashes.  Tasks map these and look a line's tokens up where they read it, so lines and their tokens are never
    shuffled, however many tokens are changed.  `keys` name a line.
    """
    text = T.plain_cedilla(F.col(text_col))
    folder = shared.new_folder(lines.sparkSession, "rules")
    known = shared.saved(known, folder, "known")
    tokens = shared.saved(lines.select(F.explode(T.tokens(text)).alias("token")).distinct(), folder, "tokens")
    fixed = shared.saved(_changed(tokens, known).where("corrected <> token"), folder, "fixed")
    size = fixed.agg(F.coalesce(F.sum(F.octet_length("token") + F.octet_length("corrected") + 48), F.lit(0))).first()[0]
    n = int(size // RANGE) + 1
    names = _ranges(fixed, f"{folder}/ranges", n)
    parts = T.with_spaces(text)
    rows = lines.withColumns({"__t": parts, "__h": F.transform(parts, lambda w: F.xxhash64(w))})

    def run(batches):
        ranges = {k: _mapped(f"{folder}/ranges", name) for k, name in names.items()}
        for batch in batches:
            t, h = batch.column("__t"), batch.column("__h")
            size = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
            coded = t.flatten().dictionary_encode()
            code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            hashes = np.zeros(len(words), np.int64)
            hashes[code] = h.flatten().to_numpy(zero_copy_only=False)
            place, new = _looked_up(words, hashes, ranges, n)
            of = np.arange(len(words))
            of[place] = len(words) + np.arange(len(place))
            flat = pa.concat_arrays([words.cast(pa.string()), new]).take(pa.array(of[code]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), "")
            out = pc.if_else(pc.is_valid(t), joined, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in lines_columns), out], names=[*lines_columns, "corrected"])

    lines_columns = lines.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema]
    return rows.mapInArrow(run, ", ".join([*fields, "corrected string"]))
