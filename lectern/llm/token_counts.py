"""Counts of a byte-level BPE tokenizer's tokens, looked up map-side in two tiers, with no pre-token of a text shuffled.

Tier one is a compact hash table of pre-token lengths, broadcast: the entries of the tokenizer's vocabulary that are a
pre-token by themselves, and the corpus's most frequent pre-tokens that are none of those (`frequent.segments`), FREQUENT
at most.  What it misses goes to a bounded cache of each worker, which the library fills by encoding each new pre-token.

Defined cases: a null or empty text has no bytes and no tokens; special strings inside a text count as the library has
them by default, one token each; a text of any length is counted whole, as is a pre-token; repeated rows count alike; ties
among frequent pre-tokens don't matter to the counts; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequent, text

#: Entries of a worker's cache; frequent pre-tokens of the corpus in tier one, and those that each task proposes.
CACHE, FREQUENT, PROPOSED = 400_000, 65_536, 16_384


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def kinds(path: str) -> np.ndarray:
    """Classes of code points by the tokenizer's own pre-tokenizer: made on the driver, broadcast to tasks."""
    return text.classes(tokenizer(path).pre_tokenizer.pre_tokenize_str)


def table(path: str, words: list[str]) -> text.HashTable:
    """Lengths of those of the distinct words that are one pre-token."""
    tok = tokenizer(path)
    cp, at = text.codepoints(words)
    _, count = text.byte_level_tokens(cp, at, kinds(path))
    one = np.flatnonzero(count == 1)
    size = [len(e) for e in tok.encode_batch([words[i] for i in one], add_special_tokens=False)]
    return text.HashTable(text.hashes(text.code_values(cp), at[:-1][one], at[1:][one]), np.array(size, np.int32))


def vocabulary(path: str) -> list[str]:
    back, found = byte_alphabet(), set()
    for entry in tokenizer(path).get_vocab(with_added_tokens=False):
        try:
            found.add(bytes(back[c] for c in entry).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    return sorted(found - {""})


class Counter:
    """A worker's counter: the broadcast table, and its own cache of what that misses."""

    def __init__(self, path: str, kinds: np.ndarray, table: text.HashTable):
        self.path, self.kinds, self.table, self.special, self.cache = path, kinds, table, specials(path), {}

    def cut(self, texts: list[str | None]):
        """Code points, joined string, begins and ends of the pre-tokens, their number in each piece; owners and special strings."""
        parts, owner, found = text.split_special(texts, self.special)
        cp, at = text.codepoints(parts)
        first, per = text.byte_level_tokens(cp, at, self.kinds)
        return cp, "".join(parts), first, np.append(first[1:], len(cp)) if len(first) else first, per, owner, found

    def missed(self, texts: list[str | None]):
        """The pre-tokens that the table has not, for `frequent.segments`."""
        cp, joined, first, end, *_ = self.cut(texts)
        h = text.hashes(text.code_values(cp), first, end)
        miss = self.table.find(h) < 0
        return joined, first[miss], end[miss], h[miss]

    def lengths(self, cp: np.ndarray, joined: str, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = text.hashes(text.code_values(cp), first, end)
        out = self.table.find(h)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            key, index, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            if len(self.cache) > CACHE:
                self.cache.clear()
            keys = key.tolist()
            got = [self.cache.get(k, -1) for k in keys]
            new = [i for i, g in enumerate(got) if g < 0]
            at = miss[index[new]]
            words = [joined[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
            for i, e in zip(new, tokenizer(self.path).encode_batch(words, add_special_tokens=False), strict=True):
                got[i] = self.cache[keys[i]] = len(e)
            out[miss] = np.array(got, np.int32)[inverse]
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        cp, joined, first, end, per, owner, found = self.cut(texts)
        out = np.zeros(len(texts), np.int64)
        if len(first):
            total = np.concatenate([[0], np.cumsum(self.lengths(cp, joined, first, end), dtype=np.int64)])
            edge = np.concatenate([[0], np.cumsum(per)])
            np.add.at(out, owner, total[edge[1:]] - total[edge[:-1]])
        for piece, _ in found:
            out[owner[piece - 1]] += 1
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row's whole text; `path`: a byte-level tokenizer's JSON on every machine."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    known = vocabulary(path)
    first = sc.broadcast((kinds(path), table(path, known)))
    words = frequent.segments(texts.select("text"), lambda: Counter(path, *first.value).missed, PROPOSED, FREQUENT)
    shared = sc.broadcast((kinds(path), table(path, [*known, *words])))
    kind = dict(docs.dtypes)[id_col]

    def count(batches):
        counter = Counter(path, *shared.value)
        for batch, _, at in text.pieces(batches):
            n = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
