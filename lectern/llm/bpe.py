"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (the tokenizer's own whole words, and the corpus's, of which every one is counted) are compiled into an automaton
that shares prefixes and suffixes.  Each transition carries the number of words that it passes by, so the sum over a path
is the word's number, and that number gives the word's ids: the outputs that make it a transducer.  The automaton is one
file in the shared folder, which workers map into memory.  A word outside it is merged exactly by the tokenizer's model,
and kept in a bounded cache of the worker.

The classes of code points come from the tokenizer's own pre-tokenizer, and a text with a code point that Python's
Unicode normalizes otherwise than the tokenizer's is normalized by that.

Defined cases: a null or empty text has no ids and decodes to the empty text; special strings inside a text become their
ids, as the library has it by default; texts and words of any length are encoded whole; which of equally frequent words
are in the lexicon doesn't matter to the ids; repeated rows give equal rows; an empty table gives an empty one; other
columns are ignored, whatever they are named.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequent, store, text
from .token_counts import byte_alphabet, kinds, specials, tokenizer

#: So many words of the corpus are compiled at most, and each task proposes so many of its own.
LEXICON, PROPOSED = 65_536, 16_384
#: Entries of a worker's cache, and the longest word in it.
CACHE, LONG = 200_000, 256
END = "</w>"


def normal(t: str) -> str:
    """The tokenizer's normalizer, but for white space, which its pattern drops anyway; lower case goes by character."""
    return unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def strange(path: str) -> np.ndarray:
    """Code points in whose company `normal` may differ from the tokenizer's normalizer, by another version of Unicode."""
    own = tokenizer(path).normalizer.normalize_str
    every = np.delete(text.code_points(), ord("."))
    chars = [*map(chr, every.tolist())]
    out = np.zeros(0x110000, bool)
    out[every] = [a != b and not c.isspace() for c, a, b in zip(chars, own(".".join(chars)).split("."), map(normal, chars), strict=True)]
    for c in chars:
        if unicodedata.combining(c):
            x, y = f"a{c}\u0334", f"a\u0300{c}"
            out[ord(c)] |= own(x) != normal(x) or own(y) != normal(y)
        apart = unicodedata.normalize("NFD", c)
        if apart != c and own(apart) != normal(apart):
            out[[ord(c), *map(ord, apart)]] = True
    return out


def tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """What workers need to know of the tokenizer's Unicode: made on the driver, broadcast."""
    return kinds(path), strange(path)


class Words:
    """Cuts texts into the tokenizer's words."""

    def __init__(self, path: str, kinds: np.ndarray, strange: np.ndarray):
        self.special, self.kinds, self.strange = specials(path), kinds, strange
        self.own = tokenizer(path).normalizer.normalize_str

    def normal(self, parts: list[str]) -> list[str]:
        cp, at = text.codepoints(parts)
        hit = np.flatnonzero(self.strange[cp])
        odd = set((np.searchsorted(at, hit, "right") - 1).tolist())
        return [self.own(p) if i in odd else normal(p) for i, p in enumerate(parts)]

    def cut(self, texts: list[str | None]):
        """Joined string, begin, end and hash of each word, the words of each piece; owners of pieces and special strings."""
        parts, owner, found = text.split_special(texts, self.special)
        parts = self.normal(parts)
        cp, at = text.codepoints(parts)
        first, end, per = text.word_level_tokens(cp, at, self.kinds)
        return "".join(parts), first, end, text.hashes(text.code_values(cp), first, end), per, owner, found


class Automaton:
    """A minimal acyclic automaton over bytes, as flat arrays: transitions sorted by state and byte."""

    FIELDS = ("keys", "target", "skip", "final", "offset", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Automaton:
        """Words are added in order; when a word leaves a branch, its states are replaced by equal ones that exist."""
        ordered = sorted(words)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]
        free: list[int] = []

        def settle(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                s = path.pop()
                key = (final[s], *edges[s].items())
                if (other := known.setdefault(key, s)) != s:
                    edges[path[-1]][word[len(path) - 1]] = other
                    free.append(s)

        before = b""
        for w in ordered:
            same = 0
            while same < min(len(w), len(before)) and w[same] == before[same]:
                same += 1
            settle(same, before)
            for b in w[same:]:
                if free:
                    s = free.pop()
                    edges[s], final[s] = {}, False
                else:
                    s = len(edges)
                    edges.append({})
                    final.append(False)
                edges[path[-1]][b] = s
                path.append(s)
            final[path[-1]] = True
            before = w
        settle(0, before)
        number = {0: 0}
        order = [0]
        for s in order:
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        size: dict[int, int] = {}

        def count(top: int) -> None:
            stack = [top]
            while stack:
                s = stack[-1]
                need = [t for t in edges[s].values() if t not in size]
                if need:
                    stack += need
                else:
                    size[s] = final[s] + sum(size[t] for t in edges[s].values())
                    stack.pop()

        count(0)
        rows = []
        for s in order:
            skip = int(final[s])
            for b in sorted(edges[s]):
                t = edges[s][b]
                rows.append((number[s] << 8 | b, number[t], skip))
                skip += size[t]
        r = np.array(rows, np.int64).reshape(-1, 3)
        ids = [words[w] for w in ordered]
        return cls(keys=r[:, 0].copy(), target=r[:, 1].copy(), skip=r[:, 2].copy(), final=np.array([final[s] for s in order], np.int64), offset=np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), ids=np.array([i for x in ids for i in x], np.int64))

    def save(self, uri: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, k), "<i8") for k in self.FIELDS]
        store.write_file(uri, [np.array([len(a) for a in arrays], "<i8").tobytes(), *[a.tobytes() for a in arrays]])

    @classmethod
    def load(cls, uri: str) -> Automaton:
        raw = store.mapped(uri).view("<i8")
        at, out = len(cls.FIELDS), {}
        for k, n in zip(cls.FIELDS, raw[:at].tolist(), strict=True):
            out[k] = raw[at : at + n]
            at += n
        return cls(**out)

    def find(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each word data[at[i]:at[i + 1]], -1 where it is not in; all words step at once."""
        n = len(at) - 1
        out = np.full(n, -1, np.int64)
        size = np.diff(at)
        live, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        p = 0
        while len(live):
            done = size[live] == p
            if done.any():
                over = live[done]
                ok = self.final[state[over]] > 0
                out[over[ok]] = total[over[ok]]
                live = live[~done]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | data[at[live] + p]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            live, i = live[hit], i[hit]
            state[live] = self.target[i]
            total[live] += self.skip[i]
            p += 1
        return out


def merges(path: str):
    """A function that gives the ids of one pre-token, by the model's merges."""
    forth = {b: c for c, b in byte_alphabet().items()}
    model = tokenizer(path).model
    return lambda word: [t.id for t in model.tokenize("".join([forth[b] for b in word.encode()]))]


def vocabulary_words(path: str) -> list[str]:
    """Whole words of the tokenizer's vocabulary that its pattern leaves in one piece."""
    back, out = byte_alphabet(), set()
    for entry in tokenizer(path).get_vocab(with_added_tokens=False):
        if entry.endswith(END):
            try:
                w = bytes(back[c] for c in entry.removesuffix(END)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if w and normal(w) == w:
                out.add(w)
    words = sorted(out)
    cp, at = text.codepoints(words)
    first, end, _ = text.word_level_tokens(cp, at, kinds(path))
    whole = set(zip(first.tolist(), end.tolist(), strict=True))
    return [w for w, a, b in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True) if (a, b) in whole]


def corpus_words(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON, each: int = PROPOSED) -> list[str]:
    """The words most frequent in all rows: every word is counted, within the error that `frequent` states.

    Ids don't depend on the choice, since a word outside the lexicon is merged exactly.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def cut():
        words = Words(path, *shared.value)
        return lambda texts: words.cut(texts)[:4]

    return frequent.segments(docs.select(F.col(text_col).cast("string").alias("text")), cut, each, most)


def compile_lexicon(docs: DataFrame, path: str, folder: str, text_col: str = "text") -> str:
    """Build the automaton of frequent words, store it in the shared folder and return its place."""
    words = dict.fromkeys([*vocabulary_words(path), *corpus_words(docs, path, text_col)])
    uri = f"{folder}/lexicon.bin"
    merge = merges(path)
    Automaton.build({w.encode(): merge(w) for w in words}).save(uri)
    return uri


class Coder:
    """A worker's encoder: the mapped automaton, then its cache of merged words."""

    def __init__(self, path: str, lexicon: str, kinds: np.ndarray, strange: np.ndarray):
        self.auto, self.cutter = Automaton.load(lexicon), Words(path, kinds, strange)
        tok = tokenizer(path)
        self.special_ids = {s: tok.token_to_id(s) for s in self.cutter.special}
        self.tokens = [t.encode() if t is not None else b"" for t in map(tok.id_to_token, range(tok.get_vocab_size()))]
        n = len(self.auto.offset) - 1
        self.ids: np.ndarray = np.full(n, None, object)
        self.shown: np.ndarray = np.full(n, None, object)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.merge = merges(path)

    def both(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian words, and the tokens that they decode to, with the library's space between."""
        return np.array(ids, "<u4").tobytes(), b" ".join([self.tokens[i] for i in ids])

    def merged(self, word: str) -> tuple[bytes, bytes]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.both(self.merge(word))
            if len(word) <= LONG:
                self.cache[word] = got
        return got

    def coded(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and decoded tokens of distinct words."""
        data = [w.encode() for w in found]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))]).astype(np.int64)
        number = self.auto.find(np.frombuffer(b"".join(data), np.uint8), at)
        hit = number >= 0
        for i in np.unique(number[hit]).tolist():
            if self.ids[i] is None:
                self.ids[i], self.shown[i] = self.both(self.auto.ids[self.auto.offset[i] : self.auto.offset[i + 1]].tolist())
        ids, shown = np.full(len(found), None, object), np.full(len(found), None, object)
        ids[hit], shown[hit] = self.ids[number[hit]], self.shown[number[hit]]
        for i in np.flatnonzero(~hit).tolist():
            ids[i], shown[i] = self.merged(found[i])
        return ids, shown

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian words) and the decoded text (UTF-8) of each text."""
        joined, first, end, h, per, owner, found = self.cutter.cut(texts)
        _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, shown = self.coded([joined[a:b] for a, b in zip(first[index].tolist(), end[index].tolist(), strict=True)])
        all_ids, all_shown = ids[inverse].tolist(), shown[inverse].tolist()
        edge = np.concatenate([[0], np.cumsum(per)]).tolist()
        if not found:
            return [b"".join(all_ids[a:b]) for a, b in zip(edge, edge[1:])], [b" ".join(all_shown[a:b]) for a, b in zip(edge, edge[1:])]
        out: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        before = dict(found)
        for j, i in enumerate(owner.tolist()):
            if j in before:
                a, b = self.both([self.special_ids[before[j]]])
                out[i][0].append(a)
                out[i][1].append(b)
            out[i][0].extend(all_ids[edge[j] : edge[j + 1]])
            out[i][1].extend(all_shown[edge[j] : edge[j + 1]])
        return [b"".join(a) for a, _ in out], [b" ".join(b) for _, b in out]


def encode(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_tokens, ids and decoded of every row; with `digests`, the SHA-256 of ids and decoded text instead of them."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        coder = Coder(path, lexicon, *shared.value)
        for batch, _, _ in text.pieces(batches):
            ids, shown = coder.encode(batch.column("text").to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, shown)]
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.ListArray.from_arrays(at, flat), pa.array([x.decode() for x in shown], pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {out}")
