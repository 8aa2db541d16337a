"""SentencePiece ids, fill-in-middle forms and the filter audit against the library and brute force."""

import hashlib
import os
import random
import re
from collections import Counter
from itertools import permutations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lectern.llm import fill_middle, filter_audit, pieces, store

R = random.Random(41)
PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcdeABC'    \n\t.,!?01▁▁é ñÉΣσİ\0", "</s>", "<s>", "<unk>", "<0x0A>", " ", "́", "日本", "ing", "tion", "the ", "  ", "\U0001f600"]
FUZZ = ["".join(R.choice(PARTS) for _ in range(R.randint(0, 40))) for _ in range(3000)] + ["", None, " ", "  ", "▁", "▁ ", "a ", " a", "x" * 5000, "a b " * 30000, " " * 5000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def coded(sp, whole):
    ids = sp.encode(whole, add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))


def middled(key, whole):
    """The contract read line by line: count, cut, mark."""
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lines, at = [], 0
    while at < len(whole):
        end = whole.find("\n", at) + 1 or len(whole)
        lines.append(whole[at:end])
        at = end
    n = len(lines)
    if not whole or any(m in whole for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return key, n, "plain", None, None, sha(whole), sha(whole)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return key, n, "spm" if h4 % 100 < 50 else "psm", len(p), len(m), sha(out), sha(whole)


def audited(docs, labels):
    """docs: (id, text, source); every order replayed over every document."""
    least, facts = {}, []
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        facts.append((s or "", fails, i in good, i in toxic))
    out = set()
    for part in {s for s, *_ in facts}:
        of, rows, shapley = [f for f in facts if f[0] == part], [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = of
            for k, c in enumerate(order):
                gone = [f for f in left if f[1][c]]
                redundant = sum(f[1][c] for f in of) - len(gone)
                left = [f for f in left if not f[1][c]]
                shapley[c] += len(gone)
                rows.append((part, order, k + 1, len(left), len(gone), redundant, sum(f[1][c] and sum(f[1].values()) == 1 for f in of), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in rows}
    return out


@pytest.fixture(autouse=True)
def ready(spark):
    store.prepare(spark)


def test_pieces_are_the_librarys(spark):
    df = spark.createDataFrame(list(enumerate(FUZZ)), "doc_id long, text string")
    sp = SentencePieceProcessor(model_file=PATH)
    for r in pieces.encode(df, PATH).collect():
        ids = sp.encode(FUZZ[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, sp.decode(ids)), FUZZ[r.doc_id]
    got = {r.doc_id: tuple(r)[1:] for r in pieces.encode(df, PATH, digests=True).collect()}
    assert got == {i: coded(sp, t or "") for i, t in enumerate(FUZZ)}


def test_whole_texts_where_chunks_would_not_do_and_small_tables(monkeypatch):
    sp, texts = SentencePieceProcessor(model_file=PATH), [t or "" for t in FUZZ[:500]]
    want = [(" ".join(map(str, sp.encode(t, add_eos=True))), sp.decode(sp.encode(t))) for t in texts]
    assert list(zip(*pieces.Coder(PATH, False).encode(texts), strict=True)) == want
    monkeypatch.setattr(pieces, "TABLE", 20)
    monkeypatch.setattr(pieces, "LONGEST", 3)
    coder = pieces.Coder(PATH, True)
    for i in range(0, 500, 10):
        assert list(zip(*coder.encode(texts[i : i + 10]), strict=True)) == want[i : i + 10]


def test_each_chunk_is_segmented_once(monkeypatch):
    coder, seen = pieces.Coder(PATH, True), Counter()
    whole = coder.segmented
    monkeypatch.setattr(coder, "segmented", lambda new: seen.update(new) or whole(new))
    for _ in range(3):
        coder.encode(["one two  two one", "two three ", "one"])
    assert set(seen.values()) == {1} and set(seen) == {"one", "two", " two", "three", ""}


def test_forms_and_back(spark):
    texts = ["".join(R.choice(["ab", "\n", "é", "<", "P>", "S>", "<M", "\r", "日"]) for _ in range(R.randint(0, 25))) for _ in range(1500)] + [None, "", "\n", "a<P>b\nc", "\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("own"))
    out = fill_middle.transform(df).withColumn("back", fill_middle.restored("output", "form")).collect()
    assert [tuple(r)[:3] + tuple(r)[4:6] + (sha(r.output), sha(r.back)) for r in sorted(out, key=lambda r: r.doc_id)] == [middled(i, t or "") for i, t in enumerate(texts)]
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_rates_of_forms(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    n = Counter(r.form for r in fill_middle.transform(df, rate=40, spm=25).collect())
    assert abs(n["plain"] - 2400) < 150 and abs(n["spm"] - 400) < 80
    with pytest.raises(Exception, match="cover"):
        fill_middle.transform(df, unit="[ab]").collect()


def test_trie_is_a_dictionary():
    trie, plain = filter_audit.Trie(), {}
    for j in range(4000):
        key = "".join(R.choice("ab") * R.choice([1, 1, 3, 40]) for _ in range(R.randint(0, 6))).encode()
        trie.insert(key, (j % 50, "p", 0), 1)
        plain.setdefault(key, Counter())[j % 50, "p", 0] += 1
    assert {k: (Counter(rows), low) for k, rows, low in trie.terminals()} == {k: (c, min(i for i, *_ in c)) for k, c in plain.items()}
    left = [trie.root]
    while left:
        node = left.pop()
        assert node is trie.root or node.rows is not None or len(node.children) > 1
        left.extend(node.children.values())


def test_common_prefix():
    for _ in range(3000):
        a, b = (bytes(R.choices(b"ab", [30, 1], k=R.randint(1, 90))) for _ in range(2))
        at = R.randint(0, len(b) - 1)
        assert filter_audit._common(a, b, at) == len(os.path.commonprefix([a, b[at:]]))


@pytest.mark.parametrize("most", [filter_audit.RANGE, 300])
def test_audit_by_brute_force(spark, monkeypatch, most):
    """Long shared beginnings, many copies of one text, and prefixes that have to be lengthened."""
    monkeypatch.setattr(filter_audit, "TRIE", 20_000)
    base = "The same beginning of very many documents, line after line. " * 8
    words = "one two three four Five #six SEVEN eight nine ten".split()
    some = [(base if R.random() < 0.5 else "") + " ".join(R.choices(words, k=R.choice([1, 3, 60, 90]))) for _ in range(120)]
    docs = [(i, R.choice(some) if i % 3 else some[0], R.choice(["a", "b", "", None])) for i in range(900)] + [(None, some[0], "a"), (4, some[0], "b"), (-1, None, "c"), (-2, "", "c")]
    labels = [(i, R.randrange(2), R.randrange(2)) for i in range(0, 900, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)]
    df = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, source string, mask string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.masks(df, most=most), lab)
    assert {tuple(r) for r in out.collect()} == audited(docs, labels)


def test_prefixes_part_what_differs(spark):
    same, other = "x" * 500, "y" * 3
    rows = spark.createDataFrame([(same + str(i),) for i in range(50)] + [(same * 3,)] * 50 + [(other,)] * 5, "body string")
    key = filter_audit.prefix(rows, 1, 4000)
    got = {r.k: r.n for r in rows.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got[other] == 5 and max(n for k, n in got.items() if k != (same * 3)[: len(k)] or len(k) < 500) <= 50 and len(got) > 50
