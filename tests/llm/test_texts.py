"""Operators on single texts against the tokenizers, plain models, and round trips."""

import base64
import hashlib
import math
import random
import re
import tarfile
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, frequent, kneser_ney, langid, media, mixing, quality, store, text, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
R = random.Random(5)
PARTS = [*"abcdeABC'  \n\t'sllreve.,!?0123<|>é ñÉΣσİ", "<|endoftext|>", "<|startoftext|>", " ", "́", "日本", "'s", "'ll", "  "]
FUZZ = ["".join(R.choice(PARTS) for _ in range(R.randint(0, 40))) for _ in range(3000)] + ["", None, "ΑΣ ΑΣ", "İstanbul", "é", "x" * 5000, "a b " * 30000]


@pytest.fixture(autouse=True)
def ready(spark):
    store.prepare(spark)


def docs(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_words_and_shingles():
    column = pa.array(["A b  c", None, "", "\x0bÀ\x1fx y"])
    data, at = text.utf8(column)
    start, end, n = text.words(data, at)
    assert [bytes(data[a:b]) for a, b in zip(start, end, strict=True)] == [b"A", b"b", b"c", "À\x1fx".encode(), b"y"]
    assert n.tolist() == [3, 0, 0, 2]
    h, n = text.word_hashes(*text.utf8(pa.array(["a b a b a b", "A B", "a b"])))
    s = text.shingles(h, n, 3)
    assert [len(x) for x in s] == [2, 1, 1] and s[1] == s[2]
    assert text.utf8(column.slice(2, 2))[1].tolist() == [0, 0, 7]


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(spark, FUZZ), path).collect()}
    for i, t in enumerate(FUZZ):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


def thue_morse(n, swap=False):
    return "".join("ba"[(i.bit_count() + swap) % 2] for i in range(n))


ALIKE = [f"{thue_morse(n, x)} end" for n in (64, 1024, 2048, 4096) for x in (False, True)]


def test_long_words_have_hashes_of_their_own():
    h, n = text.word_hashes(*text.utf8(pa.array(ALIKE)))
    assert n.tolist() == [2] * len(ALIKE) and len(set(h.tolist())) == len(ALIKE) + 1


EVERY = [chr(c) for c in text.code_points()]
SWEEP = [f"a{c}b" for c in EVERY] + [f"1{EVERY[i]} {EVERY[i]}!{EVERY[i]}'s e\u0301{EVERY[i]}\u0323" for i in range(0, len(EVERY), 29)]


def packed(texts, n=500):
    """Many short texts in one row each `n`, so that a sweep is few rows."""
    return ["\n".join(texts[i : i + n]) for i in range(0, len(texts), n)]


def test_token_counts_of_all_code_points_and_alike_words(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = packed(SWEEP) + ALIKE + [f"{c}1" for c in EVERY[0x1C80:0x1C90] + EVERY[0xA7C0:0xA7E0]]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    want = {i: len(e.ids) for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False))}
    assert got == want


def test_bpe_of_all_code_points_and_alike_words(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    apart = [x for c in EVERY if (x := unicodedata.normalize("NFD", c)) != c]
    texts = packed(SWEEP) + packed(apart) + ALIKE + [f"{c}1" for c in EVERY[0x1C80:0x1C90] + EVERY[0xA7C0:0xA7E0]]
    d = docs(spark, texts)
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode(d, path, bpe.compile_lexicon(d.limit(3), path, store.new_folder(spark, "bpe")), digests=True).collect()}
    want = {i: hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False))}
    assert got == want


def test_frequent_segments_are_found_however_spread(spark, monkeypatch):
    """A word twice in each of many chunks, among others that come once."""
    monkeypatch.setattr(text, "CHUNK", 2000)
    monkeypatch.setattr(frequent, "LONGEST", 20)
    rows = ["qzx " + " ".join("w" + "".join(R.choices("abcdefgh", k=7)) for _ in range(200)) + " qzx " + "long" * 5 for _ in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    words = bpe.corpus_words(docs(spark, rows), path, most=5, each=300)
    assert words[0] == "qzx" and len(words) == 5 and "long" * 5 not in words
    assert bpe.corpus_words(docs(spark, ["b a", "a b", None]), path, most=2) == ["a", "b"]


def test_summary_keeps_its_bound():
    s, true = frequent.Summary(50), Counter()
    for _ in range(300):
        c = Counter(min(int(R.expovariate(0.01)), 5000) for _ in range(100))
        true.update(c)
        keys = sorted(c)
        s.add(keys, [c[k] for k in keys], lambda i: str(keys[i]))  # noqa: B023
    n = sum(true.values())
    got = {int(w): k for w, k in s.top()}
    assert all(true[k] - n / 50 <= v <= true[k] for k, v in got.items())
    assert all(k in got for k, v in true.items() if v > 2 * n / 50)


def test_hash_table():
    k = np.unique(np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64))
    t = text.HashTable(k, np.arange(len(k), dtype=np.int32))
    assert (t.find(k) == np.arange(len(k))).all() and (t.find(k + np.uint64(1)) == -1).sum() >= len(k) - 5


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    d = docs(spark, FUZZ)
    lexicon = bpe.compile_lexicon(d, path, store.new_folder(spark, "bpe"))
    full = {r.doc_id: r for r in bpe.encode(d, path, lexicon).collect()}
    digest = {r.doc_id: r for r in bpe.encode(d, path, lexicon, digests=True).collect()}
    for i, t in enumerate(FUZZ):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        shown = tok.decode(ids, skip_special_tokens=False)
        assert (full[i].n_tokens, list(full[i].ids), full[i].decoded) == (len(ids), ids, shown)
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert bpe.encode(docs(spark, []), path, bpe.compile_lexicon(docs(spark, []), path, store.new_folder(spark, "bpe"))).count() == 0


def test_automaton_is_minimal_and_exact(tmp_path):
    words = sorted({"".join(R.choice("abc") for _ in range(R.randint(1, 7))) for _ in range(400)})
    table = {w.encode(): [i, i * 2] for i, w in enumerate(words)}
    bpe.Automaton.build(table).save(f"file://{tmp_path}/x/a.bin")
    a = bpe.Automaton.load(f"file://{tmp_path}/x/a.bin")
    ask = [*words, "", "abcabcabc", "d", "ab!"]
    data = [w.encode() for w in ask]
    at = np.concatenate([[0], np.cumsum([len(w) for w in data])]).astype(np.int64)
    n = a.find(np.frombuffer(b"".join(data), np.uint8), at)
    assert [a.ids[a.offset[i] : a.offset[i + 1]].tolist() if i >= 0 else None for i in n] == [table.get(w) for w in data]
    tails = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            tails[w[:i]].add(w[i:])
    assert len(a.final) == len({frozenset(x) for x in tails.values()})


def test_language(spark):
    made = {"en": "the quick brown fox and the lazy dog", "fr": "le renard brun et la forêt où il est", "de": "der schnelle braune fuchs und die straße"}
    rows = [(i, " ".join(R.sample(made[k].split(), 6)), k) for i, k in enumerate(R.choices(sorted(made), k=300))]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 !?", "de"), (903, "the fox", None), (None, "le renard", "fr"), (906, "x" * 200_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)))
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, k) for i, _, k in rows if i is not None and i < 900 and i % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902)) and by[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep(df.withColumn("score", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(rows) - 3
    empty = langid.fit(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def test_bayes_is_plain_counting(spark):
    rows = [(0, "abab", "x"), (1, "bcb", "y"), (2, "Cab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {k: Counter() for k in "xy"}
    for _, t, k in rows:
        counts[k].update(langid.grams([t])[0].tolist())
    model = langid.fit(df, F.lit(True))
    for t in ("ab", "c", "bcbab"):
        g = langid.grams([t])[0].tolist()
        s = {k: math.log({"x": 2 / 3, "y": 1 / 3}[k]) + sum(math.log((c[b] + langid.ALPHA) / (sum(c.values()) + langid.ALPHA * 2**langid.BITS)) for b in g) for k, c in counts.items()}
        lang, p = model.predict([t])
        best = max(s, key=s.get)
        assert lang == [best] and p[0] == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), rel=1e-4)


def kneser_ney_plain(texts, train, order):
    t = [WORD.findall((x or "").translate(LOWER)) + ["</s>"] for x in texts]
    c, num = Counter(), [Counter() for _ in range(order + 1)]
    for i in train:
        c.update(t[i])
        padded = ["<s>"] * (order - 1) + t[i]
        num[order].update(tuple(padded[j : j + order]) for j in range(len(t[i])))
    for k in range(order - 1, 0, -1):  # the number of distinct words before
        num[k].update(g[1:] for g in num[k + 1])
    n, v = sum(c.values()), len(c)
    d, context = {}, {}
    for k in range(1, order + 1):
        d[k] = [0.0, *kneser_ney.Model.discounts([sum(x == i for x in num[k].values()) for i in (1, 2, 3, 4)])]
        context[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in num[k].items():
            context[k][g[:-1]][0] += x
            context[k][g[:-1]][min(x, 3)] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        z = context[k].get(g[:-1])
        if z is None:
            return p(g[1:])
        return max(num[k][g] - d[k][min(num[k][g], 3)], 0) / z[0] + sum(d[k][j] * z[j] for j in (1, 2, 3)) / z[0] * p(g[1:])

    assert sum(p((*["<s>"] * (order - 1), w)) for w in [*c, "never seen"]) == pytest.approx(1.0)
    out = []
    for x in t:
        padded = ["<s>"] * (order - 1) + x
        grams = Counter(tuple(padded[j : j + order]) for j in range(len(x)))
        out.append((len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), sum(m * math.log10(p(g)) for g, m in grams.items())))
    return out


@pytest.mark.parametrize(("share", "order"), [(5, 2), (1, 2), (4, 3), (4, 4)])
def test_language_model(spark, monkeypatch, share, order):
    monkeypatch.setattr(kneser_ney, "GATHER", 200)
    monkeypatch.setattr(kneser_ney, "MERGE", 20)
    monkeypatch.setattr(kneser_ney, "MAPS", 2)
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 1000)
    r = random.Random(3)
    texts = [" ".join(r.choice(["The", "cat", "sat", "on", "a", "mat", "É"]) for _ in range(r.randint(0, 12))) for _ in range(200)] + [None, "", "new words only", "the " * 20000, None, "new words only", *ALIKE]
    df = docs(spark, texts).withColumn("range", F.lit("x")).withColumn("data", F.lit(1))
    model = kneser_ney.train(df, F.col("doc_id") % 5 >= 5 - share, store.new_folder(spark, "lm"), order=order)
    want = kneser_ney_plain(texts, [i for i in range(len(texts)) if i % 5 >= 5 - share], order)
    rows = kneser_ney.score(df.unionAll(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))), model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[3 if r.doc_id is None else r.doc_id])


def test_language_model_stores_no_parts(spark, tmp_path):
    """What shorter grams are made of goes through one exchange and isn't stored besides."""
    r = random.Random(8)
    df = docs(spark, [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(100)])
    model = kneser_ney.train(df, F.lit(True), f"file://{tmp_path}/lm")
    size = lambda kind: sum(p.stat().st_size for p in tmp_path.rglob(f"*.{kind}"))
    assert model.sums[1]["words"] > 4000 and model.sums[2]["grams"] > 15000
    assert 8 * size("parquet") < size("bin")
    assert size("bin") < (8 + 1) * model.sums[2]["grams"] + (8 + 12 + 6) * (model.sums[1]["words"] + model.ranges)  # no number is wider than its range needs


@pytest.mark.parametrize("many", [1, 300, 70000])
def test_language_model_one_part(spark, many):
    """A range that gets one part only, with numbers of one, two and four bytes."""
    texts = ["the " * many + "end of it", "the end", None]
    df = docs(spark, texts).coalesce(1)
    got = kneser_ney.score(df, kneser_ney.train(df, F.lit(True), store.new_folder(spark, "lm"))).collect()
    for r, want in zip(sorted(got, key=lambda r: r.doc_id), kneser_ney_plain(texts, [0, 1, 2], 2), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want)


def test_language_model_parts():
    words = [np.arange(5, dtype=np.uint64) * 977, np.arange(5, dtype=np.uint64) + 2**63]
    values = [np.array([0, 1, 2, 3, top], np.int64) for top in (255, 256, 65536, 2**32 - 1, 2**40)]
    got = kneser_ney._unpack(kneser_ney._pack(words, values))
    assert [x.tolist() for part in got for x in part] == [x.tolist() for x in [*words, *values]]


def test_language_model_untrained(spark):
    df = docs(spark, ["a b", None])
    model = kneser_ney.train(df, F.lit(False), store.new_folder(spark, "lm"))
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in kneser_ney.score(df, model).collect())
    assert kneser_ney.score(df.where("false"), model).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nX: y", "y"), (4, "", None), (5, "u", ""), (6, "u", "é" * 100_000), (None, "n", "x"), (None, "n", "only"), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    index = warc.write_archive(df, store.new_folder(spark, "warc"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    head = {"x": 2, "": 5}
    want = sorted((i or 0, len((t or "").encode()), sha(t), *(("revisit", head[t or ""]) if (t or "") in head and head[t or ""] != i else ("response", None))) for i, _, t in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want] and sorted(map(str, got)) == sorted(map(str, want))
    some = warc.read_records(index.where("page_id in (3, 6)")).collect()
    assert {r.page_id for r in some} == {3, 6}
    assert warc.read_records(warc.write_archive(df.where("false"), store.new_folder(spark, "warc"))).count() == 0


def test_warc_archive_is_plain_gzip(spark):
    import gzip

    index = warc.write_archive(spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string"), store.new_folder(spark, "warc")).first()
    raw = gzip.decompress(open(index.file.removeprefix("file://"), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"<p>x</p>\r\n\r\n")


def test_media(spark):
    texts = ["", None, "abc", "abc", "x" * 192, "y" * 193, "é" * 50_000, " "]
    folder = store.new_folder(spark, "media")
    rows = media.write_shards(docs(spark, texts).withColumn("digest", F.lit("z")).repartition(3), folder)
    places = media.places(rows)
    facts = {r.digest: r for r in media.read_payloads(places).collect()}
    heads = {r.digest: r for r in media.read_headers(places).collect()}
    assert len(facts) == len({t or "" for t in texts} - {" "})
    for r in rows.collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = media.padded(raw)
        f = facts[r.digest]
        assert len(payload) % 192 == 0 and len(payload) > 0 and payload.rstrip(b" ") == raw.rstrip(b" ")
        assert (r.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (heads[r.digest].width, heads[r.digest].height, heads[r.digest].depth) == (64, len(payload) // 192, 8)
        with tarfile.open(r.shard.removeprefix("file://")) as t:
            png = next(t.extractfile(m).read() for m in t.getmembers() if m.name == f"{r.digest}.png")
        assert hashlib.sha256(png).hexdigest() == r.digest == f.media_sha256 and len(png) == f.media_bytes and media.from_png(png) == payload
    assert media.read_payloads(media.places(media.write_shards(docs(spark, []), store.new_folder(spark, "media")))).count() == 0


def test_mixing(spark):
    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(4000)] + [(9000, "n", None), (None, "m", "big"), (5, "t5", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_key", F.lit(1))
    out = mixing.mix(df, targets={"big": 1.0, "small": 3.0}, total=8000.0).toPandas()
    n = out.groupby("source").size()
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 6000) < 300 and None not in set(out.source)
    assert out.groupby(["doc_id", "mix_copy"]).size().max() <= 2
    per = out.groupby("doc_id").mix_copy.agg(["max", "nunique"])
    assert (per["max"] + 1 == per["nunique"]).all()
    again = mixing.mix(df.repartition(5), targets={"big": 1.0, "small": 3.0}, total=8000.0).toPandas()
    assert sorted(map(tuple, out.dropna().to_numpy().tolist())) == sorted(map(tuple, again.dropna().to_numpy().tolist()))
    assert out.mix_key.corr(out.doc_id) < 0.1
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_large_rate(spark):
    df = spark.createDataFrame([(i, "t", "s") for i in range(3)], "doc_id long, text string, source string")
    n = mixing.mix(df, total=6000.0).groupBy("doc_id").count().collect()
    assert all(1750 < r["count"] < 2250 for r in n)


def test_poisson_counts(spark):
    df = spark.createDataFrame([(i, "t", "s") for i in range(20000)], "doc_id long, text string, source string")
    got = Counter(r["count"] for r in mixing.mix(df, total=30000.0).groupBy("doc_id").count().collect())
    for k in range(1, 6):
        want = 20000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(got[k] - want) < 5 * math.sqrt(want)


def quality_rows():
    good = ["the cat sat on the mat and looked at the moon", "a dog ran over the hill to find the river", "we went home when the rain came down"]
    rows, labels = [], []
    for i in range(400):
        ok = i % 4 != 0
        rows.append((i, " ".join(R.choice(good) for _ in range(4)) if ok else " ".join(f"{R.choice('xyz')}{R.randrange(99)}%%%" for _ in range(30))))
        labels.append((i, int(ok)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    rows += [(1000, None), (1001, ""), (1002, "the cat"), (None, "the dog ran"), (1, rows[1][1]), (1003, "the cat sat on the mat " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("log_ratio", F.lit(0)).withColumn("row", F.lit("r")).withColumn("noise", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(df, lab)
    assert model.share == pytest.approx(0.75 + math.sqrt(0.75 * 0.25 / 400))
    scores = quality.scored(df, model).cache()
    end = quality.cut(scores, share=model.share)
    assert end.k == math.ceil(model.share * 406)
    kept = {r.doc_id for r in scores.where(end.holds(F.col("gumbel_key"))).collect()}
    good = {i for i, q in labels if q}
    assert good <= kept and len({i for i in kept if i is not None and i < 400} - good) <= 14
    assert scores.where("doc_id = 1003").first().n_grams > 10**6
    keys = sorted((r.gumbel_key for r in scores.collect()), reverse=True)
    for k in (1, 7, 100):
        end = quality.cut(scores, k)
        assert scores.where(end.holds(F.col("gumbel_key"))).count() == sum(round(x * 1e9) >= round(keys[k - 1] * 1e9) for x in keys) <= k + 1
    end = quality.cut(scores, share=0.5)
    whole = quality.sampled(df, model, end)
    assert whole.schema.names == df.columns and Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in scores.where(end.holds(F.col("gumbel_key"))).collect())
    none = quality.scored(df.where("false"), model)
    assert none.count() == 0 and quality.cut(none).k == 0 and quality.effective_size(none) == 0.0
    assert quality.sampled(df.where("false"), model, quality.cut(none)).count() == 0
    free = quality.fit(df, lab.where("false"))
    scores = quality.scored(df, free)
    assert free.share == 1.0 and quality.effective_size(scores) == pytest.approx(406)
    assert quality.sampled(df, free, quality.cut(scores, share=free.share)).count() == len(rows)
    assert quality.fit(df, lab.where("quality = 0")).share == 0.0


def plain_grams(t):
    """Words and pairs of words, A-Z lower-cased, and three-byte grams, each named by its kind."""
    w = [x.encode() for x in WORD.findall(t.translate(LOWER))]
    b = t.encode()
    return [(0, x) for x in w] + [(1, x) for x in zip(w, w[1:])] + [(2, b[i : i + 3]) for i in range(len(b) - 2)]


def named(bucket_of, plain, texts):
    """The bucket of each plain n-gram: the same wherever it stands, and seldom that of another."""
    seen = {}
    for t in texts:
        got, want = bucket_of(t), plain(t)
        assert len(got) == len(want)
        for b, g in zip(got, want, strict=True):
            assert seen.setdefault(g, b) == b, (t, g)
    assert len(set(seen.values())) > 0.93 * len(seen)
    return seen


def test_grams_of_quality_are_the_plain_ones():
    texts = [t for t in FUZZ[:600] if t] + [t for _, t in quality_rows()[0]]
    named(lambda t: [b for x, _ in quality.grams(*text.utf8(pa.array([t]))) for b in x.tolist()], plain_grams, texts)
    one = [[b for x, _ in quality.grams(*text.utf8(pa.array([t]))) for b in x.tolist()] for t in texts[:200]]
    both = quality.grams(*text.utf8(pa.array(texts[:200])))
    assert one == [[b for x, edge in both for b in x[edge[i] : edge[i + 1]].tolist()] for i in range(200)]


def test_grams_of_languages_are_the_plain_ones():
    plain = lambda t: [t.lower()[i : i + k] for i in range(len(t.lower())) for k in (1, 2, 3) if i + k <= len(t.lower())]
    texts = [t for t in FUZZ[:400] if t]
    named(lambda t: langid.grams([t])[0].tolist(), plain, texts)
    bucket, begin, _ = langid.grams(texts)
    assert [bucket[a:b].tolist() for a, b in zip(begin, begin[1:])] == [langid.grams([t])[0].tolist() for t in texts]


def test_quality_is_plain_counting(spark):
    """Both models counted by dictionaries of the n-grams themselves, by way of the bucket that each falls into."""
    rows, labels = quality_rows()
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    name = named(lambda t: [b for x, _ in quality.grams(*text.utf8(pa.array([t]))) for b in x.tolist()], plain_grams, [t for _, t in rows])
    grams = {i: [(g[0], name[g]) for g in plain_grams(t)] for i, t in rows}
    good = dict(labels)
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if good[i] else [])
    total = lambda c, kind: sum(v for (k, _), v in c.items() if k == kind)
    ratio = lambda g: math.log((target[g] + quality.PRIOR) / (raw[g] * total(target, g[0]) / total(raw, g[0]) + quality.PRIOR))
    mean = {i: sum(map(ratio, g)) / len(g) for i, g in grams.items()}
    for r in quality.scored(df, quality.fit(df, lab, temper=40.0)).collect():
        assert (r.n_grams, r.log_ratio) == (len(grams[r.doc_id]), pytest.approx(mean[r.doc_id]))
        assert r.log_weight == pytest.approx(40 * mean[r.doc_id], abs=1e-6)


def weighted(ratios, n):
    """Documents of one word each, n of each log ratio, and a model that has these."""
    model = quality.Model(np.zeros(quality.KINDS << quality.BITS), temper=1.0)
    words = [f"w{j}" for j in range(len(ratios))]
    for t, ratio in zip(words, ratios, strict=True):
        got = [b for b, _ in quality.grams(*text.utf8(pa.array([t])))]
        model.ratio[got[0]] = 0.0
        for b in got:
            model.ratio[b] = ratio
    return model, [(i, words[i % len(words)]) for i in range(n * len(words))]


def test_quality_samples_by_importance(spark):
    """Of documents with several weights, as many of each are drawn as theory has it for keys of independent exponentials.

    With weights as far apart as a corpus has them under some tempering, a good part of the sample lies below what a
    threshold would take.
    """
    ratios, n, k = [-3.0, -1.0, 0.0, 1.5, 2.5], 1000, 1700
    model, rows = weighted(ratios, n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = quality.scored(df, model).cache()
    w = {r.text: math.exp(r.log_weight) for r in scores.join(df, "doc_id").select("text", "log_weight").distinct().collect()}
    assert len(w) == len(ratios)
    got = Counter(r.text for r in scores.where(quality.cut(scores, k).holds(F.col("gumbel_key"))).join(df, "doc_id").collect())
    low, high = 0.0, 1e3
    for _ in range(100):  # the time at which k of the exponentials have come
        t = (low + high) / 2
        low, high = (t, high) if sum(n * (1 - math.exp(-x * t)) for x in w.values()) < k else (low, t)
    for name, x in w.items():
        p = 1 - math.exp(-x * t)
        assert abs(got[name] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 5, name
    best = sorted(w, key=w.get)[-2:]
    assert sum(got.values()) == k and sum(v for g, v in got.items() if g not in best) > 0.1 * k and got[best[0]] < n
    ess = quality.effective_size(scores)
    assert ess == pytest.approx((n * sum(w.values())) ** 2 / (n * sum(x * x for x in w.values())), rel=1e-9)
    even = quality.Model(model.ratio, temper=0.01)
    assert quality.effective_size(quality.scored(df, even)) > 0.99 * len(rows)


def test_quality_keeps_all_ties(spark):
    """More ties at the end than any batch or limit has rows: all of them are in, as few are."""
    for n in (3, 1500):
        df = spark.createDataFrame([(7, "a b c")] * n + [(i, "a b c") for i in range(100, 110)], "doc_id long, text string")
        scores = quality.scored(df, quality.Model(np.zeros(quality.KINDS << quality.BITS))).cache()
        rank = sorted({(r.gumbel_key, r.doc_id) for r in scores.collect()}, reverse=True)
        at = next(i for i, (_, d) in enumerate(rank) if d == 7)
        for k in (at + 1, at + 2):
            got = Counter(r.doc_id for r in scores.where(quality.cut(scores, k).holds(F.col("gumbel_key"))).collect())
            assert got[7] == n and sum(got.values()) == at + n


def test_kth_largest(spark):
    v = [R.randrange(-(10**15), 10**15) for _ in range(500)] + [7, 7, 7, -1, 0]
    df = spark.createDataFrame([(x,) for x in v], "x long")
    for k in (1, 2, 250, 505):
        assert quality.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 0) is None and quality.kth_largest(df, "x", 506) is None
