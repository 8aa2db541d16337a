"""The registered queries and the pipeline's stages over odd tables: nulls, empty and very long texts, ties, repeated rows,
empty tables, and further columns whose names are those that the operators work with."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from test_pairs import brute
from test_forms import audited, coded, middled
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import mixing, quality, queries, store

CLASH = "id fp n card label component tile row key noise q s i __i __s __k __id count times mix_key mix_copy component_id digest shard offset length sha head payload file range data name slice counts n_tokens n_grams log_ratio word bits tokens node".split()
R = random.Random(23)
WORDS = "casa perro libro tiempo mesa lugar noche gente forma vida agua parte tierra mundo hombre".split()


def prose(n=40):
    return " ".join(R.choices(WORDS, k=n))


def texts():
    rows = [(i, prose(), "es", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, " ".join(R.choices("the house of a dog and time water part world night".split(), k=40)), "en", "s1") for i in range(40)]
    rows += [(200 + i, " ".join(f"{R.choice('xyz')}{R.randrange(99)}%%%" for _ in range(30)), "es", "s0") for i in range(20)]
    twice = rows[3]
    return rows + [(300, None, "es", "s0"), (301, "", None, None), (302, " \t\n", "en", "s1"), (None, prose(), "es", None), (None, None, None, None), twice, twice, (twice[0], prose(), "en", "s9"), (303, twice[1], "es", "s0"), (304, twice[1] + " y", "es", "s0"), (305, "muy " * 70_000 + "largo", None, "s2"), (306, "x" * 300_000, None, "s2")]


def documents(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(spark, request, tmp_path_factory):
    store.prepare(spark)
    top, keep = tmp_path_factory.mktemp(request.param), request.param == "odd"
    rows = texts() if keep else []
    documents(spark, rows).write.parquet(f"{top}/documents.parquet")
    extra = [F.lit("own").alias(c) for c in CLASH]
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "a", "b", "", None, "é" * 200_000, "c"])] + [(6, None, "c"), (None, "", "a")]
    spark.createDataFrame(pages if keep else [], "page_id long, url string, html string").select("*", *extra).write.parquet(f"{top}/pages.parquet")
    vectors = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, None, 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1)]
    spark.createDataFrame(vectors if keep else [], "vec_id long, embedding array<double>, label int").select("*", *[F.lit("own").alias(c) for c in CLASH if c != "label"]).write.parquet(f"{top}/embeddings.parquet")
    labels = [(i, int(i < 200), 0) for i in (*range(40), *range(100, 140), *range(200, 220), 3)] + [(None, 1, 0), (5, None, None), (999, 1, 0)]
    spark.createDataFrame(labels if keep else [], "doc_id long, quality int, toxic int").select("*", *extra).write.parquet(f"{top}/labels.parquet")
    return str(top), rows


def text_of(rows):
    return Counter((r[0], r[1] or "") for r in rows)


HELD = {"op3_language_id": (4, 2), "op4_lm_score": (5, 1)}
COLUMNS = {
    "op1_ngram_join": "doc_id n_shingles component_id", "op2_warc": "page_id payload_bytes payload_digest record_type refers_to", "op3_language_id": "doc_id held_out lang_pred score",
    "op4_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5_token_counts": "doc_id n_bytes n_tokens over_limit", "op6_quality": "doc_id n_grams log_ratio log_weight gumbel_key kept k effective_size",
    "op7_mixing": "doc_id text mix_copy mix_key", "op8_embedding_dedup": "vec_id n_links component_id kept", "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_pieces": "doc_id n_tokens ids_sha256 decoded_sha256", "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature width height depth",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_query(spark, tables, name):
    top, rows = tables
    df = queries.QUERIES[name](spark, top)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = df.collect()
    if not rows:
        assert got == []
        return
    if name in ("op2_warc", "op8_embedding_dedup"):
        assert len(got) == {"op2_warc": 9, "op8_embedding_dedup": 7}[name]
        return
    if name == "op7_mixing":
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and set(df.columns) == {*spark.read.parquet(f"{top}/documents.parquet").columns, "mix_copy", "mix_key"}
        assert all(r.id == "own id" and r.times == "own times" for r in got)
        return
    if name == "op12_filter_audit":
        labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{top}/labels.parquet").collect()]
        assert {tuple(r) for r in df.select(*COLUMNS[name].split()).collect()} == audited([(r[0], r[1], r[3]) for r in rows], labels) and len(got) == 600 * len({r[3] or "" for r in rows})
        return
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    if name in HELD:
        m, k = HELD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) for r in got if r.doc_id is not None)
    if name == "op1_ngram_join":
        low = brute([r[:2] for r in rows], 3, 90)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == low
        assert [(by[i].n_shingles, by[i].component_id) for i in (300, 301, 302)] == [(0, 300), (0, 301), (0, 302)]
    if name == "op3_language_id":
        assert [(by[i].lang_pred, by[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3 and by[10].lang_pred == "es" and by[110].lang_pred == "en"
    if name == "op4_lm_score":
        assert by[300].n_tokens == by[301].n_tokens == 1 and by[305].n_tokens == 70_002 and [(r.doc_id, r.score) for r in got if not (math.isfinite(r.score) and r.score <= 0)] == []
    if name in ("op5_token_counts", "op9_bpe"):
        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json" if name == "op5_token_counts" else "word_bpe_49k.json"))
        want = Counter((i, len(tok.encode(t, add_special_tokens=False).ids)) for (i, t), n in text_of(rows).items() for _ in range(n))
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    if name == "op11_pieces":
        sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        want = Counter((i, *coded(sp, t)) for (i, t), n in text_of(rows).items() for _ in range(n))
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    if name == "op13_fill_middle":
        assert Counter(tuple(r[c] for c in COLUMNS[name].split()) for r in got) == Counter(middled(r[0], r[1] or "") for r in rows)
        assert (by[300].form, by[301].form, by[302].n, by[306].n) == ("plain", "plain", 1, 1)
    if name == "op6_quality":
        assert by[300].log_weight == by[301].log_weight == 0.0 and all(r.kept == by[r.doc_id].kept for r in got if r.doc_id in (300, 301))
        assert all(by[i].kept for i in range(10)) and sum(by[i].kept for i in range(200, 220)) <= 6 and sum(r.kept for r in got) >= by[0].k and 1 < by[0].effective_size < len(rows)
    if name == "op10_media":
        empty = hashlib.sha256(b" " * 192).hexdigest()
        assert [by[i].payload_sha256 for i in (300, 301)] == [empty] * 2 and by[306].height == by[306].payload_bytes // 192 and all((r.width, r.depth) == (64, 8) for r in got)


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, tables, name):
    """Each stage over the odd table, alone: whole rows pass unchanged, and what is said to stay or go does."""
    top, rows = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    out = STAGES[name](spark, docs, top)
    got = out.collect()
    if name == "bpe_encoding":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        return
    assert out.columns == docs.columns
    own = lambda r: tuple(v for c, v in zip(docs.columns, r, strict=True) if name != "mixing_sources" or c not in ("mix_key", "mix_copy"))
    before = Counter(map(own, docs.collect()))
    after = Counter(map(own, got))
    assert set(after) <= set(before) and (name == "mixing_sources" or all(n <= before[r] for r, n in after.items()))
    if not rows:
        return
    left = Counter(r.doc_id for r in got)
    if name == "quality_classifier":
        assert all(left[i] for i in (0, 1, 2, 105)) and sum(left[i] for i in range(200, 220)) <= 6 and left[3] in (3, 4, 0, 1)
    if name == "language_id":
        assert not any(left[i] for i in (300, 301, 302, 306)) and all(left[i] for i in (0, 1, 2, 110, 111))
    if name == "near_duplicates":
        low = brute([r[:2] for r in rows], corpus_pipeline.SHINGLE, corpus_pipeline.NEAR)
        assert left == Counter({i: 1 for i in low if low[i] == i} | {None: sum(r[0] is None for r in rows)})
    if name == "mixing_sources":
        n = Counter(r[3] for r in rows)
        total = sum(x**0.5 for x in n.values())
        for r in rows:
            rate = len(rows) * n[r[3]] ** 0.5 / total / n[r[3]]
            u = int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|17|0".encode()).hexdigest()[:13], 16) / 2**52
            k, p = 0, math.exp(-rate)
            cdf = p
            while cdf <= u:
                k += 1
                p *= rate / k
                cdf += p
            want = k * sum(1 for x in rows if x == r)
            assert after[next(t for t in before if t[:4] == r)] == want


def test_stages_without_labels_keep_all(spark, tmp_path):
    store.prepare(spark)
    docs = documents(spark, texts()[:20])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 20
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == 0


def test_quality_stage_is_the_sorted_sample(spark, tmp_path):
    """The stage's rows are those of the k largest keys, k the number of documents over the bound."""
    store.prepare(spark)
    rows = texts()[:100]
    docs = documents(spark, rows)
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    s = quality.scored(docs, model).collect()
    k = math.ceil(model.share * len(s))
    want = {r.doc_id for r in sorted(s, key=lambda r: -r.gumbel_key)[:k]}
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()} == want and 60 < k <= 100


def test_one_source_with_all_repeated_ids_is_dealt_out(spark):
    """Rows without an id share their order key; they don't share their partition."""
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = mixing.mix(df, total=4000.0).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not parts or len(parts) > 1


def test_schema_of_the_sample_is_that_of_the_documents(spark):
    store.prepare(spark)
    df = spark.createDataFrame([(1, "a b", {"x": [1]}, None)], T.StructType().add("doc_id", "long").add("text", "string").add("meta", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))).add("when.at", "timestamp"))
    model = quality.Model(__import__("numpy").zeros(quality.KINDS << quality.BITS))
    out = quality.sampled(df, model, quality.cut(quality.scored(df, model)))
    assert out.schema == df.schema and out.first() == df.first()
