"""The pipeline's stages on a small corpus, each against what it has to do with its own input."""

import os

import pytest

import corpus_pipeline
from lectern.llm import queries, store

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def test_stages(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, folder, seen = docs.columns, store.new_folder(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = store.saved(stage(spark, docs, DIR), folder, name)
        rows = docs.collect()
        seen[name] = len(rows)
        if name != "bpe_encoding":
            assert docs.columns == columns and all(before[r.doc_id] == r for r in rows)
        if name == "near_duplicates":
            texts = [r.text for r in rows]
            assert len(set(texts)) == len(texts)
        if name == "quality_classifier":
            good = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").join(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id").select("doc_id").collect()
            assert {r.doc_id for r in good} <= {r.doc_id for r in rows}
    assert seen["bpe_encoding"] == seen["mixing_sources"]
    assert docs.where(F.length("ids_sha256") == 64).count() == seen["bpe_encoding"]
    # the whole run is the same rows
    a = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == a


def test_small_scans(spark, tmp_path):
    """After a stage, scans hand on a few hundred whole texts at a time and keep no buffers as large as a column's chunk."""
    spark.range(2000).selectExpr("id doc_id", "repeat('word ', 100) text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.mixing_sources(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "length(text) n")
    assert len(df.collect()) == 2000
    scan = df._jdf.queryExecution().executedPlan()
    while not scan.metrics().contains("numInputBatches"):
        scan = scan.children().head()
    assert scan.metrics().apply("numInputBatches").value() >= 2000 // 512
    assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"


FOREIGN = {
    "it": "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
    "ja": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "ru": "все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему",
    "fi": "vaka vanha väinämöinen itse tuon sanoiksi virkkoi",
    "pl": "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić",
    "soup": "xq zvk wjp qqz hbx kfw vbn pzx jqk wrtz gkhl",
    "junk": "%%% x91 === z17 %%% x91 === z17",
}


def test_language_rejects_what_is_in_no_learned_language(spark):
    from lectern.llm import langid

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = spark.createDataFrame([(-1 - i, t, None, "src0", len(t)) for i, t in enumerate(FOREIGN.values())], docs.schema)
    both = docs.unionByName(more)
    # the posterior is sure of each of them
    model = langid.fit(both, F.lit(True))
    assert min(model.predict(list(FOREIGN.values()))[1]) >= corpus_pipeline.SURE
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, DIR).select("doc_id").collect()}
    assert not [k for i, k in enumerate(FOREIGN) if -1 - i in kept]
    clean = {r.doc_id for r in docs.where(r"text rlike '^[\\p{L}\\s,.]+$' and not text rlike '\\p{Lu}{2}'").select("doc_id").collect()}
    assert len(clean) > 50 and clean <= kept


def test_floors_are_plain_counting(spark):
    import numpy as np

    from lectern.llm import langid
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("n_chars < 3000")
    model, floors = langid.fit_floors(docs, F.lit(True))
    rows = docs.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()
    for k, floor in zip(model.langs, floors, strict=True):
        mine = [(r.half, langid.grams([r.text])[0]) for r in rows if r.lang == k]
        c = np.zeros((2, 1 << langid.BITS))
        for h, g in mine:
            np.add.at(c[h], g, 1)
        logs = np.log((c + langid.ALPHA) / (c.sum(1, keepdims=True) + langid.ALPHA * 2**langid.BITS))
        x = sorted((logs[1 - h][g].mean() for h, g in mine), reverse=True)
        m, q = x[-(-len(x) // 2) - 1], x[-(-len(x) * 3 // 4) - 1]
        assert floor == pytest.approx(m - max(langid.MARGIN, langid.FACTOR * (m - q)), abs=0.2)


def test_repeated_rows_of_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "s", 2), (2, a + " z", "en", "s", 1), (2, a, "fr", "s", 1), (3, b, "en", "s", 1), (4, c, "en", "s", 1), (4, c + " z", "en", "s", 1)]
    rows += [(None, a, "en", "s", 1), (None, a, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.near_duplicates(spark, df, DIR).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 3, 4] and {tuple(r) for r in got} <= set(rows)
    again = corpus_pipeline.near_duplicates(spark, df.repartition(3), DIR).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def rows(cursor):
    norm = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted((tuple(map(norm, r)) for r in cursor), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(con.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall())
