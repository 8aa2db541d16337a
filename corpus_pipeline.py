"""A training corpus from documents: good ones, in a known language, one of each group of near copies, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written to the shared folder and read again as the next
stage's docs.  All stages but the last return the columns of documents; the filters never alter a row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, mixing, ngram_join, quality, store

#: Five-word shingles, and the least similarity of near copies in per cent.
SHINGLE, NEAR = 5, 80
#: The least probability of the predicted language.
SURE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the importance sample: a Gumbel top-k of as large a share as good documents have among the labels.

    Null and empty texts have importance one, which lies below that of good text and above that of bad; repeated rows stay or go together; of ties at
    the end all stay; texts of any length count whole; an empty table, or one without labels, is kept as it is.
    """
    store.prepare(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = store.saved(quality.scored(docs, model), store.new_folder(spark, "quality"), "scores")
    return quality.sampled(docs, model, quality.cut(scores, share=model.share))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter, is in none of the languages of the labels, or can't be told between them.

    The text's mean log probability an n-gram in its likeliest language decides, against a floor from held-out texts of that
    language (`langid.fit_floors`); the probability of the language is a second condition.  Null and empty texts go; repeated
    rows stay or go together; texts of any length count whole; a null id or language doesn't matter; of equally likely
    languages the first in order counts; without any labelled text all rows go; an empty table gives an empty one.
    """
    store.prepare(spark)
    model, floors = langid.fit_floors(docs, F.lit(True))
    return langid.keep(docs, model, SURE, floors=floors)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, and documents without an id.

    Rows that repeat an id are one document: of a kept id, the row with the smallest hash of its columns stays.  Null and empty
    texts are near to nothing and stay; texts of any length count whole; an empty table gives an empty one.
    """
    store.prepare(spark)
    found = ngram_join.components(docs, SHINGLE, NEAR)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    repeated = store.saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), store.new_folder(spark, "near"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row, order = F.struct(*docs.columns), F.xxhash64(*docs.columns)
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    once = docs.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(one).join(gone, "doc_id", "left_anti").select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources weigh as the square root of their sizes, in a global random order.

    Null texts are rows like others, as is a null source; rows that repeat an id are drawn alike, as are all without an id;
    an empty table gives an empty one.
    """
    store.prepare(spark)
    return mixing.mix(docs).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy; null and empty texts have no tokens."""
    store.prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, bpe.compile_lexicon(docs, path, store.new_folder(spark, "bpe")), digests=True)


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing_sources", mixing_sources), ("bpe_encoding", bpe_encoding)]

#: The model stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = store.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.saved(stage(spark, docs, sf_dir), folder, name)
    return docs
