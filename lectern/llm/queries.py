"""The registered query of each operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fill_middle, filter_audit, kneser_ney, langid, media, mixing, ngram_join, pieces, quality, store, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), k=3, percent=90)


_REACH = """
     r(x, y) AS (SELECT v, v FROM nodes UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y)
"""

OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
     links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
               GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
     nodes AS (SELECT doc_id AS v FROM s),
""" + _REACH + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.m AS component_id
FROM s JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = s.doc_id
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
               WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
     nodes AS (SELECT vec_id AS v FROM v),
""" + _REACH + """
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
FROM v JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = v.vec_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write_archive(pages, store.new_folder(spark, "warc"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM r
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP7 = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     t AS (SELECT sum(pow(n, 0.5)) AS sw, CAST(sum(n) AS DOUBLE) AS sn FROM n),
     r AS (SELECT source, sn * pow(n, 0.5) / sw / n AS rate FROM n, t),
     k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
     p AS (SELECT source, k, sum(exp(-rate + k2 * ln(rate) - lgamma(k2 + 1))) AS cdf
           FROM k JOIN (SELECT source AS s2, k AS k2 FROM k) ON s2 IS NOT DISTINCT FROM source AND k2 <= k GROUP BY source, k),
     u AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), '17', '0')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
     m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (p.cdf <= u.u) AS times
           FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
     x AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, times)) AS INTEGER) AS mix_copy FROM m)
SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'order', coalesce(CAST(doc_id AS VARCHAR), 'null'), '17', CAST(mix_copy AS VARCHAR))), 1, 13) AS BIGINT) AS mix_key
FROM x
"""

def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs, crc_mod("doc_id", 5) != 1, store.new_folder(spark, "lm"))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_ratio, log_weight, gumbel_key, kept: whether the importance sample holds the document; k and the effective size of all."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scores = store.saved(quality.scored(docs, model), store.new_folder(spark, "quality"), "scores")
    end = quality.cut(scores, share=model.share)
    return scores.withColumns({"kept": end.holds(F.col("gumbel_key")), "k": F.lit(end.k).cast("long"), "effective_size": F.lit(quality.effective_size(scores))})


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, bpe.compile_lexicon(docs, path, store.new_folder(spark, "bpe")), digests=True)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from the stored payloads; width, height, depth from the headers alone."""
    docs, folder = table(spark, sf_dir, "documents"), store.new_folder(spark, "media")
    rows = media.write_shards(docs, folder)
    places = store.saved(media.places(rows), folder, "places")
    facts = media.read_payloads(places).join(media.read_headers(places), "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(facts, "digest").drop("digest")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents),
     f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
                  100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM w),
     l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     x AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
     g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
     k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
     o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS o FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
     y AS (SELECT g.*, o, k AS step, o[k] AS own, list_bool_or(list_transform(o[1:k - 1], lambda i: fails[i])) AS gone FROM g, o, k),
     z AS (SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, own,
                  sum(n) FILTER (NOT fails[own] AND NOT coalesce(gone, false)) AS kept, sum(n) FILTER (fails[own] AND NOT coalesce(gone, false)) AS removed,
                  sum(n) FILTER (fails[own] AND gone) AS redundant, sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
                  sum(good) FILTER (fails[own] AND NOT coalesce(gone, false)) AS good_lost, sum(toxic) FILTER (fails[own] AND NOT coalesce(gone, false)) AS toxic_lost
           FROM y GROUP BY part, o, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM z
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))


OP13 = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     u AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS u,
                  list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM h),
     n AS (SELECT *, CAST(len(u) AS BIGINT) AS n FROM u),
     c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
     p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""

QUERIES = {"op1_ngram_join": op1_ngram_join, "op8_embedding_dedup": op8_embedding_dedup, "op4_lm_score": op4_lm_score, "op5_token_counts": op5_token_counts, "op6_quality": op6_quality, "op9_bpe": op9_bpe, "op10_media": op10_media, "op2_warc": op2_warc, "op3_language_id": op3_language_id, "op7_mixing": op7_mixing, "op11_pieces": op11_pieces, "op12_filter_audit": op12_filter_audit, "op13_fill_middle": op13_fill_middle}
ORACLE = {"op1_ngram_join": OP1, "op8_embedding_dedup": OP8, "op2_warc": OP2, "op7_mixing": OP7, "op12_filter_audit": OP12, "op13_fill_middle": OP13}
