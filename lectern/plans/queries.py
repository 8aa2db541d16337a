"""The registered queries: operators over the whole given tables.

Lines are documents wrapped at twelve tokens, so every word of every text is in one; predictions are lines misread by a
fixed exchange of letters.  Conversations are pages whose turns are lines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import align, changes, image, ledger, noise, report, rules, signal, split, summits, tfidf
from ..operators.spread import widened
from ..sources import package, readers, shared, writers
from ..streaming import pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    package.send(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line_no, line."""
    return widened(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(T.wrapped(F.col("text"))).alias("line_no", "line"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("pred", T.swapped(F.col("line")))


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and truth of each conversation: the second turn is missed, and a heading is read before the first."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    truth = t.select("page_id", F.col("turn").alias("gt_idx"), F.col("text").alias("gt"))
    read = t.where("turn <> 1").select("page_id", F.when(F.col("turn") == 0, 1).otherwise(F.col("turn")).alias("pred_idx"), T.swapped(F.col("text")).alias("pred"))
    heading = t.where("turn = 0").select("page_id", F.lit(0).alias("pred_idx"), F.concat(F.lit("X "), "role").alias("pred"))
    return read.unionAll(heading), truth


def accent_norm_n1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"), F.length(T.normalise(F.col("text"))).cast("long").alias("length"))


def accent_norm_n2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_all(F.col("text"))).alias("digest"), F.length(T.fold_all(F.col("text"))).cast("long").alias("length"))


def word_counts(spark, sf_dir) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("w"))
    return w.groupBy("lang", T.word_key(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


def words_distinct(spark, sf_dir):
    return word_counts(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))


def spanish(spark, sf_dir) -> DataFrame:
    return rules.dictionary(table(spark, sf_dir, "documents").where("lang = 'es'"), "text")


def oov_rate(spark, sf_dir):
    r = rules.out_of_vocabulary(word_counts(spark, sf_dir), spanish(spark, sf_dir), "word", "n", "lang")
    return r.withColumn("rate", F.col("unknown") / F.col("tokens"))


def cedilla_rule(spark, sf_dir):
    x = lines(spark, sf_dir)
    return x.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(T.plain_cedilla(F.col("line")) != F.col("line")).alias("changed"))


def uv_fs_variants(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).distinct()
    return w.groupBy("lang").agg(F.sum(F.size(T.variants(F.col("w"), "uv"))).cast("long").alias("uv"), F.sum(F.size(T.variants(F.col("w"), "fs"))).cast("long").alias("fs"), F.count("*").alias("words"))


def token_counts(spark, sf_dir) -> DataFrame:
    t = pairs(spark, sf_dir).select("lang", F.explode(T.tokens(T.plain_cedilla(F.col("pred")))).alias("token"))
    return t.groupBy("lang", "token").agg(F.count("*").alias("n"))


def apply_rules(spark, sf_dir):
    """Misread tokens that the rules change, and those that they set right, by language; the dictionary is French."""
    known = rules.dictionary(table(spark, sf_dir, "documents").where("lang = 'fr'"), "text")
    t = token_counts(spark, sf_dir)
    fixed = t.join(rules.corrections(t, known), "token")
    right = T.swapped(F.col("token"))
    return fixed.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("corrected") != F.col("token"), F.col("n")).otherwise(0)).alias("changed"), F.sum(F.when((F.col("corrected") != F.col("token")) & (F.col("corrected") == right), F.col("n")).otherwise(0)).alias("restored"))


def rules_on_lines(spark, sf_dir):
    """The rules over whole lines, white space kept: changed lines and the rate before and after, by language."""
    known = rules.dictionary(table(spark, sf_dir, "documents").where("lang = 'fr'"), "text")
    x = rules.apply_rules(pairs(spark, sf_dir).drop("lang"), known, ["doc_id", "line_no"], "pred")
    d = x.select(F.levenshtein("pred", "line").alias("b"), F.levenshtein("corrected", "line").alias("a"), F.length("line").alias("n"), (F.col("corrected") != F.col("pred")).alias("c"))
    return d.agg(F.count("*").alias("lines"), F.count_if("c").alias("changed"), F.sum("b").alias("edits_before"), F.sum("a").alias("edits_after"), F.sum("n").alias("ref_len"))


def cer_micro_by_lang(spark, sf_dir):
    p = pairs(spark, sf_dir).select("lang", T.normalise(F.col("pred")).alias("p"), T.normalise(F.col("line")).alias("r"))
    d = p.groupBy("lang").agg(F.sum(M.char_distance(F.col("p"), F.col("r"))).alias("edits"), F.sum(F.length("r")).alias("ref_len"))
    return d.withColumn("cer", F.col("edits") / F.greatest("ref_len", F.lit(1)))


def cer_macro_by_lang(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.groupBy("lang").agg(M.macro(M.line_rate(M.char_distance(F.col("pred"), F.col("line")), F.col("line"))).alias("cer"), F.count("*").alias("lines"))


def _pair_metric(name, f):
    def query(spark, sf_dir):
        return pairs(spark, sf_dir).groupBy("lang").agg(M.macro(f(F.col("pred"), F.col("line"))).alias(name), F.count("*").alias("lines"))

    return query


cer_spacefree = _pair_metric("rate", M.pair_char_rate)
wer_pair = _pair_metric("rate", M.pair_word_rate)
bleu_sentence = _pair_metric("bleu", M.sentence_bleu)
jaccard = _pair_metric("jaccard", M.jaccard)
cosine_bow = _pair_metric("cosine", M.bag_cosine)


def _tfidf(terms):
    def query(spark, sf_dir):
        t = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "role", "text")
        c = tfidf.cosines(widened(t.select("k", "text")).select("k", F.col("text").alias("a"), T.swapped(F.col("text")).alias("b")), "k", "a", "b", terms)
        return t.select("k", "role").join(c, "k").groupBy("role").agg(M.macro(F.col("cosine")).alias("cosine"), F.count("*").alias("turns"))

    return query


tfidf_cosine_word = _tfidf(tfidf.word_terms)
tfidf_cosine_charwb = _tfidf(tfidf.char_terms)


def wordcount_guard(spark, sf_dir):
    """Each turn with the next as its correction: statuses with exact and loose guards."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("next", F.coalesce(F.lead("text").over(w), "text"))
    exact, loose = T.guarded(F.col("text"), F.col("next")), T.guarded(F.col("text"), F.col("next"), 2)
    return t.groupBy("role", exact["status"].alias("exact"), loose["status"].alias("loose")).agg(F.count("*").alias("turns"))


def positional_outer(spark, sf_dir):
    p, g = turns(spark, sf_dir)
    out = align.positional(p.withColumnRenamed("pred_idx", "pos"), g.withColumnRenamed("gt_idx", "pos"), ["page_id", "pos"])
    return out.select("page_id", "pos", "pred", "gt", "matched")


def positional_anti(spark, sf_dir):
    """Turns whose place nothing was read at: the last of each conversation is not."""
    p, g = turns(spark, sf_dir)
    last = g.groupBy("page_id").agg(F.max("gt_idx").alias("last"))
    p = p.join(last, "page_id").where("pred_idx < last").drop("last")
    return align.unmatched(p.withColumnRenamed("pred_idx", "pos"), g.withColumnRenamed("gt_idx", "pos"), ["page_id", "pos"])


def sequential_cer(spark, sf_dir):
    p, g = turns(spark, sf_dir)
    return align.sequential_rate(p, g, "page_id")


def benchmark_lines(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.wrapped(F.col("text"), 4)).alias("n", "gt"))
    return b.select((F.col("item_id") * 1_000_000 + F.col("n")).alias("gt_idx"), "gt")


def best_match(spark, sf_dir):
    """Misread benchmark lines against all benchmark lines."""
    g = benchmark_lines(spark, sf_dir)
    p = g.select(F.col("gt_idx").alias("own"), F.substring(T.swapped(F.col("gt")), F.lit(2), F.length("gt")).alias("pred"))
    return align.nearest(p, g).select("own", "pred", "matched_idx", "distance", "matched_gt", (F.col("own") != F.col("matched_idx")).alias("shifted"))


def nw_align(spark, sf_dir):
    return align.align_pages(*turns(spark, sf_dir))


def stream_align(spark, sf_dir):
    """The alignment of conversations whose turns come as a stream, from the file sink that it writes."""
    schema = table(spark, sf_dir, "conversations").schema
    came = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]").withColumn("ts", F.timestamp_seconds(F.col("turn") + 86_400))  # a time of its own for each turn, behind the first watermark
    keys = [F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("turn")]
    truth = came.select(*keys, F.col("turn").cast("int").alias("gt_idx"), F.col("text").alias("gt"), "ts")
    read = F.when(F.col("turn") == 0, F.array(F.struct(F.lit(0).alias("i"), F.concat(F.lit("X "), "role").alias("x")), F.struct(F.lit(1).alias("i"), T.swapped(F.col("text")).alias("x"))))
    read = came.where("turn <> 1").select("conv_id", "ts", F.explode(read.otherwise(F.array(F.struct(F.col("turn").cast("int").alias("i"), T.swapped(F.col("text")).alias("x"))))).alias("p"))
    preds = read.select(F.col("conv_id").alias("page_id"), F.col("p.i").alias("pred_idx"), F.col("p.x").alias("pred"), "ts")
    p, g = turns(spark, sf_dir)
    sizes = g.groupBy("page_id").agg(F.count("*").cast("int").alias("n_truth")).join(p.groupBy("page_id").agg(F.count("*").cast("int").alias("n_pred")), "page_id")
    folder = shared.new_folder(spark, "stream")
    rows = pages.align_stream(pages.page_lines(preds, truth, shared.saved(sizes, folder, "sizes")))
    pages.start(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def exchanged() -> Callable[[str], str]:
    """What `T.swapped` does, as a service of a model stage."""
    to = str.maketrans("uvfsUVFS", "vusfVUSF")
    return lambda text: text.translate(to)


def quota_stage(spark, sf_dir):
    """Turns answered by a service whose daily quota ends in the first run; a second one asks only for the rest."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    folder = shared.new_folder(spark, "ledger")
    half = t.select("text").distinct().count() // 2
    ledger.ask(t, exchanged, folder, per_day=half, every=50)
    ledger.ask(t, exchanged, folder, every=50)
    spent = ledger.entries(spark, folder).groupBy("digest").agg(F.sum("requests").alias("requests")).agg(F.max("requests").alias("most"))
    out = ledger.answered(t, folder, "text", "answer").crossJoin(F.broadcast(spent))  # one row
    return out.select("conv_id", "turn", "status", F.md5("answer").alias("digest"), F.col("most").alias("most_requests"))


def aggregate_cer(spark, sf_dir):
    return align.aggregate_rates(align.align_pages(*turns(spark, sf_dir)), "page_id")


def exclusion_report(spark, sf_dir):
    """Mean rates with and without lines over 0.8, and how many those are; nothing is left out unsaid."""
    a = align.align_pages(*turns(spark, sf_dir)).where("not skipped and matched_gt <> ''")
    rate = M.line_rate(F.levenshtein("pred_text", "matched_gt"), F.col("matched_gt"))
    kept = rate <= 0.80
    return a.agg(M.macro(rate).alias("all_cer"), M.macro(F.when(kept, rate)).alias("kept_cer"), F.count_if(~kept).alias("n_excluded"), F.count("*").alias("lines"))


def stage_rates(spark, sf_dir):
    """Raw, rule-corrected and fully corrected turns against the partners of the last, lines over 0.8 left out and counted."""
    p, g = turns(spark, sf_dir)
    final = p.withColumn("final", T.swapped(F.col("pred")))
    a = align.align_pages(final.select("page_id", "pred_idx", F.col("final").alias("pred")), g)
    stages = final.select("page_id", "pred_idx", F.col("pred").alias("raw"), T.plain_cedilla(F.col("pred")).alias("rules"), "final")
    return align.stage_rates(a, stages, ["raw", "rules", "final"], most=0.80)


def band_report(spark, sf_dir):
    """Lines by error band, as shown and as trained, and language."""
    rate = M.line_rate(M.char_distance(F.col("pred"), F.col("line")), F.col("line"))
    return pairs(spark, sf_dir).groupBy("lang", report.band(rate).alias("band"), report.band(rate, "trained").alias("trained")).agg(F.count("*").alias("lines"))


def improvement_flags(spark, sf_dir):
    """Whether exchanging the cedilla brought lines nearer to the truth."""
    rate = lambda c: M.line_rate(F.levenshtein(c, F.col("line")), F.col("line"))
    flag = report.improvement(rate(F.col("pred")), rate(T.plain_cedilla(F.col("pred"))))
    return pairs(spark, sf_dir).groupBy("lang", flag.alias("flag")).agg(F.count("*").alias("lines"))


def wer_corpus(spark, sf_dir):
    r = pairs(spark, sf_dir).groupBy("lang").agg(*M.corpus_rates("pred", "line"))
    return r.select("lang", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


def bleu_corpus(spark, sf_dir):
    c = pairs(spark, sf_dir).select("lang", M.bleu_counts(F.col("pred"), F.col("line")).alias("c"))
    return c.groupBy("lang").agg(F.round(M.corpus_bleu("c"), 9).alias("bleu"), F.count("*").alias("lines"))


cosine_counts = _pair_metric("cosine", M.count_cosine)


def metric_bundle(spark, sf_dir):
    """Means of the rounded pairwise rates."""
    b = pairs(spark, sf_dir).select("lang", M.count_bundle(F.col("pred"), F.col("line")).alias("b"))
    return b.groupBy("lang").agg(*[F.round(F.avg(f"b.{k}"), 9).alias(k) for k in ("cer", "wer", "cosine")])


def stage_report(spark, sf_dir):
    """(stage, metric, value) of the raw and the rule-corrected lines."""
    p = pairs(spark, sf_dir).select("line", F.explode(F.array(F.struct(F.lit("raw").alias("stage"), F.col("pred").alias("x")), F.struct(F.lit("rules").alias("stage"), T.plain_cedilla(F.col("pred")).alias("x")))).alias("s"))
    wide = p.select("line", "s.*").groupBy("stage").agg(*M.corpus_rates("x", "line"), F.count("*").alias("lines"))
    return report.long_report(wide, "stage", ["cer", "wer", "lines"]).select("stage", "metric", F.round("value", 9).alias("value"))


def run_summary(spark, sf_dir):
    """Turns read and turns there, by conversation and over all."""
    p, g = turns(spark, sf_dir)
    p = p.where("pred_idx <> 2")
    return report.run_summary(p.withColumnRenamed("pred_idx", "pos"), g.withColumnRenamed("gt_idx", "pos"), ["page_id", "pos"], "page_id")


def skipped_folders(spark, sf_dir):
    """Numbers that are a page without a document, or a document without a page, or a page of little html."""
    images = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.length("html") >= 200).alias("readable"))
    return report.skipped(images, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


def first_lines(spark, sf_dir):
    return report.head(lines(spark, sf_dir).select("doc_id", "line_no", "line"), 19, "doc_id", "line_no")


def token_spans(spark, sf_dir):
    """Tokens of each turn with their places."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.spans(F.col("text"))).alias("s"))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("tokens"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends"))


def folder_rollup(spark, sf_dir):
    """Edits, lengths and rates by document and over all, in one aggregate; the rate also as it is shown."""
    d = pairs(spark, sf_dir).select("doc_id", F.levenshtein("pred", "line").alias("e"), F.length("line").alias("n"))
    r = d.rollup("doc_id").agg(F.sum("e").alias("edits"), F.sum("n").alias("ref_len"), F.count("*").alias("lines"))
    rate = F.col("edits") / F.greatest("ref_len", F.lit(1))
    return r.withColumns({"cer": rate, "shown": writers.percent(F.round(rate, 4))})


def page_documents(spark, sf_dir):
    """Each document's lines nested in order, as JSON, by digest."""
    d = writers.page_documents(lines(spark, sf_dir), "doc_id", "line_no", ["line"])
    return d.select("doc_id", F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("digest"), "total_lines")


def word_changes(spark, sf_dir) -> DataFrame:
    """Changes of each word that stands at the same place: misread ones, and ones with a full stop behind them."""
    x = lines(spark, sf_dir)
    forms = F.array(T.tokens(T.swapped(F.col("line"))), F.transform(T.tokens(F.col("line")), lambda w: F.concat(w, F.lit("."))))
    p = x.select(T.tokens(F.col("line")).alias("c"), F.explode(forms).alias("o")).select(F.explode(F.arrays_zip("o", "c")).alias("z"))
    p = p.select(F.col("z.c").alias("corrected"), F.col("z.o").alias("original")).where("corrected <> original")
    return p.withColumn("is_ocr_error", T.same_letters(F.col("original"), F.col("corrected")))


def surface_forms(spark, sf_dir):
    """Forms of the same word with their counts."""
    return changes.surface_forms(word_changes(spark, sf_dir))


def spelling_errors(spark, sf_dir):
    return changes.spelling_errors(word_changes(spark, sf_dir)).groupBy("corrected", "original").agg(F.count("*").alias("n"))


def nested_forms(spark, sf_dir):
    """Words with the number of their forms and of all uses, from the nested counter."""
    n = changes.nested_counts(changes.surface_forms(word_changes(spark, sf_dir)))
    return n.select("corrected", F.size("originals").alias("forms"), F.aggregate(F.map_values("originals"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


def text_changes(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(w)).where("next is not null")
    return changes.change_rows(t, ["conv_id", "turn"], "text", "next")


def page_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("val", split.in_validation(F.col("doc_id")))
    return d.groupBy("val", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def training_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir).select(F.col("pred").alias("ocr_output"), T.plain_cedilla(F.col("pred")).alias("rule_corrected"), F.col("line").alias("ground_truth"))
    t = split.training_pairs(p, p.select(F.col("ground_truth").alias("gold")))
    return t.groupBy("kind").agg(F.count("*").alias("pairs"), F.sum(F.length("source")).alias("source_chars"), F.sum(F.length("target")).alias("target_chars"))


#: Groups of letters that old type confuses: each is read as the next of its group.  Letters that break into two, and letters
#: printed twice that are read once.
SHAPES, BROKEN, DOUBLED = ("un", "bv", "fs", "ce", "ilt", "o0"), {"m": "rn", "w": "vv", "d": "cl"}, "lrs"


def misread() -> list[tuple[str, int, str, str]]:
    """Rows of a table of readings: shapes, accents lost (by their decomposition) and put on, letters broken and doubled."""
    shapes = [(g[i], g[(i + 1) % len(g)]) for g in SHAPES for i in range(len(g))]
    accents = [(c, unicodedata.normalize("NFD", c)[0]) for c in "áéíóúüñ"]
    type_ = [*shapes, *accents, *((b, a) for a, b in accents if a in "áén"), *((2 * c, c) for c in DOUBLED), *((c, 2 * c) for c in DOUBLED)]
    kinds = {"word": [*accents, *BROKEN.items(), *shapes], "type": type_, "edit": [*shapes, *BROKEN.items()]}
    return [(k, i, a, b) for k, x in kinds.items() for i, (a, b) in enumerate(x)]


def misreadings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(misread(), "kind string, place int, seen string, read string")


def noise_kinds(spark, sf_dir):
    """Each turn with every kind of error: changed or not, its length and its digest."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", noise.salt(["conv_id", "turn"], 42).alias("salt"))
    r = noise.readings(misreadings(spark))
    kinds = {"words": noise.word_errors, "type": noise.old_type, "edits": noise.edits}
    x = t.select("conv_id", "turn", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), f(F.col("text"), F.col("salt"), r).alias("noisy")) for k, f in kinds.items()))).alias("x"))
    return x.select("conv_id", "turn", "x.kind", (F.col("x.noisy") != F.col("text")).alias("changed"), F.length("x.noisy").alias("chars"), F.md5("x.noisy").alias("digest"))


def augmented_pairs(spark, sf_dir):
    """All four kinds of pairs of turns, five noisy ones each."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    p = t.select(T.swapped(F.col("text")).alias("ocr_output"), T.plain_cedilla(T.swapped(F.col("text"))).alias("rule_corrected"), F.col("text").alias("ground_truth"))
    all_ = split.training_pairs(p, t.select(F.col("text").alias("gold")), noise.synthetic(t, "text", ["conv_id", "turn"], misreadings(spark), 5))
    return all_.groupBy("kind").agg(F.count("*").alias("pairs"), F.sum(F.length("source")).alias("source_chars"), F.sum(F.length("target")).alias("target_chars"))


def synthetic_noise(spark, sf_dir):
    """Five noisy forms of each turn: whether they differ, and their digests."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = noise.synthetic(t, "text", ["conv_id", "turn"], misreadings(spark), 5)
    return n.select("conv_id", "turn", "copy", (F.col("gold") != F.col("noisy")).alias("changed"), F.md5("noisy").alias("digest"))


def context_prev3(spark, sf_dir):
    """Each token of a turn with the three before it."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t")).select("conv_id", "turn", "t", F.posexplode("t").alias("pos", "word"))
    before = F.when(F.col("pos") > 0, F.array_join(F.slice("t", F.greatest(F.col("pos") - 2, F.lit(1)), F.least(F.col("pos"), F.lit(3))), " ")).otherwise("")
    return x.select("conv_id", "turn", "pos", "word", before.alias("context"))


def context_pm5(spark, sf_dir):
    """Each token of a turn in brackets with up to five on either side."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t")).select("conv_id", "turn", "t", F.posexplode("t").alias("pos", "word"))
    a = F.greatest(F.col("pos") - 5, F.lit(0))
    left = F.slice("t", a + 1, F.col("pos") - a)
    right = F.slice("t", F.col("pos") + 2, F.lit(5))
    return x.select("conv_id", "turn", "pos", F.array_join(F.concat(left, F.array(F.concat(F.lit("["), "word", F.lit("]"))), right), " ").alias("input"))


#: What peaks of the events' values have to have.
PEAK_HEIGHT, PEAK_DISTANCE, PEAK_PROMINENCE = 40.0, 5, 20.0


def profile(spark, sf_dir) -> DataFrame:
    """A signal per user: the values of events in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), (F.row_number().over(w) - 1).alias("y"), F.col("value").alias("ink"))


def moving_avg(spark, sf_dir):
    m = signal.moving_average(profile(spark, sf_dir), "page_id", "y", "ink", 5)
    return m.select("page_id", "y", F.round("smooth", 6).alias("smooth"))


def islands(spark, sf_dir):
    return signal.islands(profile(spark, sf_dir), "page_id", "y", "ink >= 20", 2)


def autocorr(spark, sf_dir):
    a = signal.autocorrelation(profile(spark, sf_dir), "page_id", "y", "ink", 12)
    return a.select("page_id", "lag", F.round("acf", 6).alias("acf"))


def line_segments(spark, sf_dir):
    """The lengths of a document's lines by position as the profile of a page: as long as the text in one row, no longer."""
    ink = F.transform(T.wrapped(F.col("text")), lambda x: F.length(x).cast("double"))
    return signal.line_segments_of_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), ink.alias("ink")))


def ink_levels(spark, sf_dir):
    r = signal.levels(profile(spark, sf_dir), "page_id", "ink")
    return r.select("page_id", *[F.round(k, 6).alias(k) for k in ("p10", "p20", "p75")])


def cut_segments(spark, sf_dir):
    """Stretches of three values and more between small ones."""
    return signal.between_cuts(profile(spark, sf_dir), "page_id", "y", "ink", "ink < 12", 3)


def signal_peaks(spark, sf_dir):
    """Peaks of one signal, the values of all events in order of their ids: no page of it fits a task at scale."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("signal"), "event_id", "value")
    p = summits.peaks(e, "signal", "event_id", "value", PEAK_HEIGHT, PEAK_DISTANCE, PEAK_PROMINENCE)
    return p.select("pos", "value", F.round("prominence", 6).alias("prominence"))


def absorbed_segments(spark, sf_dir):
    """Stretches of values between small ones, those that are too short joined to their neighbours."""
    cuts = signal.between_cuts(profile(spark, sf_dir), "page_id", "y", "ink", "ink < 12", 1).withColumn("line", F.lit(5))
    return signal.absorb(cuts, "page_id", "y1", "y2", "line")


def component_periods(spark, sf_dir):
    """Line periods from components as high as a line's words are long, and as large as the line."""
    c = lines(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("line"))).alias("t"), F.length("line").alias("area")).select("doc_id", F.length("t").alias("height"), "area", F.lit(16).alias("page_height"))
    return signal.component_periods(c, "doc_id", "page_height")


def text_line_boxes(spark, sf_dir):
    """Boxes of text lines found in pages that are drawn from turns, with their padded form."""
    t = widened(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.wrapped(F.col("text")).alias("lines"))
    b = image.text_lines(image.drawn(t, "id", "lines"))
    return b.select("page_id", "line_index", "x1", "y1", "x2", "y2", "area", F.col("padded.x1").alias("left"), F.col("padded.y1").alias("top"), F.col("padded.x2").alias("right"), F.col("padded.y2").alias("bottom"), "period", "method")


def noise_area_filter(spark, sf_dir):
    """Boxes as long as a line's text and as high as its words are long, noise left out by each document's median."""
    b = lines(spark, sf_dir).select("doc_id", "line_no", (F.length("line") * F.length(F.element_at(T.tokens(F.col("line")), 1))).cast("double").alias("area"))
    return signal.plausible(b, "doc_id", "area").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("area").alias("area"))


def changed_counts(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("rule", T.plain_cedilla(F.col("pred")))
    return p.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(F.expr("pred <> line")).alias("ocr_changed"), F.count_if(F.expr("rule <> line")).alias("rule_changed"), F.count_if(F.expr("rule <> pred")).alias("rule_fixed"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("digest"), F.length(T.escape_html(F.col("html"))).cast("long").alias("length"))


def word_punct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.word_punct(F.col("text"))).cast("long").alias("tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("words"))


def trailing_blank(spark, sf_dir):
    """Lines of documents with a blank end put on and taken off again; blank lines between stay."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.concat("text", F.lit("\n \n")), "\n")).alias("gt_idx", "gt"))
    return readers.without_blank_end(t).groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.length("gt")).alias("chars"))


def throughput_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(T.tokens(F.col("text")))).cast("long").alias("words"), F.count("*").alias("texts"))


NAMES = (
    "accent_norm_n1 accent_norm_n2 words_distinct oov_rate cedilla_rule uv_fs_variants apply_rules rules_on_lines cer_micro_by_lang cer_macro_by_lang cer_spacefree wer_pair bleu_sentence jaccard cosine_bow "
    "tfidf_cosine_word tfidf_cosine_charwb wordcount_guard positional_outer positional_anti sequential_cer best_match nw_align stream_align quota_stage aggregate_cer exclusion_report stage_rates band_report improvement_flags wer_corpus bleu_corpus cosine_counts metric_bundle stage_report run_summary skipped_folders first_lines token_spans folder_rollup page_documents surface_forms spelling_errors nested_forms "
    "text_changes page_split training_pairs augmented_pairs synthetic_noise noise_kinds context_prev3 context_pm5 moving_avg islands autocorr ink_levels cut_segments signal_peaks absorbed_segments component_periods line_segments text_line_boxes noise_area_filter changed_counts html_escape word_punct trailing_blank throughput_words"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
