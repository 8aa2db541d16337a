"""Queries over files: given tables are written to the shared folder in each format, read back, and told as rows; with SQL.

Conversations are pages whose turns are lines, as elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import pixels, split, stages
from ..operators.spread import widened
from ..sources import crops, docx, readers, shared, writers
from .oracle import CODED, LINES, LISTS, key, lev, swap, toks
from .queries import exchanged, lines, pairs, table


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")


def csv_lines(spark, sf_dir):
    """Lines of documents, some with quotes and commas, through a quoted CSV with Windows paths: by page."""
    rows = lines(spark, sf_dir).select(F.concat(F.lit("out\\lines\\"), "doc_id", F.lit("\\"), "line_no", F.lit(".png")).alias("image_path"), F.when(F.col("line_no") % 2 == 0, F.concat(F.lit('"'), "line", F.lit('", \\ he said'))).otherwise(F.col("line")).alias("transcription"))
    folder = shared.new_folder(spark, "csv")
    writers.line_csv(rows, folder)
    back = readers.line_csv(spark, folder)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "transcription"))), lambda x: x["transcription"]), "\n")
    return back.groupBy("page_id").agg(F.count("*").alias("lines"), F.md5(ordered).alias("digest"))


def folder_texts(spark, sf_dir):
    """Turns as lines of text files in numbered folders, every other one in Latin-1, with blank lines at the end."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.replace(x["text"], F.lit("\n"), F.lit(" "))), "\n")
    pages = page_turns(spark, sf_dir).groupBy("conv_id").agg(F.concat(body, F.lit("\n\n  \n")).alias("t"))
    pages = pages.select("conv_id", F.lit("transcription.txt").alias("name"), F.when(F.col("conv_id") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "ISO-8859-1")).alias("content"))
    folder = shared.new_folder(spark, "texts")
    writers.page_files(pages, folder, "conv_id", "name", "content")
    return readers.page_texts(spark, folder).select("page_id", "gt_idx", F.md5("gt").alias("digest"))


def mapping_files(spark, sf_dir):
    """Nested page documents in files of their own, back as matched lines of crops that exist."""
    t = page_turns(spark, sf_dir).withColumns({"crop_file": F.concat(F.lit("line_"), "turn", F.lit(".png")), "matched": F.col("role") == "user"})
    line = F.struct(F.col("turn").alias("line_index"), "crop_file", F.array(F.lit(0), "turn", F.lit(9), F.col("turn") + 1).alias("bbox_original"), F.concat(F.lit(" "), "text").alias("transcription"), "matched")
    doc = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("*").cast("int").alias("total_detected_lines"))
    doc = doc.select("conv_id", F.lit("mapping.json").alias("name"), F.to_json(F.struct(F.col("conv_id").cast("string").alias("folder_id"), "total_detected_lines", "lines")).alias("content"))
    folder = shared.new_folder(spark, "mapping")
    writers.page_files(doc, folder, "conv_id", "name", "content")
    crops = t.where("turn % 4 <> 2").select(F.col("conv_id").cast("string").alias("folder_id"), "crop_file")
    return readers.mapping_lines(spark, folder, crops).select("folder_id", "line_index", "crop_file", F.col("bbox_original")[3].alias("bottom"), F.md5("transcription").alias("digest"))


def prediction_files(spark, sf_dir):
    """Predictions as JSON arrays, some without a corrected form, back as rows."""
    t = page_turns(spark, sf_dir)
    rows = t.select(T.swapped(F.col("text")).alias("ocr_output"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("by rule: "), "text")).alias("rule_corrected"), F.col("text").alias("ground_truth"), F.concat_ws("/", "conv_id", "turn").alias("image_path"))
    folder = shared.new_folder(spark, "predictions")
    writers.json_array(rows, folder)
    return readers.predictions(spark, folder).select("image_path", *(F.md5(c).alias(c) for c in ("ocr_output", "rule_corrected", "ground_truth")))


def trainer_history(spark, sf_dir):
    """Events of a user as a trainer's log: clicks are training steps, views evaluations, all else no rows."""
    entry = F.struct(F.col("event_id").cast("int").alias("step"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"), F.when(F.col("event_type") == "view", F.col("value") / 100).alias("eval_cer"))
    folder = shared.new_folder(spark, "trainer")
    writers.json_array(table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(entry).alias("log_history")).select("log_history"), folder)
    return readers.trainer_log(spark, folder)


def evaluation_document(spark, sf_dir):
    """Rates by language as one document of metrics, and one value of it looked up by path."""
    rates = pairs(spark, sf_dir).groupBy(F.col("lang").alias("stage")).agg(*M.corpus_rates("pred", "line")).select("stage", F.round("cer", 6).alias("CER"), F.round("wer", 6).alias("WER"))
    folder = shared.new_folder(spark, "metrics")
    writers.json_documents(writers.metrics_document(rates).coalesce(1), folder)
    paths = [("es", "CER"), ("es", "WER"), ("none", "CER")]
    found = [readers.json_value(spark, f"{folder}/*.json", f"$.metrics.{s}.{m}").select(F.lit(f"{s}.{m}").alias("path"), F.col("value").try_cast("double").alias("value"), (F.col("value") == "N/A").alias("missing")) for s, m in paths]
    return found[0].unionAll(found[1]).unionAll(found[2])


def vocabulary_file(spark, sf_dir):
    """The words of a text file of all turns, as a dictionary."""
    folder = shared.new_folder(spark, "vocabulary")
    table(spark, sf_dir, "conversations").select(F.col("text").alias("value")).write.text(folder)
    return readers.vocabulary(spark, folder)


def page_images(spark, sf_dir):
    """The image of each page among files of a folder: a source before others, and then the first by name."""
    names = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a.png"), F.lit("source.TIF"), F.lit("source.jpg"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("b.jpg"), F.lit("a.tiff"), F.lit("note.txt"))).otherwise(F.array(F.lit("c.bmp"), F.lit("c.gif")))
    pages = page_turns(spark, sf_dir).where("turn = 0").select("conv_id", "text", F.explode(names).alias("name"))
    folder = shared.new_folder(spark, "images")
    writers.page_files(pages, folder, "conv_id", "name", "text")
    found = readers.images(spark, folder)
    number = readers.page_folders(found).select("page_id", F.col("files").alias("images"))
    return readers.page_image(found).join(number, "page_id").select("page_id", "name", "images")


def remapped_paths(spark, sf_dir):
    """Paths of another machine, led back to files that are here."""
    t = page_turns(spark, sf_dir).select("conv_id", "turn")
    own = F.concat_ws("/", F.lit("output3"), "conv_id", F.concat("turn", F.lit(".png")))
    rows = t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("C:\\work\\"), F.replace(own, F.lit("/"), F.lit("\\")))).when(F.col("turn") % 3 == 1, own).otherwise(F.concat(F.lit("/elsewhere/"), own)).alias("image_path"))
    return readers.resolved(rows, t.where("turn % 4 <> 2").select(own.alias("path")))


def page_meta(spark, sf_dir):
    """What is written beside a page's text: lines, words, and lines by status."""
    t = page_turns(spark, sf_dir).withColumn("status", F.when(F.col("turn") % 2 == 0, "success").otherwise("word_count_mismatch"))
    return writers.text_meta(t, "conv_id", "text", "status").select("conv_id", F.col("lines").cast("long").alias("lines"), F.col("words").cast("long").alias("words"), *(F.coalesce(F.col("statuses")[s], F.lit(0)).cast("long").alias(s) for s in ("success", "word_count_mismatch")))


def text_file(spark, sf_dir):
    """Lines of each language in their order, through text files."""
    folder = shared.new_folder(spark, "text")
    rows = lines(spark, sf_dir).select(F.format_string("%012d %09d ", "doc_id", "line_no").alias("at"), "line").withColumn("line", F.concat("at", "line"))
    writers.text_lines(rows, folder, "at", "line")
    back = spark.read.text(folder).select(F.substring("value", 1, 12).cast("long").alias("doc_id"), F.substring("value", 24, 1 << 30).alias("line"))
    return back.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def model_stages(spark, sf_dir):
    """A model over batches of turns, its outputs joined as precomputed ones, and the guard on them."""

    def load():
        one = exchanged()
        return lambda batch: batch.map(lambda x: one(x) + (" more" if len(x) % 3 == 0 else ""))

    t = page_turns(spark, sf_dir)
    done = stages.run_stage(t.where("turn % 5 <> 4"), load, "text", "made").select("conv_id", "turn", "made")
    both = stages.precomputed(t, done, ["conv_id", "turn"], "text", "made", "candidate")
    return stages.guarded_stage(both, "text", "candidate", "kept").select("conv_id", "turn", "status", F.md5("kept").alias("digest"))


def answers_cleaned(spark, sf_dir):
    """Answers in fences or quotes, without these; and how long to wait after a refusal."""
    t = page_turns(spark, sf_dir).select("conv_id", "turn", F.trim(F.regexp_replace("text", "[\\s\"`]+", " ")).alias("x"))
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```text\n"), "x", F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(' "'), "x", F.lit('" '))).otherwise(F.col("x"))
    wait = T.retry_seconds(F.concat(F.lit("429: please retry in "), (F.col("turn") * 7.5).cast("string"), F.lit("s")), F.lit(1))
    return t.select("conv_id", "turn", F.md5(T.without_fences(wrapped)).alias("digest"), wait.alias("wait"))


def word_snippets(spark, sf_dir):
    """The text around the last token of each turn."""
    t = page_turns(spark, sf_dir).withColumn("at", F.element_at(T.spans(F.col("text")), -1))
    return t.select("conv_id", "turn", F.md5(T.snippet(F.col("text"), F.col("at.start"), F.col("at.end"))).alias("digest"))


def repeated_rows(spark, sf_dir):
    return split.repeated(page_turns(spark, sf_dir), 3).groupBy("role", "copy").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


def docx_paragraphs(spark, sf_dir):
    """Turns as paragraphs of Word files, back by the source of such files."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    files = page_turns(spark, sf_dir).groupBy("conv_id").agg(docx.packed(body).alias("content"))
    folder = shared.new_folder(spark, "docx")
    writers.page_files(files.select("conv_id", F.concat("conv_id", F.lit(".docx")).alias("name"), "content"), folder, "conv_id", "name", "content")
    return docx.paragraphs(spark, folder, recursive=True).select(F.regexp_extract("path", r"/(\d+)\.docx$", 1).cast("int").alias("page_id"), "pos", F.md5("text").alias("digest"))


#: Width of the pages that texts' bytes fill, and the columns of the crops.
PAGE_WIDTH, CROP = 64, (8, 40)


def grey_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' sources as grey images: their bytes, row by row; bytes that don't fill a row are left over."""
    t = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("grey"), F.floor(F.octet_length("html") / PAGE_WIDTH).cast("int").alias("height")).where("height > 0")
    return t.select("page_id", "height", F.lit(PAGE_WIDTH).alias("width"), F.substring("grey", F.lit(1), F.col("height") * PAGE_WIDTH).alias("grey"))


def unbled_pages(spark, sf_dir):
    """Each page without the level around its pixels."""
    return pixels.unbled(grey_pages(spark, sf_dir)).select("page_id", "height", F.md5(F.hex("grey")).alias("digest"))


def levelled_pages(spark, sf_dir):
    """Each page with its contrast levelled by tiles."""
    return pixels.contrasted(grey_pages(spark, sf_dir)).select("page_id", "height", F.md5(F.hex("grey")).alias("digest"))


def crop_files(spark, sf_dir):
    """Bytes of pages' sources as grey rows, one row of crops a page for every eight rows, through PNG files and back."""
    t = widened(grey_pages(spark, sf_dir)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(8))))
    rows = F.least(F.lit(8), F.col("height") - F.col("y")).cast("int")
    own = F.substring("grey", (F.col("y") * PAGE_WIDTH + 1).cast("int"), rows * PAGE_WIDTH)  # a crop carries its rows only
    box = {"grey": own, "x1": F.lit(CROP[0]), "x2": F.lit(CROP[1]), "y1": F.lit(0), "y2": rows, "folder": F.col("page_id").cast("string"), "name": F.concat(F.lit("line_"), "y", F.lit(".png"))}
    folder = shared.new_folder(spark, "crops")
    crops.write(t.withColumns(box), folder)
    number = lambda p: F.regexp_extract("path", p, 1).cast("int")
    return crops.read(spark, folder).select(number(r"/(\d+)/[^/]*$").alias("page_id"), number(r"_(\d+)\.png$").alias("y1"), "height", "width", F.md5(F.hex("grey")).alias("digest"))


NAMES = "csv_lines folder_texts mapping_files prediction_files trainer_history evaluation_document vocabulary_file page_images remapped_paths page_meta text_file model_stages answers_cleaned word_snippets repeated_rows docx_paragraphs crop_files unbled_pages levelled_pages".split()
QUERIES = {n: globals()[n] for n in NAMES}

_HALF = pixels.SQUARE // 2
_PIXELS = f"""t AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) // {PAGE_WIDTH} AS height FROM pages),
        px AS MATERIALIZED (SELECT page_id, height, i // {PAGE_WIDTH} AS y, i % {PAGE_WIDTH} AS x, 16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS v FROM (SELECT *, unnest(range(0, height * {PAGE_WIDTH})) AS i FROM t))"""
_DIGEST = "SELECT page_id, CAST(height AS INTEGER) AS height, md5(string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY y, x)) AS digest"
#: The two tiles beside a pixel and how far it lies between their middles, by the place and the tile's size.
_BESIDE = "greatest(0, least({n} - 1, CAST(floor({p} / {t} - 0.5) AS BIGINT))) AS {a}, greatest(0, least({n} - 1, CAST(floor({p} / {t} - 0.5) AS BIGINT) + 1)) AS {b}, {p} / {t} - 0.5 - floor({p} / {t} - 0.5) AS {f}"
_FOLD = "CASE WHEN {n} = 1 THEN 0 ELSE least({p} % greatest(2 * {n} - 2, 1), 2 * {n} - 2 - {p} % greatest(2 * {n} - 2, 1)) END"
_ROLE = "SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations"
_WORDS = toks("text")
ORACLE = {
    "csv_lines": f"""WITH {LINES}, x AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN '"' || line || '", \\ he said' ELSE line END AS x FROM lines)
        SELECT CAST(doc_id AS INTEGER) AS page_id, count(*) AS lines, md5(string_agg(x, chr(10) ORDER BY line_no)) AS digest FROM x GROUP BY doc_id""",
    "folder_texts": "SELECT CAST(conv_id AS INTEGER) AS page_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS gt_idx, md5(replace(text, chr(10), ' ')) AS digest FROM conversations",
    "mapping_files": f"""WITH t AS ({_ROLE}) SELECT CAST(conv_id AS VARCHAR) AS folder_id, turn AS line_index, 'line_' || turn || '.png' AS crop_file, turn + 1 AS bottom, md5(trim(text)) AS digest
        FROM t WHERE role = 'user' AND turn % 4 <> 2 AND trim(text) <> ''""",
    "prediction_files": f"""WITH t AS ({_ROLE}) SELECT conv_id || '/' || turn AS image_path, md5({swap("text")}) AS ocr_output, md5(CASE WHEN turn % 2 = 0 THEN 'by rule: ' || text ELSE {swap("text")} END) AS rule_corrected, md5(text) AS ground_truth FROM t""",
    "trainer_history": """SELECT CAST(event_id AS INTEGER) AS step, CASE WHEN event_type = 'click' THEN value END AS loss, CASE WHEN event_type = 'view' THEN value END AS eval_loss,
        CASE WHEN event_type = 'view' THEN value / 100 END AS eval_cer, CASE WHEN event_type = 'view' THEN 'eval' ELSE 'train' END AS kind FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL""",
    "evaluation_document": f"""WITH {LINES}, c AS (SELECT lang, round(sum({lev("pred", "line")}) / greatest(sum(length(line)), 1), 6) AS cer FROM pairs GROUP BY lang) {LISTS + CODED},
        w AS (SELECT lang, round(sum(levenshtein(p, q)) / greatest(sum(length(q)), 1), 6) AS wer FROM pairs2 GROUP BY lang)
        SELECT 'es.CER' AS path, cer AS value, false AS missing FROM c WHERE lang = 'es' UNION ALL SELECT 'es.WER', wer, false FROM w WHERE lang = 'es' UNION ALL SELECT 'none.CER', NULL, true""",
    "vocabulary_file": f"SELECT DISTINCT {key('w')} AS word FROM (SELECT unnest({_WORDS}) AS w FROM conversations)",
    "page_images": "SELECT CAST(conv_id AS INTEGER) AS page_id, CASE conv_id % 3 WHEN 0 THEN 'source.jpg' WHEN 1 THEN 'a.tiff' ELSE 'c.bmp' END AS name, CAST(CASE conv_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS images FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0)",
    "remapped_paths": f"""WITH t AS ({_ROLE}), p AS (SELECT conv_id, turn, 'output3/' || conv_id || '/' || turn || '.png' AS own FROM t),
        q AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'C:\\work\\' || replace(own, '/', '\\') WHEN 1 THEN own ELSE '/elsewhere/' || own END AS given FROM p)
        SELECT conv_id, turn, CASE WHEN turn % 4 <> 2 THEN own ELSE given END AS image_path FROM q""",
    "page_meta": f"""SELECT conv_id, count(*) AS lines, CAST(sum(len({_WORDS})) AS BIGINT) AS words, count(*) FILTER (turn % 2 = 0) AS success, count(*) FILTER (turn % 2 = 1) AS word_count_mismatch FROM conversations GROUP BY conv_id""",
    "text_file": f"WITH {LINES} SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY doc_id",
    "model_stages": f"""WITH t AS ({_ROLE}), m AS (SELECT *, CASE WHEN turn % 5 = 4 THEN text ELSE {swap("text")} || CASE WHEN length(text) % 3 = 0 THEN ' more' ELSE '' END END AS c FROM t),
        g AS (SELECT *, trim(text) = '' AS blank, len({toks("text")}) = len({toks("c")}) AS same FROM m)
        SELECT conv_id, turn, CASE WHEN blank THEN 'empty_input' WHEN same THEN 'success' ELSE 'word_count_mismatch' END AS status, md5(CASE WHEN NOT blank AND same THEN c ELSE text END) AS digest FROM g""",
    "answers_cleaned": f"""WITH t AS ({_ROLE}) SELECT conv_id, turn, md5(trim(regexp_replace(text, '[\\s"`]+', ' ', 'g'))) AS digest, CAST(greatest(15.0, turn * 7.5 + 1) AS DOUBLE) AS wait FROM t""",
    "word_snippets": f"""WITH t AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, text, length(regexp_extract(text, '^(.*\\S)\\s*$', 1, 's')) AS stop, length(regexp_extract(text, '^(.*\\s|)\\S+\\s*$', 1, 's')) AS start FROM conversations)
        SELECT conv_id, turn, md5(replace(substr(text, CAST(greatest(start - 50, 0) + 1 AS BIGINT), CAST(least(stop + 50, length(text)) - greatest(start - 50, 0) AS BIGINT)), chr(10), ' ')) AS digest FROM t""",
    "repeated_rows": "SELECT role, CAST(copy AS INTEGER) AS copy, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT role, text, unnest(range(0, 3)) AS copy FROM conversations) GROUP BY role, copy",
    "docx_paragraphs": "SELECT CAST(conv_id AS INTEGER) AS page_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS pos, md5(coalesce(text, '')) AS digest FROM conversations",
    "crop_files": f"""WITH t AS (SELECT page_id, hex(encode(html)) AS h FROM pages), r AS (SELECT page_id, h, length(h) // {2 * PAGE_WIDTH} AS rows FROM t), y AS (SELECT *, unnest(range(0, rows, 8)) AS y1 FROM r)
        SELECT CAST(page_id AS INTEGER) AS page_id, CAST(y1 AS INTEGER) AS y1, CAST(least(8, rows - y1) AS INTEGER) AS height, {CROP[1] - CROP[0]} AS width,
        md5(array_to_string(list_transform(range(y1, least(y1 + 8, rows)), lambda y: substr(h, y * {2 * PAGE_WIDTH} + {2 * CROP[0] + 1}, {2 * (CROP[1] - CROP[0])})), '')) AS digest FROM y""",
    "unbled_pages": f"""WITH {_PIXELS}, a AS (SELECT *, max(v) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS m FROM px),
        b AS (SELECT *, max(m) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS n FROM a),
        c AS (SELECT *, min(n) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS o FROM b),
        d AS (SELECT *, min(o) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) AS q FROM c)
        {_DIGEST} FROM (SELECT page_id, height, y, x, 255 - (q - v) AS v FROM d) GROUP BY page_id, height""",
    "levelled_pages": f"""WITH {_PIXELS}, z AS (SELECT DISTINCT page_id, height, (height + {pixels.TILES - 1}) // {pixels.TILES} AS th, {-(-PAGE_WIDTH // pixels.TILES)} AS tw FROM t WHERE height > 0),
        g AS (SELECT page_id, height, th, tw, y, unnest(range(0, tw * {pixels.TILES})) AS x FROM (SELECT *, unnest(range(0, th * {pixels.TILES})) AS y FROM z)),
        f AS (SELECT g.*, v FROM g JOIN px ON px.page_id = g.page_id AND px.y = {_FOLD.format(n="g.height", p="g.y")} AND px.x = g.x),
        n AS (SELECT page_id, y // th AS r, x // tw AS c, v, th * tw AS area, count(*) AS n FROM f GROUP BY ALL),
        o AS (SELECT page_id, r, c, area, greatest(1, CAST(floor({pixels.CLIP} * area / 256) AS BIGINT)) AS most, sum(greatest(n - greatest(1, CAST(floor({pixels.CLIP} * area / 256) AS BIGINT)), 0)) AS over FROM n GROUP BY page_id, r, c, area),
        l AS (SELECT o.*, CAST(over % 256 AS BIGINT) AS rest, k FROM o, (SELECT unnest(range(0, 256)) AS k)),
        e AS (SELECT l.page_id, l.r, l.c, l.area, k, least(coalesce(n, 0), most) + over // 256 + CASE WHEN k % greatest(256 // greatest(rest, 1), 1) = 0 AND k // greatest(256 // greatest(rest, 1), 1) < rest THEN 1 ELSE 0 END AS n
              FROM l LEFT JOIN n ON n.page_id = l.page_id AND n.r = l.r AND n.c = l.c AND n.v = l.k),
        m AS MATERIALIZED (SELECT page_id, r, c, k, least(255, greatest(0, round_even(sum(n) OVER (PARTITION BY page_id, r, c ORDER BY k) * (255 / area), 0))) AS m FROM e),
        w AS (SELECT px.*, {_BESIDE.format(n=pixels.TILES, p="y", t="th", a="ya", b="yb", f="fy")}, {_BESIDE.format(n=pixels.TILES, p="x", t="tw", a="xa", b="xb", f="fx")} FROM px JOIN z USING (page_id))
        {_DIGEST} FROM (SELECT w.page_id, height, y, x, round_even((m1.m * (1 - fx) + m2.m * fx) * (1 - fy) + (m3.m * (1 - fx) + m4.m * fx) * fy, 0) AS v FROM w
        JOIN m m1 ON m1.page_id = w.page_id AND m1.r = ya AND m1.c = xa AND m1.k = v JOIN m m2 ON m2.page_id = w.page_id AND m2.r = ya AND m2.c = xb AND m2.k = v
        JOIN m m3 ON m3.page_id = w.page_id AND m3.r = yb AND m3.c = xa AND m3.k = v JOIN m m4 ON m4.page_id = w.page_id AND m4.r = yb AND m4.c = xb AND m4.k = v) GROUP BY page_id, height""",
}
