"""Sources: line tables, page texts, mapping files, predictions, trainer logs, images.  Schemas are given, not inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE = "image_path string, transcription string"
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def line_csv(spark: SparkSession, path: str) -> DataFrame:
    """image_path, transcription, page_id, line_no of a quoted CSV with a header; paths may have either slash."""
    rows = spark.read.schema(LINE).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    plain = F.replace("image_path", F.lit("\\"), F.lit("/"))
    number = lambda p: F.regexp_extract(plain, p, 1).try_cast("int")
    return rows.withColumns({"page_id": number(r"(\d+)/[^/]*$"), "line_no": number(r"(\d+)\.[A-Za-z]+$")})


def remapped(path: Column) -> Column:
    """A path from its first component on that begins with output; unchanged if there is none."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    found = F.regexp_extract(plain, r"^(?:[^/]*/)*?(output[^/]*(?:/.*)?)$", 1)
    return F.when(found != "", found).otherwise(path)


def resolved(rows: DataFrame, files: DataFrame, path_col: str = "image_path") -> DataFrame:
    """rows whose path stays where it names one of `files` (path), and is remapped where that does; else it stays too."""
    known = files.select("path").distinct()
    marked = rows.withColumn("__p", remapped(F.col(path_col)))
    marked = marked.join(known.select(F.col("path").alias(path_col), F.lit(True).alias("__own")), path_col, "left").join(known.select(F.col("path").alias("__p"), F.lit(True).alias("__new")), "__p", "left")
    new = F.when(F.col("__own").isNull() & F.col("__new").isNotNull(), F.col("__p")).otherwise(F.col(path_col))
    return marked.withColumn(path_col, new).select(rows.columns)


def decoded(content: Column, errors: str = "latin") -> Column:
    """UTF-8 where the bytes are valid.  Else, by `errors`: Latin-1, which any bytes are; replacement characters; or an error."""
    text = content.cast("string")
    other = {"latin": F.decode(content, "ISO-8859-1"), "replace": F.make_valid_utf8(text), "strict": F.raise_error(F.lit("the text is not UTF-8")).cast("string")}[errors]
    return F.when(F.is_valid_utf8(text), text).otherwise(other)


def page_texts(spark: SparkSession, path: str, trim: bool = True, errors: str = "latin") -> DataFrame:
    """page_id, gt_idx, gt of text files in numbered folders; with `trim`, without the blank lines at the end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    rows = files.select(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).try_cast("int").alias("page_id"), F.posexplode(F.split(decoded(F.col("content"), errors), "\n")).alias("gt_idx", "gt"))
    return without_blank_end(rows) if trim else rows


def page_folders(files: DataFrame) -> DataFrame:
    """(page_id, folder, files) of the numbered folders that files (path) lie in, in numeric order."""
    folder = F.regexp_extract("path", r"^(.*/\d+)/[^/]*$", 1)
    rows = files.select(folder.alias("folder"), F.regexp_extract(folder, r"(\d+)$", 1).try_cast("int").alias("page_id")).where("page_id is not null")
    return rows.groupBy("page_id", "folder").agg(F.count("*").alias("files")).orderBy("page_id", "folder")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a text file, normalised: a dictionary."""
    return spark.read.text(path).select(F.explode(T.tokens(F.col("value"))).alias("w")).select(T.word_key(F.col("w")).alias("word")).distinct()


def json_value(spark: SparkSession, path: str, field: str, missing: str = "N/A") -> DataFrame:
    """One row a document: the value at a JSON path such as $.metrics.CER, or what stands for a missing one."""
    return spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", field), F.lit(missing)).alias("value"))


def without_blank_end(lines: DataFrame, page: str = "page_id", at: str = "gt_idx", text: str = "gt") -> DataFrame:
    """Page lines up to the last that is not blank; blank lines between stay."""
    last = F.max(F.when(F.trim(F.col(text)) != "", F.col(at))).over(Window.partitionBy(page))
    return lines.withColumn("__last", last).where(F.col(at) <= F.col("__last")).drop("__last")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, name, page_id of all images below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    rows = files.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGES)})$"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).try_cast("int").alias("page_id"))


def page_image(found: DataFrame, any_name: bool = False) -> DataFrame:
    """One image a page: source.<ext> in the order of extensions, else the first by name; with `any_name`, by extension alone."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    rank = F.array_position(F.array(*map(F.lit, IMAGES)), ext)
    own = F.when(F.lower("name").rlike(r"^source\.[a-z]+$") | F.lit(any_name), rank).otherwise(100)
    return found.groupBy("page_id").agg(F.min(F.struct(own.alias("r"), "name", "path")).alias("m")).select("page_id", "m.name", "m.path")


MAPPING = (
    "folder_id string, source_image string, detection_stats struct<image_h:int,image_w:int,period_px:int,est_line_h_px:int,acf_confidence:double,pad_v:int,pad_h:int,method:string>, "
    "total_detected_lines int, total_transcription_lines int, matched_pairs int, lines array<struct<line_index:int,crop_file:string,bbox_original:array<int>,bbox_padded:array<int>,transcription:string,matched:boolean>>, "
    "unmatched_transcription_lines array<struct<line_index:int,transcription:string>>"
)


def mapping_lines(spark: SparkSession, path: str, crops: DataFrame | None = None) -> DataFrame:
    """Matched lines with text of all mapping files below a folder; with `crops` (folder_id, crop_file), of crops that exist."""
    docs = spark.read.schema(MAPPING).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "mapping.json").json(path)
    rows = docs.select("folder_id", F.explode("lines").alias("l")).select("folder_id", "l.*")
    rows = rows.where("matched and trim(transcription) <> ''").withColumn("transcription", F.trim("transcription"))
    return rows if crops is None else rows.join(crops, ["folder_id", "crop_file"], "left_semi")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of a JSON array; a missing rule_corrected is the output itself."""
    rows = spark.read.schema("ocr_output string, rule_corrected string, ground_truth string, image_path string").option("multiLine", True).json(path)
    return rows.withColumn("rule_corrected", F.coalesce("rule_corrected", "ocr_output"))


def trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """step, kind (train or eval), loss, eval_loss, eval_cer of a trainer's log_history."""
    docs = spark.read.schema("log_history array<struct<step:int,loss:double,eval_loss:double,eval_cer:double>>").option("multiLine", True).json(path)
    rows = docs.select(F.explode("log_history").alias("r")).select("r.*")
    kind = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    return rows.withColumn("kind", kind).where("kind is not null")
