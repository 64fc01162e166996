"""Scans of the files of the document domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming import DataStreamReader

from inkledger import schemas
from inkledger.functions.text import clean_text, norm_digits


def _json(reader: DataFrameReader | DataStreamReader, path: str, schema: str, multi_line: bool, strict: bool = False) -> DataFrame:
    """Documents of a folder, one a line, or with ``multi_line`` one a file, indented or not. Unreadable ones have ``_corrupt`` set,
    or with ``strict`` fail the query when they are read. Indented files read line by line would all be unreadable, so they
    always fail, with a hint."""
    reader = reader.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    docs = reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() if strict else F.lit(False)
    hint = F.trim("_corrupt") == "{" if not multi_line else F.lit(False)
    fail = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    return docs.filter(F.when(hint, fail("an indented document: read the folder with multi_line=True")).when(bad, fail("unreadable document")).otherwise(True))


def scan_audit(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """Audit documents below a folder with one directory per bank. ``bank_dir`` is the directory's bank, which may differ from
    the payload's. Unreadable documents are skipped, or fail with ``strict``."""
    return _audits(_json(spark.read, path, schemas.AUDIT, multi_line, strict))


def _audits(docs: DataFrame, *more: Column) -> DataFrame:
    above = F.regexp_replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), "/shard=[^/]*$", "")
    directory = F.regexp_replace(F.element_at(F.split(above, "/"), -1), "^[^=]*=", "")
    return docs.select("*", directory.alias("bank_dir"), *more).filter("_corrupt is null").drop("_corrupt")


def stream_audit(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = False, files_per_batch: int = 64) -> DataFrame:
    """The same folder as a stream of bank, file, version and payload (the whole document): every file that comes is read once, its
    modification time is the version of its documents. A document without a bank is of its directory's. As with every folder that
    Spark follows, a file that comes more than a week (maxFileAge) after newer ones is not read."""
    docs = _audits(_json(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path, schemas.AUDIT, multi_line, strict), F.col("_metadata.file_modification_time").alias("changed"))
    own = [c for c in docs.columns if c not in ("changed", "bank_dir")]
    return docs.select(F.coalesce("bank", "bank_dir").alias("bank"), "file", F.col("changed").alias("version"), F.struct(*own).alias("payload"))


def results_to_lines(results: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Lines of raw recognition results, one row each, with the columns beside ``results`` and ``lang``. results: a JSON text in the
    newer layout (columns of texts, scores and polygons) or the older one (a nested list of [polygon, [text, score]]). Text of
    Arabic results is cleaned, digits become ASCII; lines below the confidence are dropped but keep their number."""
    line = "array<struct<text:string,confidence:double,poly:array<array<double>>>>"
    new = F.from_json("results", "array<struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>>>")
    pages = F.get(new, F.lit(0))
    newer = F.zip_with(F.arrays_zip(pages["rec_texts"], pages["rec_scores"]), pages["rec_polys"], lambda a, p: F.struct(a["rec_texts"].alias("text"), a["rec_scores"].alias("confidence"), p.alias("poly")))
    old = F.get(F.from_json("results", "array<array<array<string>>>"), F.lit(0))
    read = lambda i: F.from_json(i[1], "array<string>")
    older = F.transform(old, lambda i: F.struct(read(i)[0].alias("text"), read(i)[1].try_cast("double").alias("confidence"), F.from_json(i[0], "array<array<double>>").alias("poly")))
    lines = F.when(F.size(pages["rec_texts"]) > 0, newer.cast(line)).otherwise(older.cast(line))
    keep = [c for c in results.columns if c not in ("results", "lang")]
    rows = results.select(*keep, "lang", F.posexplode(lines).alias("line_idx", "l")).filter(F.col("l.confidence") >= min_confidence)
    mean = lambda k: F.aggregate(F.col("l.poly"), F.lit(0.0), lambda t, p: t + p[k]) / F.size("l.poly")
    text = norm_digits(F.when(F.col("lang") == "ar", clean_text(F.col("l.text"))).otherwise(F.col("l.text")))
    return rows.select(*keep, "lang", "line_idx", text.alias("text"), F.col("l.text").alias("raw_text"), "l.confidence", mean(0).alias("px"), mean(1).alias("py"), F.col("l.poly").alias("bbox"))


def line_position(line: Column, width: Column, height: Column) -> Column:
    """A line's place in pixels: given, its center, shares of the page, or the middle of its rectangle; NULL without any."""
    pair = lambda a: F.when(F.size(a) >= 2, F.struct(a[0].alias("x"), a[1].alias("y")))
    share = lambda a: F.when(F.size(a) >= 2, F.struct((a[0] * width).alias("x"), (a[1] * height).alias("y")))
    rect = line["bbox_rect"]
    middle = F.when(F.size(rect) >= 4, F.struct(((rect[0] + rect[2]) / 2).alias("x"), ((rect[1] + rect[3]) / 2).alias("y")))
    loose = F.when(line["center_x"].isNotNull() & line["center_y"].isNotNull(), F.struct(line["center_x"].alias("x"), line["center_y"].alias("y")))
    return F.coalesce(pair(line["pos"]), pair(line["center"]), loose, share(line["pos_norm"]), share(line["center_norm"]), middle)


def scan_ocr_lines(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, errors): one row per line with a place, whatever the layout; documents that are unreadable or have no size are
    error rows. Lines without a place are dropped."""
    docs = _json(spark.read, path, schemas.OCR_DOCUMENT, multi_line)
    docs = docs.withColumns({"height": F.coalesce("image_metadata.height", "image_height"), "width": F.coalesce("image_metadata.width", "image_width")})
    error = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.col("height").isNull() | F.col("width").isNull(), "size missing")
    lines = docs.filter(error.isNull()).select("bank", "file", "height", "width", F.posexplode(F.coalesce("lines", "raw_ocr_results")).alias("line_idx", "l"))
    placed = lines.withColumn("at", line_position(F.col("l"), F.col("width"), F.col("height"))).filter("at is not null")
    out = placed.select("bank", "file", "height", "width", "line_idx", F.col("l.text").alias("text"), F.coalesce("l.confidence", F.lit(0.5)).alias("confidence"), F.col("l.lang").alias("lang"), F.col("at.x").alias("px"), F.col("at.y").alias("py"))
    return out, docs.withColumn("error", error).filter("error is not null").select("bank", "file", "error")


def scan_field_csv(spark: SparkSession, path: str) -> DataFrame:
    """Field-level results; rows without a file are skipped, numbers and flags are read tolerantly."""
    rows = spark.read.schema(schemas.FIELD_CSV).option("header", True).csv(path).filter(F.coalesce("file", F.lit("")) != "")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    flag = lambda c: (F.lower(F.trim(F.coalesce(c, F.lit("false")))) == "true").alias(c)
    return rows.select("file", "bank", "field", number("loc_conf"), number("ocr_conf"), number("field_conf"), "ocr_text", "parse_norm", flag("parse_ok"), flag("meets_threshold"))


def scan_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORRECTION_CSV).option("header", True).csv(path)


def scan_templates(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(field rules, anchor rules) of the templates below a folder; positions keep their order. Unreadable ones are skipped."""
    docs = _json(spark.read, path, schemas.TEMPLATE, multi_line).filter("_corrupt is null")
    fields = docs.select("bank_id", "template_id", F.posexplode("fields").alias("pos", "f")).select("bank_id", "template_id", "pos", "f.*")
    anchors = docs.select("bank_id", "template_id", F.posexplode("anchors").alias("pos", "a")).select("bank_id", "template_id", "pos", "a.*")
    return fields, anchors


def scan_located(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """bank, file, name and box of located fields; unreadable results are skipped."""
    docs = _json(spark.read, path, schemas.LOCATED, multi_line).filter("_corrupt is null")
    return docs.select("bank", "file", F.explode("results").alias("name", "r")).select("bank", "file", "name", "r.*")


def scan_spans(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """file, meta and the spans of profiles in order; unreadable profiles are skipped."""
    docs = _json(spark.read, path, schemas.PROFILE, multi_line).filter("_corrupt is null")
    return docs.select(F.col("_metadata.file_name").alias("file"), "meta", F.posexplode("spans").alias("idx", "s")).select("file", "meta", "idx", "s.*")
