"""Sinks of the document domain. Every one writes with Spark's committers to a path the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.sources.fold import shard_of

EXPORT_HEADERS = ["bank", "file", "date", "cheque_number", "amount_numeric", "stp", "overall_conf"]
REVIEW_HEADERS = ["Bank", "date", "cheque number", "amount"]
BOM = "﻿"


def write_audit(docs: DataFrame, path: str, mode: str = "append", shards: int = 0, compression: str = "none") -> None:
    """One JSON document per line in one directory per bank, with ``shards`` in that many parts of it by the hash of the file's
    name, so that folding corrections opens and rewrites few; members that are NULL are written. docs: bank, file and the
    document's other members. Every reader here also reads files that are compressed."""
    rows = docs.withColumn("bank_code", F.col("bank"))
    rows = rows.withColumn("shard", shard_of(F.col("file"), shards)) if shards else rows
    rows.write.mode(mode).options(ignoreNullFields=False, compression=compression).partitionBy("bank_code", *(["shard"] if shards else [])).json(path)


def write_ocr_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One document per (bank, file) with its lines in order and their count."""
    members = [c for c in lines.columns if c not in ("bank", "file", "height", "width")]
    docs = lines.groupBy("bank", "file", "height", "width").agg(F.array_sort(F.collect_list(F.struct(*members))).alias("lines"))
    docs = docs.withColumns({"count": F.size("lines"), "image_metadata": F.struct("height", "width"), "bank_code": F.col("bank")})
    docs.drop("height", "width").write.mode(mode).partitionBy("bank_code").json(path)


def append_corrections(rows: DataFrame, path: str) -> None:
    """The correction log: a header in each part file, rows appended."""
    rows.select("bank", "file", "field", "before", "after", "reason", "reviewer_id", "at").write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def write_export(rows: DataFrame, path: str) -> None:
    rows.select(*EXPORT_HEADERS).write.mode("overwrite").option("header", True).csv(path)


def write_review(rows: DataFrame, path: str, order: Column | str) -> None:
    """The reviewers' export: one file in the order asked for, its header led by a byte order mark. One file is what the format
    is; its rows are those of one request. rows: bank, date, cheque_number, amount_numeric."""
    named = rows.orderBy(order).select(*(F.col(c).alias(h) for c, h in zip(("bank", "date", "cheque_number", "amount_numeric"), (BOM + REVIEW_HEADERS[0], *REVIEW_HEADERS[1:]), strict=True)))
    named.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, lists: tuple[str, ...] = (), places: tuple[str, ...] = ()) -> None:
    """A report: lists joined by ';', confidences with three decimals, flags in lower case."""
    out = rows
    for c in lists:
        out = out.withColumn(c, F.array_join(c, ";"))
    for c in places:
        out = out.withColumn(c, F.round(c, 3).cast("decimal(12,3)").cast("string"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_templates(refined: DataFrame, path: str, template_id: str = "auto") -> None:
    """Refined rectangles as template documents, one per bank. refined: the columns of reports.refine_template."""
    box = lambda kind: F.array(*(F.col(f"{kind}_{v}") for v in "xywh"))
    engine = F.when(F.col("name") == "name", "arabic").otherwise("latin")
    field = F.struct("name", box("roi").alias("roi_norm"), box("region").alias("region_norm"), engine.alias("ocr_engine"), F.lit(1.0).alias("confidence_weight"))
    docs = refined.groupBy(F.col("bank_code").alias("bank_id")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    docs.select("bank_id", F.lit(template_id).alias("template_id"), F.lit("0.1.0").alias("version"), "fields", F.array().cast("array<struct<name:string,region_norm:array<double>,pattern:string>>").alias("anchors")).write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """A relational table as Parquet, partitioned for pruning where asked."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
