"""Reports over lines and results: recognition summaries, template refinement, votes and span roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.geometry import normalized
from inkledger.functions.text import DATE_STRICT
from inkledger.operators.extract import best, preference


def ocr_summary(lines: DataFrame) -> DataFrame:
    """By bank: documents, lines per document (1 decimal), mean of the documents' mean confidence (3), and means by language
    as text. Lines are reduced to (document, language) once; both levels come from those sums."""
    part = lines.groupBy("bank_code", "doc_id", F.coalesce("lang", F.lit("unk")).alias("lang")).agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    per_doc = part.groupBy("bank_code", "doc_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    banks = per_doc.groupBy("bank_code").agg(F.count("*").alias("images"), F.round(F.avg("n"), 1).alias("avg_lines"), F.round(F.avg(F.col("s") / F.col("n")), 3).alias("avg_conf"))
    langs = part.groupBy("bank_code", "lang").agg(F.round(F.sum("s") / F.sum("n"), 3).alias("c")).groupBy("bank_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "c"))), lambda x: F.concat_ws("=", x["lang"], x["c"].cast("decimal(5,3)").cast("string"))), ";").alias("conf_by_lang"))
    return banks.join(langs, "bank_code")


def ocr_quality(lines: DataFrame) -> DataFrame:
    """By bank: documents in which the bank's name, a date, the currency or a company word occurs."""
    t = F.col("text")
    marks = {"bank": F.contains(F.upper(t), F.col("bank_code")), "date": t.rlike(DATE_STRICT), "egp": t.rlike(r"(?i)\bEGP\b"), "company": t.contains("شركة")}
    per_doc = lines.groupBy("bank_code", "doc_id").agg(F.count("*").alias("n"), *(F.bool_or(m).alias(k) for k, m in marks.items()))
    return per_doc.groupBy("bank_code").agg(F.count("*").alias("files"), *(F.count_if(k).alias(f"has_{k}") for k in marks), F.round(F.avg("n"), 1).alias("avg_lines"))


def refine_template(boxes: DataFrame) -> DataFrame:
    """By (bank, field): a robust rectangle of the boxes seen: medians, widened by spreads of max(0.02, 1.4826 MAD), 0.05 with
    two samples or fewer; and a region a little larger. boxes: bank_code, name, x1, y1, x2, y2 in pixels."""
    names = ("x", "y", "w", "h")
    rows = boxes.select("bank_code", "name", *(v.alias(n) for n, v in zip(names, normalized(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), strict=True)))
    middle = rows.groupBy("bank_code", "name").agg(F.count("*").alias("n"), *(F.median(v).alias(f"m{v}") for v in names))
    spread = rows.join(middle, ["bank_code", "name"]).groupBy("bank_code", "name", "n", *(f"m{v}" for v in names)).agg(*(F.median(F.abs(F.col(v) - F.col(f"m{v}"))).alias(f"d{v}") for v in names))

    def width(v: str) -> Column:
        return F.greatest(F.lit(0.02), F.when(F.col("n") > 2, 1.4826 * F.col(f"d{v}")).otherwise(0.05))

    edge = {v: F.greatest(F.lit(0.0), F.col(f"m{v}") - width(v)) for v in "xy"} | {v: F.least(F.lit(1.0), F.col(f"m{v}") + width(v)) for v in "wh"}
    region = {v: F.greatest(F.lit(0.0), edge[v] - 0.02) for v in "xy"} | {v: F.least(F.lit(1.0), edge[v] + 0.04) for v in "wh"}
    return spread.select("bank_code", "name", "n", *(F.round(edge[v], 3).alias(f"roi_{v}") for v in names), *(F.round(region[v], 3).alias(f"region_{v}") for v in names))


def roi_vote(lines: DataFrame) -> DataFrame:
    """All lines of the vote with the best mean confidence in each roi; the first vote wins ties. lines: roi, vote, ..."""
    means = lines.groupBy("roi", "vote").agg(F.round(F.avg("confidence"), 9).alias("c"))
    won = means.groupBy("roi").agg(F.max_by("vote", F.struct("c", (-F.col("vote")).alias("v"))).alias("vote"))
    return lines.join(won, ["roi", "vote"])


def span_rollup(spans: DataFrame) -> DataFrame:
    """Top-level spans with a duration, by name: count and milliseconds. spans: name, dur (seconds), parent."""
    return spans.filter("parent is null and dur > 0").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.expr("cast(dur * 1000 as bigint)")).alias("ms"))


def locator_report(located: DataFrame, errors: DataFrame) -> DataFrame:
    """The locator's evaluation with a row for every document that has none. located: file, bank, field, method, confidence,
    bbox_*, pattern_text, roi_text, match_flag; errors: file, bank, error."""
    empty = [F.lit("").alias(c) for c in ("method", "confidence", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")]
    failed = errors.select("file", "bank", F.lit("<error>").alias("field"), *empty, F.col("error").alias("pattern_text"), F.lit("").alias("roi_text"), F.lit("0").alias("match_flag"))
    shown = located.withColumns({"confidence": F.round("confidence", 3).cast("decimal(12,3)"), "match_flag": F.col("match_flag").cast("int")})
    return shown.select("file", "bank", "field", "method", *(F.col(c).cast("string").alias(c) for c in ("confidence", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")), "pattern_text", "roi_text", F.col("match_flag").cast("string").alias("match_flag")).unionByName(failed)


def field_ocr_report(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """For every document and field of its template the text read in the field's own rectangle: payees on Arabic lines, all else
    on English ones, empty where there is none. boxes: bank_code, name, rx1, ry1, rx2, ry2."""
    pages = lines.groupBy("doc_id").agg(F.first("bank_code").alias("bank_code"))
    wanted = F.when(F.col("name") == "name", "ar").otherwise("en")
    inside = F.col("px").between(F.col("rx1"), F.col("rx2")) & F.col("py").between(F.col("ry1"), F.col("ry2"))
    hits = lines.join(boxes.select("bank_code", "name", "rx1", "ry1", "rx2", "ry2"), "bank_code").filter(inside & (F.col("lang") == wanted)).withColumn("rank", preference(F.col("name"), F.col("text"), False))
    chosen = best(hits, ["doc_id", "name"], F.struct((-F.col("rank")).alias("r"), F.col("confidence").alias("c")), ["text", "confidence", "lang"])
    rows = pages.join(boxes, "bank_code").join(chosen, ["doc_id", "name"], "left")
    conf = F.round(F.coalesce("confidence", F.lit(0.0)), 3).cast("decimal(12,3)").cast("string")
    return rows.select(F.col("doc_id").cast("string").alias("file"), F.col("bank_code").alias("bank"), F.col("name").alias("field"), F.coalesce("text", F.lit("")).alias("text"), conf.alias("confidence"), F.coalesce("lang", F.lit("")).alias("lang"), *(F.col(f"r{c}").alias(f"roi_{c}") for c in ("x1", "y1", "x2", "y2")))
