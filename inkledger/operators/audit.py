"""Audit documents: field maps, approval and schema predicates, exports, and the folding of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.functions.text import best_value

EXPORT_FIELDS = ["date", "cheque_number", "amount_numeric"]


def field_map(fields: DataFrame, key: str = "cheque_id") -> DataFrame:
    """key, fields: a map from field name to its record. fields: one row per (key, name)."""
    columns = [c for c in fields.columns if c not in (key, "name")]
    return fields.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*columns))))).alias("fields"))


def documents(cheques: DataFrame, fields: DataFrame) -> DataFrame:
    """Nested documents with a decision and a field map (empty where there are no fields)."""
    records = fields.select("cheque_id", "name", "ocr_text", "parse_norm", "field_conf", "parse_ok", F.struct(F.col("valid").alias("ok"), F.lit(None).cast("string").alias("code")).alias("validation"))
    decision = F.struct("decision", "stp").alias("decision")
    joined = cheques.join(field_map(records), "cheque_id", "left")
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<ocr_text:string,parse_norm:string,field_conf:double,parse_ok:boolean,validation:struct<ok:boolean,code:string>>>>"))
    return joined.select("cheque_id", F.col("bank_code").alias("bank"), F.col("file_id").alias("file"), "created_at", decision, F.coalesce("fields", empty).alias("fields"))


def field_rows(docs: DataFrame) -> DataFrame:
    return docs.select("cheque_id", F.explode("fields").alias("name", "rec")).select("cheque_id", "name", "rec.*")


def best_of(field: str) -> Column:
    rec = F.col("fields")[field]
    return best_value(rec["parse_norm"], rec["ocr_text"])


def approved() -> Column:
    return (F.lower(F.col("decision.decision")) == "auto_approve") | F.coalesce(F.col("decision.stp"), F.lit(False))


def validated(required: list[str] = EXPORT_FIELDS) -> Column:
    return F.forall(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.col("fields")[k]["validation"]["ok"], F.lit(False)))


def schema_errors(required: list[str] = EXPORT_FIELDS) -> Column:
    """Names of what is missing, in order."""
    own = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing:{c}")) for c in ("bank", "file")]
    return F.array_compact(F.array(*own, *(F.when(best_of(f).isNull(), F.lit(f"missing:{f}")) for f in required)))


def wide(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per document with the exported fields as columns."""
    return docs.select("cheque_id", "bank", "file", *(best_of(f).alias(f) for f in EXPORT_FIELDS), *more)


def approved_export(docs: DataFrame) -> DataFrame:
    good = docs.filter(approved() & validated() & (F.size(schema_errors()) == 0))
    conf = F.least(*(F.col("fields")[f]["field_conf"] for f in EXPORT_FIELDS))
    return wide(good, F.coalesce(F.col("decision.stp"), F.lit(False)).alias("stp"), F.round(conf, 6).alias("overall_conf"))


# ---------------------------------------------------------------- corrections


def correction_chain(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Every correction with what it replaced: the previous one's value, for the first the parsed value.
    fields: cheque_id, name, parse_norm (one row per field)."""
    order = Window.partitionBy("cheque_id", "field").orderBy("made_at", "correction_id")
    chained = corrections.withColumn("previous", F.lag("after").over(order)).withColumn("nth", F.row_number().over(order))
    original = fields.select("cheque_id", F.col("name").alias("field"), "parse_norm")
    joined = chained.join(original, ["cheque_id", "field"], "left")
    return joined.select("correction_id", "cheque_id", "field", F.when(F.col("nth") == 1, F.col("parse_norm")).otherwise(F.col("previous")).alias("before"), "after", "reviewer_id", "made_at")


def current_values(corrections: DataFrame) -> DataFrame:
    """The last correction of each field; an aggregate, so a field with many corrections is no hot group."""
    last = F.max_by(F.struct("after", "reviewer_id", "made_at"), F.struct("made_at", "correction_id"))
    return corrections.groupBy("cheque_id", "field").agg(last.alias("last"), F.count("*").alias("n")).select("cheque_id", "field", "last.after", "last.reviewer_id", "last.made_at", "n")


def values_between(cheques: DataFrame, fields: DataFrame, corrections: DataFrame, first: str, last: str) -> DataFrame:
    """Current value and number of corrections of each field of the batches between two days, both included. cheques also has the
    day's month as a number, so that a table stored by month is pruned. Everything meets on the cheque, corrections as a
    map of its fields: tables stored in buckets by cheque need no exchange. Corrections of fields a cheque lacks are left out."""
    number = lambda day: F.year(F.lit(day).cast("date")) * 100 + F.month(F.lit(day).cast("date"))
    asked = cheques.filter(F.col("month").between(number(first), number(last)) & F.col("batch_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    newest = F.struct(F.max_by("after", F.struct("made_at", "correction_id")).alias("after"), F.count("*").alias("n")).alias("now")
    named = corrections.filter("field is not null").groupBy("cheque_id", "field").agg(newest)
    known = named.groupBy("cheque_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "now"))).alias("known"))
    own = asked.select("cheque_id", "bank_code", "batch_date").join(fields.select("cheque_id", "name", "parse_norm"), "cheque_id")
    now = F.col("known")[F.col("name")]
    value, n = F.coalesce(now["after"], "parse_norm"), F.coalesce(now["n"], F.lit(0)).cast("long")
    return own.join(known, "cheque_id", "left").select("cheque_id", "bank_code", "batch_date", "name", value.alias("value"), n.alias("n_corrections"))


def apply_corrections(fields: DataFrame, corrections: DataFrame, cheques: DataFrame, muted: str = "name") -> DataFrame:
    """The field table after corrections: values, flags and last_corrected_at; corrections without an effect (muted field,
    value equal to the one before) are skipped; missing fields are created; corrections of unknown cheques are ignored.
    fields: cheque_id, name, parse_norm, ocr_text, parse_ok, meets_threshold, corrected."""
    value = F.coalesce("parse_norm", "ocr_text")
    chain = correction_chain(corrections.filter(F.col("field") != muted), fields.select("cheque_id", "name", value.alias("parse_norm")))
    real = chain.filter(~F.col("before").eqNullSafe(F.col("after"))).join(cheques.select("cheque_id"), "cheque_id", "left_semi")
    last = current_values(real).select("cheque_id", F.col("field").alias("name"), "after", F.col("made_at").alias("last_corrected_at"))
    out = fields.join(last, ["cheque_id", "name"], "full_outer")
    hit = F.col("last_corrected_at").isNotNull()
    flag = lambda c: F.when(hit, True).otherwise(F.col(c))
    return out.select("cheque_id", "name", F.when(hit, F.col("after")).otherwise(F.col("parse_norm")).alias("parse_norm"), flag("parse_ok").alias("parse_ok"), flag("meets_threshold").alias("meets_threshold"), flag("corrected").alias("corrected"), "last_corrected_at")


def fold_corrections(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with their corrections folded in: parse_norm set to the last value, the history appended in order, and
    corrections of fields the document lacks ignored."""
    names = docs.select("cheque_id", F.map_keys("fields").alias("names"))
    known = corrections.join(names, "cheque_id").filter(F.array_contains("names", F.col("field"))).drop("names")
    original = docs.select("cheque_id", F.explode("fields").alias("name", "rec")).select("cheque_id", "name", "rec.parse_norm")
    chain = correction_chain(known, original)
    entry = F.struct("made_at", "correction_id", "field", "before", "after", "reviewer_id")
    per_doc = chain.groupBy("cheque_id").agg(F.array_sort(F.collect_list(entry)).alias("corrections"))
    newest = lambda name: F.element_at(F.filter("corrections", lambda x: x["field"] == name), -1)["after"]
    out = docs.join(per_doc, "cheque_id", "left")
    changed = F.transform_values("fields", lambda k, v: v.withField("parse_norm", F.coalesce(F.when(F.size(F.filter(F.coalesce("corrections", F.array()), lambda x: x["field"] == k)) > 0, newest(k)), v["parse_norm"])))
    return out.withColumn("fields", F.when(F.col("corrections").isNull(), F.col("fields")).otherwise(changed))
