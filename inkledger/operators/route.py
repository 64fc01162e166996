"""Routing of a document from the confidences and validations of its required fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.parse import parse_field
from inkledger.functions.validate import REQUIRED, THRESHOLD, validate_amount, validate_cheque, validate_date, validate_payee


def three_places(conf: Column) -> Column:
    """A confidence as text with three decimals."""
    mille = F.round(F.round(conf, 6) * 1000).cast("int")
    return F.concat((mille / 1000).cast("int").cast("string"), F.lit("."), F.lpad((mille % 1000).cast("string"), 3, "0"))


def route(keys: DataFrame, fields: DataFrame, required: list[str] = REQUIRED, threshold: float = THRESHOLD, key: str = "cheque_id") -> DataFrame:
    """One row per key: decision, stp, overall_conf, low_conf_fields and reasons joined by ';'. fields: key, name, conf and
    code (NULL: not validated, OK: valid). A missing field has confidence 0. One aggregate turns a key's fields into columns,
    so nothing is multiplied out by the list of required fields."""
    per = fields.filter(F.col("name").isin(required)).groupBy(key).agg(
        *(F.max(F.when(F.col("name") == f, F.struct("conf", "code"))).alias(f) for f in required)
    )
    return judged(keys.select(key).join(per, key, "left"), required, threshold, key)


def judged(rows: DataFrame, required: list[str] = REQUIRED, threshold: float = THRESHOLD, key: str = "cheque_id") -> DataFrame:
    """The routes of rows with a struct (conf, code) for each required field, NULL where it is missing."""
    conf = {f: F.coalesce(F.col(f)["conf"], F.lit(0.0)) for f in required}
    low = {f: conf[f] < threshold for f in required}
    failed = {f: F.coalesce(F.col(f)["code"] != "OK", F.lit(False)) for f in required}
    reasons: list[Column] = []
    for f in required:
        reasons += [
            F.when(low[f], F.concat(F.lit(f"low_confidence:{f}:"), three_places(conf[f]), F.lit(f"<thr{threshold:.3f}"))),
            F.when(failed[f], F.concat(F.lit(f"validation_failed:{f}:"), F.col(f)["code"])),
        ]
    bad = F.lit(False)
    for f in required:
        bad = bad | low[f] | failed[f]
    return rows.select(
        key, F.when(bad, "review").otherwise("auto_approve").alias("decision"), (~bad).alias("stp"), F.round(F.least(*conf.values()), 6).alias("overall_conf"),
        F.concat_ws(";", *(F.when(low[f], F.lit(f)) for f in required)).alias("low_conf_fields"), F.concat_ws(";", *reasons).alias("reasons"),
    )


def threshold_code(conf: Column) -> Column:
    """The live rule: a field is valid when it meets the threshold; there is no finer code."""
    return F.when(F.round(conf, 6) >= THRESHOLD, "OK").otherwise("VALIDATION_FAIL")


def validator_code(name: Column, norm: Column, text: Column, bank: Column) -> Column:
    """The offline rule: real validators, on parsed values where there is one; the payee needs presence and length only."""
    given = F.coalesce(norm, F.lit("")) != ""
    return (
        F.when((name == "date") & given, validate_date(norm)).when((name == "amount_numeric") & given, validate_amount(norm))
        .when((name == "cheque_number") & given, validate_cheque(norm, bank)).when(name == "name", validate_payee(F.coalesce(F.nullif(norm, F.lit("")), text, F.lit(""))))
    )


def route_summary(cheques: DataFrame, fields: DataFrame) -> DataFrame:
    """Routing with the validators attached. fields: cheque_id, name, ocr_text, conf."""
    known = fields.join(cheques.select("cheque_id", "bank_code"), "cheque_id")
    parsed = known.withColumn("norm", parse_field(F.col("name"), F.col("ocr_text"))["norm"])
    coded = parsed.select("cheque_id", "name", "conf", validator_code(F.col("name"), F.col("norm"), F.col("ocr_text"), F.col("bank_code")).alias("code"))
    return route(cheques, coded)
