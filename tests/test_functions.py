"""Goldens of parsers, validators, confidences and text rules."""

import difflib

import pytest
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions import parse, text, validate
from inkledger.operators import kpi


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given", "norm", "err"),
    [("31/Dec/25", "2025-12-31", None), ("Dec 31 2026", None, "NO_MATCH"), ("", None, "EMPTY"), (None, None, "EMPTY"), ("31/Feb/2026", "2026-02-31", None), ("1-0ct-24", "2024-10-01", None), ("1.0EC.24", "2024-12-01", None), ("1/Xyz/24", None, "BAD_MONTH"), ("٣١/Dec/٢٥", "2025-12-31", None), ("5/Jan/123", "0123-01-05", None)],
)
def test_parse_date(spark, given, norm, err):
    assert tuple(one(spark, parse.parse_date(F.col("t")), t=given)) == (norm, err is None, err)


@pytest.mark.parametrize(("given", "norm", "err"), [("21,116.00", "21116.00", None), ("31149.00", "0.00", None), ("1,234", "1.23", None), ("1234", "1234.00", None), ("", None, "EMPTY"), ("none", None, "NO_MATCH"), ("EGP ..", None, "BAD_NUMBER"), ("12.5", "12.00", None)])
def test_parse_amount(spark, given, norm, err):
    assert tuple(one(spark, parse.parse_amount(F.col("t")), t=given)) == (norm, err is None, err)


def test_parse_number_and_name(spark):
    assert one(spark, parse.parse_cheque_number(F.col("t")), t="No : 11637510")[0] == "11637510"
    assert one(spark, parse.parse_cheque_number(F.col("t")), t="12345")[2] == "NO_MATCH"
    assert one(spark, parse.normalize_name(F.col("t")), t="  أحمد‏   عَلي ")[0] == "احمد علي"
    assert one(spark, parse.normalize_name(F.col("t")), t="ab")[2] == "TOO_SHORT"


@pytest.mark.parametrize(("value", "code"), [("1999-01-01", "DATE_RANGE"), ("2026-01-01", "OK"), ("2026-02-31", "DATE_INVALID"), ("01/02/2026", "DATE_INVALID"), ("", "DATE_EMPTY"), (None, "DATE_EMPTY")])
def test_validate_date(spark, value, code):
    assert one(spark, validate.validate_date(F.col("t")), t=value) == code


@pytest.mark.parametrize(("value", "code"), [("0.0", "AMOUNT_NONPOS"), ("abc", "AMOUNT_RANGE"), ("0.001", "AMOUNT_RANGE"), ("5", "OK"), (None, "AMOUNT_EMPTY")])
def test_validate_amount(spark, value, code):
    assert one(spark, validate.validate_amount(F.col("t")), t=value) == code


@pytest.mark.parametrize(("value", "bank", "code"), [("123", "QNB", "CHEQUE_PATTERN"), ("1" * 19, "QNB", "CHEQUE_PATTERN"), ("1" * 12, "FABMISR", "OK"), ("12-345678", "QNB", "OK"), ("1" * 7, "OTHER", "OK"), ("1" * 17, "OTHER", "CHEQUE_PATTERN"), ("", "QNB", "CHEQUE_EMPTY")])
def test_validate_cheque(spark, value, bank, code):
    assert one(spark, validate.validate_cheque(F.col("t"), F.col("b")), t=value, b=bank) == code


def test_confidence(spark):
    conf = lambda o, l, ok, f=0.97: one(spark, F.round(validate.field_confidence(F.lit(o), F.lit(l), F.lit(ok), f), 6), t="")
    assert conf(0.9, 0.8, False, 0.5) == 0.36
    assert conf(1.0, 0.996, True) >= validate.THRESHOLD > conf(1.0, 0.990, True)
    assert conf(2.0, -1.0, True) == 0.0


def test_similarity_is_block_ratio(spark):
    for a, b in [("north star", "nort star"), ("abc", "xyz"), ("", "")]:
        assert one(spark, validate.similarity(F.col("a"), F.col("b")), a=a, b=b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_geometry(spark):
    box = spark.range(1).select(*geo.rect_to_pixels(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(2.0))).first()
    assert list(box) == [838, 338, 839, 677]
    assert list(spark.range(1).select(*geo.bbox_around(F.lit(3), F.lit(676), 0.2, 0.08)).first()) == [0, 649, 335, 677]


def test_text_rules(spark):
    assert one(spark, text.collapse_ws(F.col("t")), t=" a \t b\n") == "a b"
    assert one(spark, text.repair(F.col("t"), text.REPAIR_A), t="Datc 3/OcU/24") == "3/Oct/24"
    assert one(spark, text.digit_join(F.col("t"), (4, 4)), t="x 1234 - 5678 y") == "12345678"
    assert one(spark, text.token_isolated(F.lit("12345678"), F.col("t")), t="a 12345678 12") is True
    assert one(spark, text.token_isolated(F.lit("12345678"), F.col("t")), t="12345678 654321") is False
    assert one(spark, text.fingerprint(F.col("t")), t="A-b 1!") == "ab1"


def test_batch_names(spark):
    day = F.lit("2025-09-23").cast("date")
    assert one(spark, kpi.batch_name(day, F.lit("QNB"), F.lit(3)), t="") == "23_09_2025_QNB_03"
    assert one(spark, kpi.seq_from_name(F.col("t"), F.lit("BANQUE_MISR"), day), t="23_09_2025_BANQUE_MISR_12") == 12
    assert one(spark, kpi.seq_from_name(F.col("t"), F.lit("QNB"), day), t="23_09_2025_CIB_12") is None
    assert str(one(spark, kpi.business_date(F.to_timestamp(F.lit("2025-09-23T22:30:00Z"))), t="")) == "2025-09-24"


def test_clean_text_meets_python_once(spark):
    """One pass, without plain ASCII texts, gives what the steps one by one give."""
    rows = spark.createDataFrame([(x,) for x in ("a \t b", "", None, "ئؤ إبـى", "é ﬁ", "١٢ x", "‎yَ", "\U0001d400")], "t string")
    folded = F.translate(text.norm_digits(text.fold_arabic(text.nfkc(F.col("t")))), text.TATWEEL, "")
    steps = text.collapse_ws(F.translate(text.strip_marks(folded), text.CONTROLS, ""))
    got = rows.select(text.clean_text(F.col("t")).alias("c"))
    assert [r.c for r in got.collect()] == [r.c for r in rows.select(steps.alias("c")).collect()]
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
