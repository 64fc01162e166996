"""Validators (a code, OK when valid) and confidences as column functions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Digits of a bank's cheque numbers, currencies, banks, thresholds.
CHEQUE_PATTERNS = {"QNB": r"^\d{8,12}$", "FABMISR": r"^\d{8,12}$", "BANQUE_MISR": r"^\d{6,}$", "CIB": r"^\d{12}$", "AAIB": r"^\d{9,10}$", "NBE": r"^\d{14}$"}
CURRENCIES = ["EGP", "USD", "EUR", "AED", "SAR"]
BANKS = ["QNB", "FABMISR", "BANQUE_MISR", "CIB", "AAIB", "NBE"]
KPI_FIELDS = ["date", "cheque_number", "amount_numeric"]
REQUIRED = ["date", "amount_numeric", "cheque_number", "name"]
THRESHOLD, PARSE_FAIL, PAYEE_RATIO, FLAG_RATE = 0.995, 0.97, 0.85, 0.8


def validate_date(value: Column, first: int = 2000, last: int = 2100) -> Column:
    year = F.regexp_extract(value, r"^(\d{4})-\d{2}-\d{2}$", 1)
    number = year.try_cast("int")
    return (
        F.when(value.isNull() | (value == ""), "DATE_EMPTY").when(year == "", "DATE_INVALID").when(~number.between(first, last), "DATE_RANGE")
        .when(value.try_cast("date").isNull(), "DATE_INVALID").otherwise("OK")
    )


def validate_amount(value: Column, least: float = 0.01, most: float = 1e9) -> Column:
    number = value.try_cast("double")
    return F.when(value.isNull() | (value.cast("string") == ""), "AMOUNT_EMPTY").when(number.isNull(), "AMOUNT_RANGE").when(number <= 0, "AMOUNT_NONPOS").when(~number.between(least, most), "AMOUNT_RANGE").otherwise("OK")


def validate_cheque(value: Column, bank: Column, shortest: int = 6, longest: int = 16) -> Column:
    """The bank's own pattern, or a length for unknown banks, on the digits of the value."""
    digits = F.regexp_replace(value, r"\D", "")
    own = F.create_map(*(F.lit(x) for pair in CHEQUE_PATTERNS.items() for x in pair))[bank]
    fits = F.when(own.isNull(), F.length(digits).between(shortest, longest)).otherwise(F.rlike(digits, own))
    return F.when(value.isNull() | (value == ""), "CHEQUE_EMPTY").when(fits, "OK").otherwise("CHEQUE_PATTERN")


def validate_payee(name: Column) -> Column:
    short = F.length(F.trim(F.regexp_replace(name, r"\s+", " "))) < 3
    return F.when(name.isNull(), "PAYEE_EMPTY").when(short, "PAYEE_TOO_SHORT").otherwise("OK")


def validate_currency(code: Column) -> Column:
    return F.when(F.upper(F.trim(F.coalesce(code, F.lit("")))).isin(CURRENCIES), "OK").otherwise("CURRENCY_INVALID")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def field_confidence(ocr: Column, loc: Column, parsed: Column, factor: float = PARSE_FAIL) -> Column:
    return clip01(ocr) * clip01(loc) * F.when(parsed, 1.0).otherwise(factor)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarity by longest matching blocks; Levenshtein distance would rank differently.
similarity = F.pandas_udf(_ratio, DoubleType())
