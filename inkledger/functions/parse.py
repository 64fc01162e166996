"""Parsers of recognised text: each gives (norm, ok, err) as columns of a struct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.text import AMOUNT, NUMBER, clean_text, norm_digits

# The date pattern and the months with their common misreadings.
DATE = r"(?i)\b(\d{1,2})\s*[\-/.]\s*([A-Za-z0-9]{3})\s*[\-/.]\s*(\d{2,4})\b"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MISREAD = {"0CT": 10, "0EC": 12, "N0V": 11}


def result(norm: Column, err: Column) -> Column:
    return F.struct(F.when(err.isNull(), norm).alias("norm"), err.isNull().alias("ok"), err.alias("err"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def month_number(name: Column) -> Column:
    """1 to 12; a zero may stand for an O or a D."""
    known = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)), *(F.lit(x) for m, i in MISREAD.items() for x in (m, i)))
    up = F.upper(name)
    return F.coalesce(known[up], known[F.translate(up, "0", "O")], known[F.translate(up, "0", "D")])


def parse_date(text: Column) -> Column:
    """First day-month-year of the text as YYYY-MM-DD. The calendar is not consulted: 31/Feb passes."""
    s = norm_digits(text)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def read(g: Column) -> Column:
        number = g["year"].try_cast("int")
        number = F.when(number < 100, number + 2000).otherwise(number)
        err = F.when(blank(text), "EMPTY").when(g["name"] == "", "NO_MATCH").when(g["month"].isNull(), "BAD_MONTH")
        return result(F.concat_ws("-", pad(number, 4), pad(g["month"], 2), pad(g["day"].try_cast("int"), 2)), err)

    groups = F.struct(*(F.regexp_extract(s, DATE, i).alias(n) for i, n in enumerate(("day", "name", "year"), 1)))
    return once(groups, lambda g: once(F.struct(g["day"].alias("day"), g["name"].alias("name"), g["year"].alias("year"), month_number(g["name"]).alias("month")), read))


def parse_amount(text: Column) -> Column:
    """First amount of the text with two decimals. The last separator is a decimal point when two digits follow it, so
    "1,234" reads 1.23 and an ungrouped "31149.00" reads 0.00, since a token holds three digits at most before a group."""
    s = norm_digits(text)
    token = F.coalesce(F.nullif(F.regexp_extract(s, AMOUNT, 0), F.lit("")), F.regexp_replace(s, r"[^0-9.,]", ""))

    def read(t: Column) -> Column:
        whole, tail = F.translate(F.regexp_extract(t, r"^(.*)[.,](.*)$", 1), ".,", ""), F.regexp_extract(t, r"^(.*)[.,](.*)$", 2)
        digits = F.translate(t, ".,", "")
        value = F.when(whole.rlike("^[0-9]+$") & tail.rlike("^[0-9]{2}"), F.concat(whole, F.lit("."), F.substring(tail, 1, 2))).when(digits != "", F.concat(digits, F.lit(".00")))
        return once(value, lambda v: result(v.try_cast("double").try_cast("decimal(38,2)").cast("string"), F.when(blank(text), "EMPTY").when(t == "", "NO_MATCH").when(v.isNull(), "BAD_NUMBER")))

    return once(token, read)


def parse_cheque_number(text: Column) -> Column:
    """First word of six or more digits."""
    return once(F.regexp_extract(norm_digits(text), NUMBER, 0), lambda n: result(n, F.when(blank(text), "EMPTY").when(n == "", "NO_MATCH")))


def normalize_name(text: Column) -> Column:
    name = clean_text(text)
    return result(name, F.when(blank(text), "EMPTY").when(F.length(name) < 3, "TOO_SHORT"))


def parse_field(field: Column, text: Column, names: bool = False) -> Column:
    """The parser of the field; fields without one are never ok and have no error. Python sees the texts of names only."""
    none = F.struct(F.lit(None).cast("string").alias("norm"), F.lit(False).alias("ok"), F.when(blank(text), "EMPTY").alias("err"))
    out = F.when(field == "date", parse_date(text)).when(field == "amount_numeric", parse_amount(text)).when(field == "cheque_number", parse_cheque_number(text))
    return (out.when(field == "name", normalize_name(F.when(field == "name", text))) if names else out).otherwise(none)
