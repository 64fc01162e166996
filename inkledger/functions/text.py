"""Text clean-up and text predicates as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digit and letter foldings, tatweel, invisible controls.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"
LETTERS, FOLDED = "إأآٱىئؤ", "اااايو"
TATWEEL = "ـ"
CONTROLS = "\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"

# Patterns by which OCR lines are told apart.
AMOUNT = r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\b"
AMOUNT_DECIMAL = r"\b\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b"
AMOUNT_PLAIN = r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"
DATE_LOOSE = r"(?i)(?<!\d)\d{1,2}\s*[/\-.]?\s*(?:0ct|0ec|[A-Za-z]{3})\s*[/\-.]?\s*\d{2,4}(?:[-.]\d{1,2})?(?!\d)"
DATE_STRICT = r"\b\d{1,2}[/-][A-Za-z0-9]{3}[/-]\d{2,4}\b"
DATE_ANCHOR = r"(?i)(?<!\d)\d{1,2}\s*[/.\-]?\s*(?:0ct|0ec|[A-Za-z]{3})\s*[/.\-]?\s*\d{2,4}\b"
DATE_UNKNOWN = r"(?i)\b\d{1,2}[/\-][A-Za-z]{3}[/\-]\d{2,4}\b"
NUMBER = r"\b\d{6,}\b"
NO_LABEL = r"\b[nN][oO0]\b"
ARABIC = "[\u0600-\u06ff]"


def norm_digits(text: Column) -> Column:
    """Arabic-Indic digits as ASCII digits."""
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def fold_arabic(text: Column) -> Column:
    return F.translate(text, LETTERS, FOLDED)


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


#: Unicode normal forms have no counterpart among the built-in functions.
strip_marks = F.pandas_udf(drop_marks, StringType())
nfkc = F.pandas_udf(compatible, StringType())


# as translate does, letters beyond the last folded one go
_FOLDS = str.maketrans(LETTERS[: len(FOLDED)] + ARABIC_DIGITS, FOLDED + ASCII_DIGITS, LETTERS[len(FOLDED) :] + TATWEEL)
_CONTROLS = str.maketrans("", "", CONTROLS)


def logical(text: pd.Series) -> pd.Series:
    return drop_marks(compatible(text).map(lambda s: None if s is None else s.translate(_FOLDS))).map(lambda s: None if s is None else s.translate(_CONTROLS))


_logical = F.pandas_udf(logical, StringType())


def clean_text(text: Column) -> Column:
    """Logical clean-up of a recognised line: normal forms, folded letters and digits, no marks or invisible controls. Python sees a text
    once, and only one that is not plain ASCII, on which all this changes nothing."""
    return collapse_ws(F.coalesce(_logical(F.when(F.octet_length(text) != F.length(text), text)), text))


def fingerprint(text: Column) -> Column:
    """Letters and digits only, the first 128, in lower case."""
    return F.lower(F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), 1, 128))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def best_value(parsed: Column, recognised: Column) -> Column:
    """The parsed value, else the recognised text; '' counts as missing."""
    return F.coalesce(F.nullif(parsed, F.lit("")), F.nullif(recognised, F.lit("")))


def repair(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


# Label and month repairs of two banks, in the order they apply.
REPAIR_A = [(r"(?i)^(?:Datc|Date|Dale)\s*", ""), (r"(?i)\b(?:Date|Dale)[-\s]*", ""), (r"(?i)\bJuV\b", "Jul"), (r"(?i)\bOcU\b", "Oct"), (r"(?i)\b0ct\b", "Oct"), (r"(?i)\b0ec\b", "Dec"), (r"(?i)\bocv\b", "Oct"), (r"(?i)\bju1\b", "Jul")]
REPAIR_B = [(r"^(?:Datc|Date)\s*", ""), (r"(?i)\blan\b", "Jan"), (r"(?i)\blul\b", "Jul"), (r"(?i)\blct\b", "Oct"), (r"(?i)\b0ct\b", "Oct"), (r"(?i)\b0ec\b", "Dec")]


def micr_like(text: Column, marks: str, min_digits: int) -> Column:
    """Looks like the machine-read strip: one of ``marks``, or at least ``min_digits`` digits."""
    return text.rlike(f"[{marks}]") | (F.length(digits_of(text)) >= min_digits)


def amount_like(text: Column) -> Column:
    grouped = text.rlike(r"\d[\d,]*\.\d{2}\b") | text.rlike(r"\b\d{1,3}(?:,\d{3})+\b")
    return text.rlike(r"(?i)\begp\b|pounds|جنيه") | (text.rlike("[.,]") & grouped)


def token_isolated(token: Column, text: Column) -> Column:
    """What is left of the line without the token holds no group of 6 digits and at most 6 digits in all."""
    at = F.instr(text, token)  # digits on both sides of the removed token join up
    rest = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(token)))).otherwise(text)
    return ~rest.rlike(r"\d{6,}") & (F.length(digits_of(rest)) <= 6)


def digit_join(text: Column, sizes: tuple[int, ...]) -> Column:
    """Groups of digits of the given sizes with one to three other characters between them, joined; else NULL."""
    pattern = r"(?<!\d)" + r"\D{1,3}".join(rf"(\d{{{n}}})" for n in sizes) + r"(?!\d)"
    return F.nullif(F.concat(*(F.regexp_extract(text, pattern, i + 1) for i in range(len(sizes)))), F.lit(""))


def amount_noise(text: Column) -> Column:
    return text.rlike(r"(?i)(CAIN|EGP|CASH)") | text.rlike(r"\d+\s+[A-Z]+\s+[A-Z]+\s+\d+")


def digit_ratio(text: Column) -> Column:
    return F.length(digits_of(text)) / F.greatest(F.length(text), F.lit(1))


def leading_zeros(text: Column) -> Column:
    return F.length(F.regexp_extract(text, "^0*", 0))


def has_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def payee_noisy(text: Column) -> Column:
    return (F.length(F.trim(text)) < 3) | text.rlike("[A-Za-z]") | (digit_ratio(text) > 0.2)


def payee_clean(text: Column) -> Column:
    """A payee without the words around it (fixed values: name, account label, branch)."""
    return collapse_ws(repair(text, [(r"(?i)\bname\b", ""), (r"بحاسلا\s*مس", ""), (r"فرع\s*\S+", "")]))


def file_ext(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*(F.when(low.endswith(x), F.lit(x)) for x in (".jpg", ".jpeg", ".png", ".tif", ".tiff")), F.lit(".jpg"))


def sanitize_key(key: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.coalesce(key, F.lit("")), r"[^\p{L}\p{N}_-]", ""), 1, 128)
    return F.when(clean == "", F.lit("anon")).otherwise(clean)
