"""Queries of the scalar functions: each applies one function to every row of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions import parse as prs
from inkledger.functions import text as txt
from inkledger.functions import validate as val
from inkledger.plans.domain import Registry, view

REG = Registry()
AR, AS = txt.ARABIC_DIGITS, txt.ASCII_DIGITS
TOKEN_IDS = ("doc_id", "line_idx")


def scalar(key: str, source: str, columns: Callable[[], dict[str, Column]], sql: str | None, ids: tuple[str, ...] = TOKEN_IDS) -> None:
    """``sql`` is the select list of the same columns."""
    REG.add(key, lambda spark, d: view(spark, d, source).select(*ids, *(c.alias(n) for n, c in columns().items())), f"SELECT {', '.join(ids)}, {sql} FROM {source}" if sql else None)


def struct_of(s: Column) -> dict[str, Column]:
    return {"norm": s["norm"], "ok": s["ok"], "err": s["err"]}


c = F.col
S = f"translate(text,'{AR}','{AS}')"

scalar("norm_digits", "v_noisy", lambda: {"out": txt.norm_digits(c("text"))}, f"{S} AS out")
scalar("fold_arabic", "v_noisy", lambda: {"out": txt.fold_arabic(F.translate("text", "aeiouln", txt.LETTERS))}, f"translate(translate(text,'aeiouln','{txt.LETTERS}'),'{txt.LETTERS}','{txt.FOLDED}') AS out")
scalar("collapse_ws", "v_noisy", lambda: {"out": txt.collapse_ws(c("text"))}, r"trim(regexp_replace(text,'\s+',' ','g')) AS out")
scalar("strip_marks", "v_noisy", lambda: {"out": txt.strip_marks(F.translate("text", "aeo", "àéö"))}, "strip_accents(translate(text,'aeo','àéö')) AS out")
#: On lines without marks or compatibility forms, as these are, the clean-up is folding, digits and blanks.
_CLEAN = rf"trim(regexp_replace(translate(translate(text, '{txt.LETTERS}', '{txt.FOLDED}'), '{AR}', '{AS}'), '\s+', ' ', 'g'))"
scalar("clean_text", "v_noisy", lambda: {"out": txt.clean_text(c("text"))}, f"{_CLEAN} AS out")

_RX = r"(?i)\b(\d{1,2})\s*[\-/.]\s*([A-Za-z0-9]{3})\s*[\-/.]\s*(\d{2,4})\b"
_MONTHS = "[" + ",".join(f"'{m}'" for m in prs.MONTHS) + "]"
_M = lambda x: f"nullif(list_position({_MONTHS}, {x}), 0)"
_MONTH = f"coalesce({_M('m')}, CASE m WHEN '0CT' THEN 10 WHEN '0EC' THEN 12 WHEN 'N0V' THEN 11 END, {_M("replace(m, '0', 'O')")}, {_M("replace(m, '0', 'D')")})"
DATE_SQL = f"""SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'EMPTY' WHEN m = '' THEN 'NO_MATCH' WHEN mon IS NULL THEN 'BAD_MONTH' END AS err,
 concat(lpad(CAST(CASE WHEN y < 100 THEN y + 2000 ELSE y END AS VARCHAR), 4, '0'), '-', lpad(CAST(mon AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0')) AS n
 FROM (SELECT *, {_MONTH} AS mon FROM (SELECT *, TRY_CAST(regexp_extract({S}, '{_RX}', 1) AS INT) AS d, upper(regexp_extract({S}, '{_RX}', 2)) AS m, TRY_CAST(regexp_extract({S}, '{_RX}', 3) AS INT) AS y FROM @src))"""
_TOK = rf"coalesce(nullif(regexp_extract({S}, '\b\d{{1,3}}(?:[.,]\d{{3}})*(?:[.,]\d{{2}})?\b', 0), ''), regexp_replace({S}, '[^0-9.,]', '', 'g'))"
AMOUNT_SQL = rf"""SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'EMPTY' WHEN t = '' THEN 'NO_MATCH' WHEN v IS NULL THEN 'BAD_NUMBER' END AS err, CAST(CAST(CAST(v AS DOUBLE) AS DECIMAL(38,2)) AS VARCHAR) AS n
 FROM (SELECT *, CASE WHEN regexp_matches(w, '^[0-9]+$') AND regexp_matches(f, '^[0-9][0-9]') THEN concat(w, '.', substr(f, 1, 2)) WHEN regexp_replace(t, '[^0-9]', '', 'g') <> '' THEN concat(regexp_replace(t, '[^0-9]', '', 'g'), '.00') END AS v
  FROM (SELECT *, regexp_replace(regexp_extract(t, '^(.*)[.,](.*)$', 1), '[.,]', '', 'g') AS w, regexp_extract(t, '^(.*)[.,](.*)$', 2) AS f FROM (SELECT *, {_TOK} AS t FROM @src)))"""
NUMBER_SQL = rf"""SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'EMPTY' WHEN n0 = '' THEN 'NO_MATCH' END AS err, n0 AS n FROM (SELECT *, regexp_extract({S}, '\b\d{{6,}}\b', 0) AS n0 FROM @src)"""
for _key, _f, _sql in (("parse_date", prs.parse_date, DATE_SQL), ("parse_amount", prs.parse_amount, AMOUNT_SQL), ("parse_number", prs.parse_cheque_number, NUMBER_SQL)):
    REG.add(
        _key, lambda spark, d, f=_f: view(spark, d, "v_noisy").select(*TOKEN_IDS, *(x.alias(n) for n, x in struct_of(f(c("text"))).items())),
        f"SELECT doc_id, line_idx, CASE WHEN err IS NULL THEN n END AS norm, err IS NULL AS ok, err FROM ({_sql.replace('@src', 'v_noisy')})",
    )
_SHORT = f"CASE WHEN text = '' THEN 'EMPTY' WHEN length({_CLEAN}) < 3 THEN 'TOO_SHORT' END"
scalar("normalize_name", "v_noisy", lambda: struct_of(prs.normalize_name(c("text"))), f"CASE WHEN {_SHORT} IS NULL THEN {_CLEAN} END AS norm, {_SHORT} IS NULL AS ok, {_SHORT} AS err")



def parsed_sql(rows: str) -> str:
    """The rows (name, text and more) with norm and err by the parser of their field; fields without one are never parsed."""
    parts = [f"SELECT * EXCLUDE (n), CASE WHEN err IS NULL THEN n END AS norm FROM ({{0}})", "SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'EMPTY' END AS err, CAST(NULL AS VARCHAR) AS norm"]
    own = {f: q.replace("@src", f"(SELECT * FROM ({rows}) WHERE name = '{f}')") for f, q in (("date", DATE_SQL), ("amount_numeric", AMOUNT_SQL), ("cheque_number", NUMBER_SQL))}
    done = [parts[0].format(q) for q in own.values()]
    names = ", ".join(f"'{f}'" for f in own)
    return " UNION ALL BY NAME ".join([*done, f"{parts[1]} FROM ({rows}) WHERE name NOT IN ({names})"])


PARSED_SQL = parsed_sql("SELECT cheque_id, line_no, name, ocr_text AS text FROM v_field")
REG.add("parse_fields", lambda spark, d: view(spark, d, "v_field").select("cheque_id", "line_no", "name", *(x.alias(n) for n, x in struct_of(prs.parse_field(c("name"), c("ocr_text"))).items())), f"SELECT cheque_id, line_no, name, norm, err IS NULL AND name IN ('date', 'amount_numeric', 'cheque_number') AS ok, err FROM ({PARSED_SQL})")

# ---------------------------------------------------------------- validators
_DATES = "CASE doc_id % 4 WHEN 0 THEN concat(CAST(1990 + doc_id % 40 AS STRING), '-02-', lpad(CAST(1 + line_idx % 31 AS STRING), 2, '0')) WHEN 1 THEN '2026/01/01' WHEN 2 THEN '' ELSE concat('20', lpad(CAST(doc_id % 100 AS STRING), 2, '0'), '-', lpad(CAST(1 + line_idx % 13 AS STRING), 2, '0'), '-28') END"
scalar(
    "validate_date", "v_token", lambda: {"code": val.validate_date(F.expr(_DATES))},
    rf"CASE WHEN {_DATES} = '' THEN 'DATE_EMPTY' WHEN NOT regexp_full_match({_DATES}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN 'DATE_INVALID' WHEN CAST(substr({_DATES}, 1, 4) AS INT) NOT BETWEEN 2000 AND 2100 THEN 'DATE_RANGE' WHEN TRY_CAST({_DATES} AS DATE) IS NULL THEN 'DATE_INVALID' ELSE 'OK' END AS code",
)
_AMT = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '0.0' WHEN 3 THEN concat(CAST(doc_id AS STRING), '0000000.5') ELSE concat(CAST(line_idx AS STRING), '.001') END"
scalar(
    "validate_amount", "v_token", lambda: {"code": val.validate_amount(F.expr(_AMT))},
    f"CASE WHEN {_AMT} = '' THEN 'AMOUNT_EMPTY' WHEN TRY_CAST({_AMT} AS DOUBLE) IS NULL THEN 'AMOUNT_RANGE' WHEN TRY_CAST({_AMT} AS DOUBLE) <= 0 THEN 'AMOUNT_NONPOS' WHEN TRY_CAST({_AMT} AS DOUBLE) NOT BETWEEN 0.01 AND 1e9 THEN 'AMOUNT_RANGE' ELSE 'OK' END AS code",
)
_BANK = "CASE WHEN doc_id % 7 = 0 THEN 'OTHER' ELSE bank_code END"
_DIG = r"regexp_replace(text, '\D', '', 'g')"
scalar(
    "validate_cheque", "v_token", lambda: {"code": val.validate_cheque(c("text"), F.expr(_BANK))},
    rf"""CASE WHEN text IS NULL OR text = '' THEN 'CHEQUE_EMPTY' WHEN regexp_full_match({_DIG}, CASE {_BANK} WHEN 'QNB' THEN '\d{{8,12}}' WHEN 'FABMISR' THEN '\d{{8,12}}' WHEN 'BANQUE_MISR' THEN '\d{{6,}}' WHEN 'CIB' THEN '\d{{12}}' WHEN 'AAIB' THEN '\d{{9,10}}' WHEN 'NBE' THEN '\d{{14}}' ELSE '\d{{6,16}}' END) THEN 'OK' ELSE 'CHEQUE_PATTERN' END AS code""",
)
_NAME = "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN concat('  ', substr(text, 1, 2), ' ') ELSE text END"
scalar("validate_payee", "v_token", lambda: {"code": val.validate_payee(F.expr(_NAME))}, rf"CASE WHEN ({_NAME}) IS NULL THEN 'PAYEE_EMPTY' WHEN length(trim(regexp_replace({_NAME}, '\s+', ' ', 'g'))) < 3 THEN 'PAYEE_TOO_SHORT' ELSE 'OK' END AS code")
_CUR = "CASE doc_id % 4 WHEN 0 THEN ' egp ' WHEN 1 THEN 'USD' WHEN 2 THEN substr(text, 1, 3) END"
scalar("validate_currency", "v_token", lambda: {"code": val.validate_currency(F.expr(_CUR))}, f"CASE WHEN upper(trim(coalesce({_CUR}, ''))) IN ('EGP','USD','EUR','AED','SAR') THEN 'OK' ELSE 'CURRENCY_INVALID' END AS code")
_CONF = "round(greatest(0.0, least(1.0, ocr_conf)) * greatest(0.0, least(1.0, loc_conf)) * CASE WHEN parse_ok THEN 1.0 ELSE 0.97 END, 6)"
scalar("field_conf", "v_field", lambda: {"name": c("name"), "conf": F.round(val.field_confidence(c("ocr_conf"), c("loc_conf"), c("parse_ok")), 6), "passes": F.round(val.field_confidence(c("ocr_conf"), c("loc_conf"), c("parse_ok")), 6) >= val.THRESHOLD}, f"name, {_CONF} AS conf, {_CONF} >= 0.995 AS passes", ("cheque_id", "line_no"))

# ---------------------------------------------------------------- geometry
_DBL = "CAST({} AS DOUBLE)"
_xywh = [f"{_DBL.format('px')}/1500 - {_DBL.format('0.05')}", f"{_DBL.format('py')}/600 - {_DBL.format('0.05')}", f"{_DBL.format('line_idx % 10')}/9", f"{_DBL.format('doc_id % 10')}/9"]
_one = lambda x: f"greatest(0.0, least(1.0, {x}))"
_x, _y, _w, _h = map(_one, _xywh)
_even = lambda x: f"CAST(round_even({x}, 0) AS INT)"
_x1, _y1 = f"greatest(0, least({_even(f'{_x} * 1677')}, 1676))", f"greatest(0, least({_even(f'{_y} * 677')}, 676))"
scalar(
    "rect_to_pixels", "v_token", lambda: dict(zip(("x1", "y1", "x2", "y2"), geo.rect_to_pixels(*map(F.expr, _xywh)), strict=True)),
    f"{_x1} AS x1, {_y1} AS y1, greatest(0, least(greatest({_even(f'({_x} + {_w}) * 1677')}, {_x1} + 1), 1677)) AS x2, greatest(0, least(greatest({_even(f'({_y} + {_h}) * 677')}, {_y1} + 1), 677)) AS y2",
)
scalar("rect_center", "v_token", lambda: dict(zip(("cx", "cy"), geo.rect_center(c("px"), c("py"), c("px") + c("line_idx"), c("py") + 7), strict=True)), "CAST(floor((px + px + line_idx) / 2) AS BIGINT) AS cx, CAST(floor((py + py + 7) / 2) AS BIGINT) AS cy")
scalar("bbox_around", "v_token", lambda: dict(zip(("x1", "y1", "x2", "y2"), geo.bbox_around(c("px"), c("py"), 0.20, 0.08), strict=True)), "greatest(0, px - 167) AS x1, greatest(0, py - 27) AS y1, least(1677, greatest(0, px - 167) + 335) AS x2, least(677, greatest(0, py - 27) + 54) AS y2")
_PTS = "array(named_struct('x', px*1.0D, 'y', py*1.0D), named_struct('x', px + 10.0D, 'y', py + 1.0D), named_struct('x', px + 12.0D, 'y', py + 9.0D), named_struct('x', px - 2.0D, 'y', py + 8.0D))"
scalar(
    "poly_geometry", "v_token", lambda: dict(zip(("cx", "cy", "x1", "y1", "x2", "y2"), geo.polygon_box(F.expr(_PTS)), strict=True)),
    "(px + (px + 10) + (px + 12) + (px - 2)) / 4.0::DOUBLE AS cx, (py + (py + 1) + (py + 9) + (py + 8)) / 4.0::DOUBLE AS cy, (px - 2)::DOUBLE AS x1, py::DOUBLE AS y1, (px + 12)::DOUBLE AS x2, (py + 9)::DOUBLE AS y2",
)
scalar("winner_bbox", "v_token", lambda: dict(zip(("x1", "y1", "x2", "y2"), geo.padded(c("px") - 2, c("py"), c("px") + 12, c("py") + 9, 0.02, 0.02), strict=True)), "greatest(0, px - 2 - 33) AS x1, greatest(0, py - 13) AS y1, least(1676, px + 12 + 33) AS x2, least(676, py + 9 + 13) AS y2")

# ---------------------------------------------------------------- text
_A = "regexp_replace(regexp_replace(text, '(?i)^(?:Datc|Date|Dale)\\s*', ''), '(?i)\\b(?:Date|Dale)[-\\s]*', '', 'g')"
_B = "regexp_replace(text, '^(?:Datc|Date)\\s*', '')"
for _bad, _good in (("JuV", "Jul"), ("OcU", "Oct"), ("0ct", "Oct"), ("0ec", "Dec"), ("ocv", "Oct"), ("ju1", "Jul")):
    _A = f"regexp_replace({_A}, '(?i)\\b{_bad}\\b', '{_good}', 'g')"
for _bad, _good in (("lan", "Jan"), ("lul", "Jul"), ("lct", "Oct"), ("0ct", "Oct"), ("0ec", "Dec")):
    _B = f"regexp_replace({_B}, '(?i)\\b{_bad}\\b', '{_good}', 'g')"
scalar("repair_date_a", "v_noisy", lambda: {"out": txt.repair(c("text"), txt.REPAIR_A)}, f"{_A} AS out")
scalar("repair_date_b", "v_noisy", lambda: {"out": txt.repair(c("text"), txt.REPAIR_B)}, f"{_B} AS out")
_DIGN = r"length(regexp_replace(text, '[^0-9]', '', 'g'))"
scalar("micr_like", "v_noisy", lambda: {"strict": txt.micr_like(c("text"), ':"', 12), "loose": txt.micr_like(c("text"), ":", 16)}, f"""regexp_matches(text, '[:"]') OR {_DIGN} >= 12 AS strict, contains(text, ':') OR {_DIGN} >= 16 AS loose""")
scalar("amount_like", "v_noisy", lambda: {"out": txt.amount_like(c("text"))}, r"regexp_matches(text, '(?i)\begp\b|pounds|جنيه') OR (regexp_matches(text, '[.,]') AND (regexp_matches(text, '\d[\d,]*\.\d{2}\b') OR regexp_matches(text, '\b\d{1,3}(?:,\d{3})+\b'))) AS out")
_LINE = "concat(text, ' ', CAST(doc_id % 100000 AS STRING), CASE WHEN line_idx % 3 = 0 THEN ' 1234567' ELSE '' END)"
scalar(
    "token_isolated", "v_token", lambda: {"out": txt.token_isolated(c("text"), F.expr(_LINE))},
    rf"NOT regexp_matches(substr({_LINE}, length(text) + 1), '\d{{6,}}') AND length(regexp_replace(substr({_LINE}, length(text) + 1), '[^0-9]', '', 'g')) <= 6 AS out",
)
_SPLIT = "CASE line_idx % 4 WHEN 0 THEN concat('x', substr(lpad(CAST(doc_id AS STRING), 8, '7'), 1, 4), ' - ', substr(lpad(CAST(doc_id AS STRING), 8, '7'), 5, 4)) WHEN 1 THEN concat(lpad(CAST(doc_id AS STRING), 7, '3'), '.', lpad(CAST(line_idx AS STRING), 7, '4')) WHEN 2 THEN concat('1234 5678/', lpad(CAST(doc_id AS STRING), 4, '0')) ELSE concat(lpad(CAST(doc_id AS STRING), 6, '1'), ' ', lpad(CAST(doc_id AS STRING), 6, '2')) END"


def _join_sql(sizes: tuple[int, ...]) -> str:
    rx = "(?:^|[^0-9])" + "[^0-9]{1,3}".join(f"([0-9]{{{n}}})" for n in sizes) + "(?:[^0-9]|$)"
    return "nullif(concat(" + ", ".join(f"regexp_extract({_SPLIT}, '{rx}', {i + 1})" for i in range(len(sizes))) + "), '')"


JOINS = {"j44": (4, 4), "j77": (7, 7), "j444": (4, 4, 4), "j66": (6, 6)}
scalar("digit_joins", "v_token", lambda: {k: txt.digit_join(F.expr(_SPLIT), v) for k, v in JOINS.items()}, ", ".join(f"{_join_sql(v)} AS {k}" for k, v in JOINS.items()))
_NOISE = "CASE line_idx % 3 WHEN 0 THEN concat(text, ' CAIN') WHEN 1 THEN concat('0056 AB CD ', text) ELSE text END"
scalar("amount_noise", "v_token", lambda: {"out": txt.amount_noise(F.expr(_NOISE))}, rf"regexp_matches({_NOISE}, '(?i)(CAIN|EGP|CASH)') OR regexp_matches({_NOISE}, '\d+\s+[A-Z]+\s+[A-Z]+\s+\d+') AS out")
scalar(
    "text_features", "v_noisy", lambda: {"ratio": F.round(txt.digit_ratio(c("clean")), 6), "zeros": txt.leading_zeros(c("clean")).cast("long"), "arabic": F.translate("text", AR, AS) != c("text")},
    r"round(length(regexp_replace(clean, '[^0-9]', '', 'g')) / greatest(length(clean), 1), 6) AS ratio, length(regexp_extract(clean, '^0*', 0)) AS zeros, regexp_matches(text, '[\x{0600}-\x{06FF}]') AS arabic",
)
_PAYEE = "concat(text, ' Name  فرع x', CAST(line_idx AS STRING), ' شركة ')"
scalar(
    "payee_clean", "v_token", lambda: {"out": txt.payee_clean(F.expr(_PAYEE)), "noisy": txt.payee_noisy(c("text"))},
    rf"trim(regexp_replace(regexp_replace(regexp_replace({_PAYEE}, '(?i)\bname\b', '', 'g'), 'فرع\s*[^ \t\n\r]+', '', 'g'), '\s+', ' ', 'g')) AS out, length(trim(text)) < 3 OR regexp_matches(text, '[A-Za-z]') OR length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1) > 0.2 AS noisy",
)
_FILE = "concat('scan', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.TIF' WHEN 4 THEN '.tiff' ELSE '' END)"
scalar("file_ext", "v_token", lambda: {"ext": txt.file_ext(F.expr(_FILE))}, f"CASE WHEN lower({_FILE}) LIKE '%.jpg' THEN '.jpg' WHEN lower({_FILE}) LIKE '%.jpeg' THEN '.jpeg' WHEN lower({_FILE}) LIKE '%.png' THEN '.png' WHEN lower({_FILE}) LIKE '%.tif' THEN '.tif' WHEN lower({_FILE}) LIKE '%.tiff' THEN '.tiff' ELSE '.jpg' END AS ext")
scalar("sanitize_key", "v_session", lambda: {"key": txt.sanitize_key(c("correlation_id"))}, r"coalesce(nullif(substr(regexp_replace(coalesce(correlation_id, ''), '[^\p{L}\p{N}_-]', '', 'g'), 1, 128), ''), 'anon') AS key", ("event_id",))
