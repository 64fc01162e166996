"""The domain's tables as views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
MONTH_NAMES = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
_DATE = f"concat(lpad(CAST(day(l_shipdate) AS STRING),2,'0'),'/',substr({MONTH_NAMES},CAST(month(l_shipdate) AS INT)*3-2,3),'/',CAST(year(l_shipdate) AS STRING))"
_AMOUNT = "concat(CAST(CAST(floor(l_extendedprice/1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING),3,'0'), '.', lpad(CAST(CAST(round(l_extendedprice*100) AS BIGINT) % 100 AS STRING),2,'0'))"
BANK_OF = "CASE {0} % 6 WHEN 0 THEN 'QNB' WHEN 1 THEN 'FABMISR' WHEN 2 THEN 'BANQUE_MISR' WHEN 3 THEN 'CIB' WHEN 4 THEN 'AAIB' ELSE 'NBE' END"

VIEWS = {
    "v_cheque": f"""
SELECT o_orderkey AS cheque_id, {BANK_OF.format("o_orderkey")} AS bank_code,
 concat('f', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.jpg') AS file_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date,
 o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'auto_approve' ELSE 'review' END AS decision, o_orderstatus = 'F' AS stp
FROM orders""",
    "v_field": f"""
SELECT l_orderkey AS cheque_id, l_linenumber AS line_no,
 CASE l_linenumber WHEN 1 THEN 'date' WHEN 2 THEN 'cheque_number' WHEN 3 THEN 'amount_numeric' WHEN 4 THEN 'name' WHEN 5 THEN 'bank_name' ELSE 'other' END AS name,
 CASE l_linenumber WHEN 1 THEN {_DATE} WHEN 2 THEN concat('No : ', lpad(CAST(l_partkey*7919+l_suppkey AS STRING), 9, '0')) WHEN 3 THEN {_AMOUNT}
  ELSE concat('P', CAST(l_partkey AS STRING)) END AS ocr_text,
 CAST(1.0 - l_discount/10 AS DOUBLE) AS ocr_conf, CAST(1.0 - l_tax/10 AS DOUBLE) AS loc_conf, l_linestatus = 'F' AS parse_ok, l_returnflag = 'R' AS corrected
FROM lineitem""",
    # one record for each field of a cheque, as field maps need
    "v_one": """
SELECT cheque_id, name, ocr_text, ocr_conf, loc_conf, parse_ok, corrected FROM (
 SELECT *, row_number() OVER (PARTITION BY cheque_id, name ORDER BY ocr_conf DESC, loc_conf DESC, ocr_text, parse_ok, corrected) AS nth FROM v_field) x
WHERE nth = 1""",
    "v_full": """
SELECT cheque_id, name, ocr_text, CASE WHEN parse_ok THEN upper(ocr_text) WHEN cheque_id % 3 = 0 THEN '' END AS parse_norm,
 ocr_conf, loc_conf, ocr_conf * loc_conf * CASE WHEN parse_ok THEN 1.0 ELSE 0.97 END AS field_conf, parse_ok, corrected, ocr_conf * loc_conf >= 0.985 AS valid
FROM v_one""",
    "v_token": f"""
SELECT l_orderkey AS doc_id, {BANK_OF.format("l_orderkey")} AS bank_code,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS line_idx,
 CASE l_linenumber % 4 WHEN 1 THEN {_DATE}
  WHEN 2 THEN lpad(CAST(l_partkey*7919+l_suppkey AS STRING), CASE l_orderkey % 6 WHEN 0 THEN 10 WHEN 3 THEN 12 WHEN 4 THEN 9 WHEN 5 THEN 14 ELSE 8 END, '0')
  WHEN 3 THEN {_AMOUNT} ELSE CASE l_suppkey % 4 WHEN 0 THEN 'CHEQUE' WHEN 1 THEN 'Date' WHEN 2 THEN 'EGP' ELSE 'Pay to' END END AS text,
 CAST((l_partkey*37) % 1677 AS INT) AS px, CAST((l_suppkey*53 + l_linenumber*29) % 677 AS INT) AS py, CAST(1.0 - l_discount AS DOUBLE) AS confidence,
 CASE WHEN l_linenumber % 2 = 0 THEN 'ar' ELSE 'en' END AS lang
FROM lineitem""",
    # whole pages: numbers as each bank prints them, labels and payees in two languages, misread months
    "v_scan": """
SELECT doc_id, bank_code, line_idx, px, py, confidence, text, CASE WHEN text LIKE 'ش%' OR text LIKE 'ا%' OR text LIKE 'ف%' THEN 'ar' ELSE 'en' END AS lang FROM (
 SELECT doc_id, bank_code, line_idx, px, py, confidence,
  CASE WHEN text = 'CHEQUE' THEN CASE doc_id % 3 WHEN 0 THEN 'Cheque No.' ELSE 'CHEQUE' END
   WHEN text = 'EGP' THEN CASE (doc_id + line_idx) % 3 WHEN 0 THEN 'شيك' ELSE 'EGP' END
   WHEN text = 'Pay to' THEN CASE (doc_id + line_idx) % 5 WHEN 0 THEN 'اسم الحساب' WHEN 1 THEN 'فرع القاهرة' WHEN 2 THEN 'Pay to' ELSE concat('شركة النيل ', substr('ابتثجحخدذر', CAST(line_idx % 8 AS INT) + 1, 3)) END
   WHEN translate(text, '0123456789', '') = '' THEN CASE
    WHEN bank_code = 'FABMISR' AND doc_id % 3 = 0 THEN concat('44139', substr(text, 6, 3))
    WHEN bank_code = 'AAIB' AND line_idx % 3 = 0 THEN concat('944', substr(text, 4)) WHEN bank_code = 'AAIB' AND doc_id % 7 = 0 THEN '909006500'
    WHEN bank_code IN ('NBE', 'CIB') AND (doc_id + line_idx) % 3 = 0 THEN concat(substr(text, 1, CAST(length(text) / 2 AS INT)), ' - ', substr(text, CAST(length(text) / 2 AS INT) + 1))
    WHEN doc_id % 11 = 0 THEN concat(text, ':') ELSE text END
   WHEN bank_code = 'NBE' THEN replace(replace(replace(text, 'Jan', 'lan'), 'Jul', 'lul'), 'Oct', '0ct')
   WHEN bank_code = 'AAIB' THEN replace(replace(replace(text, 'Jul', 'JuV'), 'Oct', 'OcU'), 'Dec', '0ec')
   WHEN bank_code = 'FABMISR' AND doc_id % 5 = 0 THEN concat(text, ' EGP') ELSE text END AS text
 FROM v_token) x""",
    # tokens with the marks of recognition: Arabic digits, misread months, other separators
    "v_noisy": """
SELECT doc_id, line_idx, bank_code, text AS clean,
 CASE doc_id % 5 WHEN 0 THEN translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩') WHEN 1 THEN replace(replace(text, 'Oct', '0ct'), '/', '-')
  WHEN 2 THEN concat('Date ', replace(replace(text, 'Dec', '0ec'), 'Jan', 'lan')) WHEN 3 THEN concat(' ', replace(text, ',', ''), '  EGP ') ELSE concat('Datc', replace(text, 'Jul', 'JuV')) END AS text
FROM v_token""",
    "v_correction": """
SELECT event_id AS correction_id, user_id AS cheque_id,
 CASE event_type WHEN 'click' THEN 'date' WHEN 'view' THEN 'cheque_number' WHEN 'purchase' THEN 'amount_numeric' WHEN 'signup' THEN 'name' ELSE 'bank_name' END AS field,
 CAST(CAST(round(value * 100) AS BIGINT) AS STRING) AS after, CAST(event_id % 7 AS STRING) AS reviewer_id, ts AS made_at
FROM events""",
    "v_session": """
SELECT CASE user_id % 5 WHEN 0 THEN 'QNB' WHEN 1 THEN 'FABMISR' WHEN 2 THEN 'CIB' WHEN 3 THEN 'AAIB' ELSE 'NBE' END AS bank,
 CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('s/', CAST(user_id AS STRING)) END AS correlation_id, ts, event_id
FROM events""",
    "v_region": """
SELECT * FROM (VALUES ('QNB','date',900,40,1600,300,'[0-9]{2}/[A-Z]'), ('FABMISR','amount_numeric',700,100,1500,420,'[0-9],[0-9]{3}'), ('CIB','cheque_number',300,10,1300,360,'[0-9]{12}'),
 ('AAIB','cheque_number',100,50,1200,500,'[0-9]{9}'), ('NBE','date',500,20,1650,400,'[A-Z][a-z]{2}')) AS t(bank_code, name, x1, y1, x2, y2, pattern)""",
    # batches of a day hold few cheques, so some are in error as a whole
    "v_daily": "SELECT cheque_id, bank_code, file_id, CAST(created_at AS DATE) AS batch_date, created_at, decision, stp FROM v_cheque",
    "v_batch": """
SELECT bank_code, batch_date, min(created_at) AS created_at, max(created_at) AS started_at, count(*) AS n,
 CAST(row_number() OVER (PARTITION BY bank_code, batch_date ORDER BY min(created_at)) AS BIGINT) AS seq
FROM v_cheque GROUP BY bank_code, batch_date""",
}


def _pixels(x: float, y: float, w: float, h: float) -> str:
    width, height = 1677, 677
    return ",".join(str(v) for v in (max(0, min(round(x * width), width - 1)), max(0, min(round(y * height), height - 1)), min(round((x + w) * width), width), min(round((y + h) * height), height)))


#: Our templates: by field its own rectangle, the region to search and the pattern; by anchor the region and the pattern.
TEMPLATE_FIELDS = [
    ("bank_name", (0.0, 0.0, 0.20, 0.10), (0.0, 0.0, 0.30, 0.20), None),
    ("date", (0.65, 0.05, 0.30, 0.12), (0.40, 0.0, 0.55, 0.50), "(?i)[0-9]{2}/[A-Z]{3}/[0-9]{4}"),
    ("cheque_number", (0.35, 0.05, 0.30, 0.10), (0.10, 0.0, 0.80, 0.55), "(?i)[0-9]{8,}"),
    ("amount_numeric", (0.70, 0.30, 0.28, 0.12), (0.50, 0.20, 0.50, 0.60), "(?i)[0-9],[0-9]{3}[.][0-9]{2}"),
    ("name", (0.10, 0.30, 0.60, 0.12), (0.05, 0.20, 0.80, 0.40), None),
]
TEMPLATE_ANCHORS = [
    ("cheque_label", (0.0, 0.0, 1.0, 0.60), "(?i)cheque"), ("cheque_label", (0.0, 0.0, 0.50, 0.50), "(?i)^cheque$"), ("date_label", (0.0, 0.0, 1.0, 0.70), "(?i)date"),
    ("egp_label", (0.0, 0.0, 1.0, 1.0), "(?i)egp"), ("pay_to_label", (0.0, 0.0, 1.0, 0.80), "(?i)pay to"),
    ("cheque_label_ar", (0.0, 0.0, 1.0, 0.70), "شيك"), ("pay_to_label_ar", (0.0, 0.0, 1.0, 0.80), "اسم الحساب"),
]
TEMPLATE_BANKS = ["QNB", "FABMISR", "BANQUE_MISR", "CIB", "NBE"]
_null = lambda p: "NULL" if p is None else f"'{p}'"
VIEWS["v_tfield"] = "SELECT * FROM (VALUES " + ", ".join(f"('{b}',{i},'{n}',{_pixels(*roi)},{_pixels(*reg)},{_null(None if b == 'NBE' and n in ('date', 'amount_numeric') else p)})" for b in TEMPLATE_BANKS for i, (n, roi, reg, p) in enumerate(TEMPLATE_FIELDS)) + ") AS t(bank_code, pos, name, rx1, ry1, rx2, ry2, x1, y1, x2, y2, pattern)"
VIEWS["v_anchor"] = "SELECT * FROM (VALUES " + ", ".join(f"('{b}',{i},'{n}',{_pixels(*reg)},'{p}')" for b in TEMPLATE_BANKS for i, (n, reg, p) in enumerate(TEMPLATE_ANCHORS)) + ") AS t(bank_code, pos, name, x1, y1, x2, y2, pattern)"
NEEDS = {k: sorted(set(re.findall(r"\bv_\w+", v)) - {k}) for k, v in VIEWS.items()}


def with_needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*with_needs(NEEDS[n]), n] if x not in out]
    return out


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it names put in front."""
    used = with_needs(sorted(set(re.findall(r"\bv_\w+", sql)) & set(VIEWS)))
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in used]
    if not parts:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(parts)}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a lazy DataFrame; nothing is registered in the catalog."""
    sql = VIEWS[name]
    frames: dict[str, DataFrame] = {}
    for ref in [*NEEDS[name], *BASE_TABLES]:
        if re.search(rf"\bFROM {ref}\b", sql):
            frames[ref] = view(spark, sf_dir, ref) if ref in VIEWS else table(spark, sf_dir, ref)
            sql = re.sub(rf"\bFROM {ref}\b", f"FROM {{{ref}}}", sql)
    if not frames:
        return spark.sql(sql)
    sql = re.sub(r"\{(\d[^}]*|\d+)\}", r"{{\1}}", sql)
    return spark.sql(sql, **frames)


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by key, with the SQL that checks them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, query: Query, sql: str | None = None) -> None:
        assert key not in self.queries, key
        self.queries[key] = query
        if sql:
            self.sql[key] = oracle(sql)

    def query(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.add(key, f, sql)
            return f

        return keep
