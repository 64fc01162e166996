"""Queries of field extraction and its reports, over recognised lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import text as txt
from inkledger.functions.geometry import bbox_around
from inkledger.functions.validate import validate_payee
from inkledger.operators import bank_rules as rules
from inkledger.operators import extract as ex
from inkledger.operators import match, pipeline, reports
from inkledger.plans.domain import Registry, view
from inkledger.plans.scalars import parsed_sql
from inkledger.plans.tables import _route_sql
from inkledger.sources import readers, work, writers

REG = Registry()
PICK = ["doc_id", "name", "line_idx", "text"]


def tok(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_token")


def fields(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_tfield")


def pick_sql(rows: str, keys: str, order: str, keep: str) -> str:
    return f"SELECT {keys}, {keep} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS nth FROM ({rows})) WHERE nth = 1"


IN_REGION = "SELECT t.*, r.name, r.pattern FROM v_token t JOIN {0} r ON t.bank_code = r.bank_code WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2"
REG.add("lines_in_region", lambda s, d: ex.lines_in_region(tok(s, d), view(s, d, "v_region")).select("doc_id", "name", "line_idx", "text"), f"SELECT doc_id, name, line_idx, text FROM ({IN_REGION.format('v_region')})")
REG.add("roi_best_line", lambda s, d: ex.best(ex.lines_in_region(tok(s, d), fields(s, d).drop("x1", "y1", "x2", "y2").withColumnsRenamed({"rx1": "x1", "ry1": "y1", "rx2": "x2", "ry2": "y2"})), ["doc_id", "name"], F.col("confidence")).select(*PICK), pick_sql("SELECT t.*, name FROM v_token t JOIN v_tfield r ON t.bank_code = r.bank_code WHERE px BETWEEN rx1 AND rx2 AND py BETWEEN ry1 AND ry2", "doc_id, name", "confidence DESC, line_idx", "line_idx, text"))
REG.add("top_line", lambda s, d: ex.best(ex.lines_in_region(tok(s, d), view(s, d, "v_region")), ["doc_id", "name"], F.col("confidence")).select(*PICK), pick_sql(IN_REGION.format("v_region"), "doc_id, name", "confidence DESC, line_idx", "line_idx, text"))
BESIDE = "SELECT t.doc_id, t.line_idx, t.text, round(t.confidence - 0.15 * (t.px - l.px) / (0.5 * 1677), 9) AS score FROM v_token t JOIN v_token l ON t.doc_id = l.doc_id WHERE l.text = 'Date' AND regexp_matches(t.text, '[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}') AND abs(t.py - l.py) <= 0.05 * 677 AND t.px >= l.px"
REG.add("label_proximity", lambda s, d: ex.best(ex.beside_label(tok(s, d), r"(?i)\bdate\b", txt.DATE_LOOSE, 0.05, 0.15), ["doc_id"], F.round("score", 9)).select("doc_id", "line_idx", "text"), pick_sql(BESIDE, "doc_id", "score DESC, line_idx", "line_idx, text"))


def boxes(s: SparkSession, d: str) -> DataFrame:
    return tok(s, d).filter("text = 'EGP'").select("doc_id", F.col("px").alias("x1"), F.col("py").alias("y1"), (F.col("px") + 200).alias("x2"), (F.col("py") + 60).alias("y2"))


REG.add("amount_zone_anti", lambda s, d: ex.outside_boxes(tok(s, d), boxes(s, d)).select("doc_id", "line_idx"), "SELECT doc_id, line_idx FROM v_token t WHERE NOT EXISTS (SELECT 1 FROM v_token e WHERE e.text = 'EGP' AND e.doc_id = t.doc_id AND t.px BETWEEN greatest(0, e.px - 100) AND least(1676, e.px + 300) AND t.py BETWEEN greatest(0, e.py - 33) AND least(676, e.py + 93))")
REG.add("no_label_near", lambda s, d: ex.near_label(tok(s, d), r"(?i)\bcheque\b").select("doc_id", "line_idx", "near"), "SELECT doc_id, line_idx, EXISTS (SELECT 1 FROM v_token n WHERE n.text = 'CHEQUE' AND n.doc_id = t.doc_id AND abs(n.py - t.py) <= 0.05 * 677 AND t.px BETWEEN n.px - 0.10 * 1677 AND n.px + 0.40 * 1677) AS near FROM v_token t")
REG.add("union_langs", lambda s, d: tok(s, d).filter("lang = 'en'").withColumn("lang_rank", F.lit(0)).unionByName(tok(s, d).filter("lang = 'ar'").withColumn("lang_rank", F.lit(1))).select("doc_id", "line_idx", "lang", "lang_rank"), "SELECT doc_id, line_idx, lang, 0 AS lang_rank FROM v_token WHERE lang = 'en' UNION ALL SELECT doc_id, line_idx, lang, 1 AS lang_rank FROM v_token WHERE lang = 'ar'")

# ---------------------------------------------------------------- choosing a text
NAMES = ["date", "cheque_number", "amount_numeric"]
_LOOSE = r"(?i)(?:^|[^0-9])[0-9]{1,2}\s*[/\-.]?\s*(?:0ct|0ec|[A-Za-z]{3})\s*[/\-.]?\s*[0-9]{2,4}(?:[-.][0-9]{1,2})?(?:[^0-9]|$)"
_RANK_LIVE = rf"CASE name WHEN 'amount_numeric' THEN CASE WHEN regexp_matches(text, '\b\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}\b') THEN 0 WHEN regexp_matches(text, '\b\d{{1,3}}(?:[.,]\d{{3}})*(?:[.,]\d{{2}})?\b') THEN 1 ELSE 2 END WHEN 'date' THEN CASE WHEN regexp_matches(text, '{_LOOSE}') THEN 0 ELSE 1 END WHEN 'cheque_number' THEN CASE WHEN regexp_matches(text, '\b\d{{6,}}\b') THEN 0 ELSE 1 END ELSE 0 END"
_RANK_EVAL = r"CASE name WHEN 'amount_numeric' THEN CASE WHEN regexp_matches(text, '\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b') THEN 0 ELSE 1 END WHEN 'date' THEN CASE WHEN regexp_matches(text, '\b\d{1,2}[/-][A-Za-z0-9]{3}[/-]\d{2,4}\b') THEN 0 ELSE 1 END WHEN 'cheque_number' THEN CASE WHEN regexp_matches(text, '\b\d{6,}\b') THEN 0 ELSE 1 END ELSE 0 END"
_EVERY = "SELECT t.*, n.name FROM v_token t CROSS JOIN (VALUES ('date'), ('cheque_number'), ('amount_numeric')) n(name)"


def _choice(rank: str) -> str:
    return pick_sql(f"SELECT *, {rank} AS rank FROM ({_EVERY})", "doc_id, name", "rank, confidence DESC, line_idx", "line_idx, text, confidence, lang, rank")


REG.add("best_text", lambda s, d: ex.best_text(tok(s, d), NAMES, True).select(*PICK), f"SELECT doc_id, name, line_idx, text FROM ({_choice(_RANK_LIVE)})")
REG.add("best_text_eval", lambda s, d: ex.best_text(tok(s, d), NAMES, False).select(*PICK), f"SELECT doc_id, name, line_idx, text FROM ({_choice(_RANK_EVAL)})")
_FITS = "(rank = 0 OR (name = 'amount_numeric' AND rank = 1))"
REG.add("accept_best_text", lambda s, d: ex.accepted(ex.best_text(tok(s, d), NAMES, True)), f"SELECT doc_id, name, CASE WHEN {_FITS} THEN text ELSE '' END AS text, CASE WHEN {_FITS} THEN confidence ELSE 0.0 END AS confidence, CASE WHEN {_FITS} THEN lang ELSE '' END AS lang FROM ({_choice(_RANK_LIVE)})")

# ---------------------------------------------------------------- locating
_HIT = f"SELECT * FROM ({IN_REGION.replace('r.pattern', 'r.pattern, r.pos')}) WHERE regexp_matches(text, pattern)"
ANCHORS = pick_sql(_HIT.format("v_anchor"), "doc_id, name", "pos DESC, confidence DESC, line_idx", "line_idx, text, px, py")
REG.add("anchors", lambda s, d: ex.anchors(tok(s, d), view(s, d, "v_anchor")).select(*PICK), f"SELECT doc_id, name, line_idx, text FROM ({ANCHORS})")
REG.add("locate_pattern", lambda s, d: ex.locate_pattern(tok(s, d), fields(s, d)).select(*PICK), pick_sql(_HIT.format("v_tfield"), "doc_id, name", "confidence DESC, line_idx", "line_idx, text"))
POINTS = lambda s, d: ex.anchor_points(ex.anchors(tok(s, d), view(s, d, "v_anchor")))


def _right_sql(anchor: str, name: str, rx: str, wide: float, high: float) -> str:
    area = f"SELECT doc_id AS d, least(1677, CAST(round_even(least(1.0::DOUBLE, px / 1677::DOUBLE) * 1677, 0) AS INT)) AS x1, least(677, CAST(round_even(greatest(0.0::DOUBLE, (py - 0.10::DOUBLE * 677) / 677) * 677, 0) AS INT)) AS y1, CAST(round_even((px / 1677::DOUBLE + least({wide}::DOUBLE, 1.0::DOUBLE - px / 1677::DOUBLE)) * 1677, 0) AS INT) AS x2, least(677, CAST(round_even((greatest(0.0::DOUBLE, (py - 0.10::DOUBLE * 677) / 677) + {high}::DOUBLE) * 677, 0) AS INT)) AS y2 FROM ({ANCHORS}) WHERE name = '{anchor}'"
    return pick_sql(f"SELECT t.*, '{name}' AS name FROM v_token t JOIN ({area}) a ON t.doc_id = a.d WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AND regexp_matches(text, '{rx}')", "doc_id, name", "confidence DESC, line_idx", "line_idx, text")


_DATE_RIGHT = _right_sql("date_label", "date", r"(?i)(?:^|[^0-9])[0-9]{1,2}\s*[/.\-]?\s*(?:0ct|0ec|[A-Za-z]{3})\s*[/.\-]?\s*[0-9]{2,4}\b", 0.35, 0.22)
_AMOUNT_RIGHT = _right_sql("egp_label", "amount_numeric", r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", 0.40, 0.25)
REG.add("locate_date_label", lambda s, d: ex.locate_by(tok(s, d), POINTS(s, d), ex.date_way()).select(*PICK), _DATE_RIGHT)
REG.add("locate_amount_label", lambda s, d: ex.locate_by(tok(s, d), POINTS(s, d), ex.amount_way()).select(*PICK), _AMOUNT_RIGHT)
def scan(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_scan")


def scan_points(s: SparkSession, d: str) -> DataFrame:
    return ex.anchor_points(ex.anchors(scan(s, d), view(s, d, "v_anchor")))


def between_anchors_sql(en: str, ar: str, top: str, left: str, right: str, score: str, when: str, method: str, name: str) -> str:
    """Lines with the points of two anchors (ex, ey, ax, ay, NULL where missing), a region of its own for both, one or the other."""
    found = ANCHORS.replace("v_token", "v_scan")
    area = f"a AS ({found}), e AS (SELECT doc_id AS de, px AS ex, py AS ey FROM a WHERE name = '{en}'), r AS (SELECT doc_id AS da, px AS ax, py AS ay FROM a WHERE name = '{ar}'), q AS (SELECT *, de IS NOT NULL AND da IS NOT NULL AS two FROM v_scan LEFT JOIN e ON doc_id = de LEFT JOIN r ON doc_id = da WHERE de IS NOT NULL OR da IS NOT NULL), w AS (SELECT *, {top} AS top, {left} AS lo, {right} AS hi FROM q)"
    return f"WITH {area} SELECT doc_id, '{name}' AS name, line_idx, text, '{method}' AS method, py FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {score} DESC, line_idx) AS nth FROM w WHERE px BETWEEN lo AND hi AND {when}) WHERE nth = 1"


_MID = "CAST(floor((ey + ay) / 2) AS INT)"
_ARABIC, _DIGIT = "length(regexp_replace(text, '[^؀-ۿ]', '', 'g'))", "length(regexp_replace(text, '[^0-9]', '', 'g'))"
PAYEE_SQL = between_anchors_sql(
    "pay_to_label", "pay_to_label_ar", f"greatest(0, CASE WHEN two THEN {_MID} - 67 ELSE coalesce(ey, ay) - 54 END)",
    "CASE WHEN two THEN least(ex, ax) + 33 WHEN ex IS NOT NULL THEN ex + 34 ELSE 0 END", "CASE WHEN two THEN greatest(ex, ax) - 33 WHEN ex IS NOT NULL THEN 1677 ELSE ax - 34 END",
    f"confidence - 0.6 * abs(py - CASE WHEN two THEN {_MID} ELSE coalesce(ey, ay) END) / 677 + CASE WHEN {_ARABIC} > 0 THEN 0.1 ELSE 0 END + CASE WHEN contains(text, 'شركة') THEN 0.2 ELSE 0 END - CASE WHEN length(text) < 10 THEN 0.2 ELSE 0 END - CASE WHEN two THEN 0.4 * abs(px - (lo + hi) / 2) / 1677 ELSE 0 END",
    rf"py BETWEEN top AND top + CASE WHEN two THEN 148 ELSE 135 END AND confidence >= 0.6 AND NOT regexp_matches(text, '(?i)\begp\b|pay to|شيك') AND {_DIGIT} <= 0.3 * length(text) AND ({_ARABIC} >= 6 OR ({_ARABIC} = 0 AND length(text) >= 6))",
    "anchor_payee_scored", "name",
)
REG.add("locate_payee", lambda s, d: ex.locate_by(scan(s, d), scan_points(s, d), ex.payee_way()).select(*PICK, "method"), f"SELECT doc_id, name, line_idx, text, method FROM ({PAYEE_SQL})")
_LONG = r"CASE WHEN regexp_matches(text, '\d{10,}') THEN regexp_extract_all(text, '\d{10,16}') ELSE regexp_extract_all(text, '\d{6,}') END"
CHEQUE_SQL = between_anchors_sql(
    "cheque_label", "cheque_label_ar", f"CASE WHEN two THEN least(greatest(0, {_MID} - 40), 270) ELSE greatest(0, coalesce(ey, ay) - 40) END",
    "CASE WHEN two THEN least(ex, ax) + 33 WHEN ex IS NOT NULL THEN ex ELSE 0 END", "CASE WHEN two THEN greatest(ex, ax) - 33 WHEN ex IS NOT NULL THEN least(1677, ex + 754) ELSE least(ax, 804) END",
    f"round(confidence + 0.5 * greatest(0.0, {_DIGIT} / length(regexp_replace(text, '\\s+', '', 'g')) - 0.6) - 0.3 * list_min(list_transform({_LONG}, lambda g: abs(length(g) - CASE WHEN bank_code = 'NBE' THEN 14 ELSE 12 END))), 9)",
    rf"py BETWEEN top AND top + 94 AND bank_code NOT IN ('BANQUE_MISR', 'CIB', 'AAIB') AND NOT regexp_matches(text, '[A-Za-z:\"]') AND regexp_matches(text, '\d{{6,}}')",
    "anchor_cheque_band", "cheque_number",
)
REG.add("locate_cheque", lambda s, d: ex.locate_by(scan(s, d), scan_points(s, d), ex.cheque_way()).select(*PICK, "method"), f"SELECT doc_id, name, line_idx, text, method FROM ({CHEQUE_SQL}) WHERE py <= 372")
_DOCS = "SELECT DISTINCT doc_id, bank_code FROM v_token"
REG.add(
    "locate_fallback", lambda s, d: ex.locate_fallback(tok(s, d).select("doc_id", "bank_code").distinct(), fields(s, d), ex.locate_pattern(tok(s, d), fields(s, d))),
    f"SELECT doc_id, name, rx1, ry1, rx2, ry2, 0.9::DOUBLE AS confidence, 'template_roi' AS method FROM ({_DOCS}) d JOIN v_tfield f ON d.bank_code = f.bank_code WHERE NOT EXISTS (SELECT 1 FROM ({_HIT.format('v_tfield')}) h WHERE h.doc_id = d.doc_id AND h.name = f.name)",
)
_ON_SCAN = lambda sql: sql.replace("v_token", "v_scan")
_WAYS = [
    (1, "anchor_payee_scored", PAYEE_SQL), (1, "anchor_cheque_band", f"SELECT * FROM ({CHEQUE_SQL}) WHERE py <= 372"), (2, "region_regex", _ON_SCAN(pick_sql(_HIT.format("v_tfield"), "doc_id, name", "confidence DESC, line_idx", "line_idx"))),
    (3, "anchor_date_right", _ON_SCAN(_DATE_RIGHT)), (3, "anchor_egp_right", _ON_SCAN(_AMOUNT_RIGHT)),
]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, name, line_idx, {stage} AS stage, '{method}' AS method FROM ({q})" for stage, method, q in _WAYS)
_WIDE, _HIGH = "CASE method WHEN 'anchor_payee_scored' THEN 754 WHEN 'anchor_egp_right' THEN 368 ELSE 335 END", "CASE WHEN method IN ('anchor_payee_scored', 'anchor_egp_right') THEN 67 ELSE 54 END"
LOCATE_SQL = f"""WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY stage) AS nth FROM ({_FOUND})) WHERE nth = 1),
 b AS (SELECT w.doc_id, name, method, confidence, text, greatest(0, px - {_WIDE} // 2) AS x1, greatest(0, py - {_HIGH} // 2) AS y1 FROM w JOIN v_scan t ON w.doc_id = t.doc_id AND w.line_idx = t.line_idx)
SELECT doc_id, name, method, confidence, text, x1, y1, least(1677, x1 + {_WIDE}) AS x2, least(677, y1 + {_HIGH}) AS y2 FROM b
UNION ALL SELECT d.doc_id, f.name, 'template_roi' AS method, 0.9 AS confidence, NULL AS text, rx1, ry1, rx2, ry2 FROM (SELECT DISTINCT doc_id, bank_code FROM v_scan) d JOIN v_tfield f ON d.bank_code = f.bank_code WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id AND w.name = f.name)"""
REG.add("locate_fields", lambda s, d: ex.locate_fields(scan(s, d), fields(s, d), view(s, d, "v_anchor")), LOCATE_SQL)
_UNKNOWN = r"SELECT t.*, 'date' AS name FROM v_token t WHERE regexp_matches(text, '(?i)\b\d{1,2}[/\-][A-Za-z]{3}[/\-]\d{2,4}\b') UNION ALL SELECT t.*, 'amount_numeric' AS name FROM v_token t WHERE regexp_matches(text, '\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b') UNION ALL SELECT t.*, 'cheque_number' AS name FROM v_token t WHERE regexp_matches(text, '\b\d{6,}\b')"
REG.add("locate_unknown", lambda s, d: ex.locate_unknown(ex.without_template(tok(s, d), fields(s, d))), f"SELECT doc_id, name, text, confidence, 'unknown_regex' AS method FROM ({pick_sql(_UNKNOWN, 'doc_id, name, bank_code', 'confidence DESC, line_idx', 'text, confidence')}) WHERE bank_code = 'AAIB' UNION ALL SELECT DISTINCT doc_id, 'bank_name' AS name, 'UNKNOWN' AS text, 0.5::DOUBLE AS confidence, 'unknown_bank' AS method FROM v_token WHERE bank_code = 'AAIB'")


def locator_eval(s: SparkSession, d: str) -> DataFrame:
    """Located text against the best line of the field's own rectangle; equal when both fingerprints are, and not empty."""
    located = ex.locate_pattern(tok(s, d), fields(s, d)).select("doc_id", "name", F.col("text").alias("pattern_text"))
    roi = REG.queries["roi_best_line"](s, d).select("doc_id", "name", F.col("text").alias("roi_text"))
    a, b = txt.fingerprint(F.col("pattern_text")), txt.fingerprint(F.coalesce("roi_text", F.lit("")))
    return located.join(roi, ["doc_id", "name"], "left").select("doc_id", "name", "pattern_text", F.coalesce("roi_text", F.lit("")).alias("roi_text"), ((a == b) & (a != "")).alias("match_flag"))


_FP = lambda c: rf"lower(substr(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g'), 1, 128))"
LOCATOR_SQL = f"SELECT l.doc_id, l.name, l.text AS pattern_text, coalesce(r.text, '') AS roi_text, {_FP('l.text')} = {_FP('coalesce(r.text, chr(32))')} AND {_FP('l.text')} <> '' AS match_flag FROM ({pick_sql(_HIT.format('v_tfield'), 'doc_id, name', 'confidence DESC, line_idx', 'line_idx, text')}) l LEFT JOIN ({pick_sql('SELECT t.*, name FROM v_token t JOIN v_tfield r ON t.bank_code = r.bank_code WHERE px BETWEEN rx1 AND rx2 AND py BETWEEN ry1 AND ry2', 'doc_id, name', 'confidence DESC, line_idx', 'line_idx, text')}) r ON l.doc_id = r.doc_id AND l.name = r.name"
REG.add("locator_eval", locator_eval, LOCATOR_SQL)

# ---------------------------------------------------------------- rule sets
RULE = ["doc_id", "name", "source", "line_idx", "token"]


def amount_boxes(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d).filter("text = 'EGP'").select("doc_id", F.col("px").alias("x1"), F.col("py").alias("y1"), (F.col("px") + 200).alias("x2"), (F.col("py") + 60).alias("y2"))


def payee_boxes(s: SparkSession, d: str) -> DataFrame:
    banks = scan(s, d).select("doc_id", "bank_code").distinct()
    return banks.join(fields(s, d).filter("name = 'name'"), "bank_code").select("doc_id", F.col("rx1").alias("x1"), F.col("ry1").alias("y1"), F.col("rx2").alias("x2"), F.col("ry2").alias("y2"))


def page_sql(bank: str, more: str = "") -> str:
    return f"SELECT *, line_idx + CASE WHEN lang = 'en' THEN 0 ELSE 1099511627776 END AS ord, regexp_replace(text, '[^0-9]', '', 'g') AS dg{more} FROM v_scan WHERE bank_code = '{bank}'"


def run_sql(n: int) -> str:
    return f"nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{{n}}})(?:[^0-9]|$)', 1), '')"


def join_sql(n: int) -> str:
    return rf"nullif(concat(regexp_extract(text, '(?:^|[^0-9])([0-9]{{{n}}})[^0-9]{{1,3}}([0-9]{{{n}}})(?:[^0-9]|$)', 1), regexp_extract(text, '(?:^|[^0-9])([0-9]{{{n}}})[^0-9]{{1,3}}([0-9]{{{n}}})(?:[^0-9]|$)', 2)), '')"


def point_sql(when: str, a: str, b: str) -> str:
    """The most confident line of a document that is a label."""
    return f"SELECT doc_id AS d_{a}, px AS {a}, py AS {b} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) AS nth FROM p WHERE {when}) WHERE nth = 1"


def staged_sql(name: str, head: str, parts: list[tuple[str, int, str, str]], keep: str = "true") -> str:
    """Of candidates (source, group, score, FROM ...) the best of the first group that has any; earlier parts win ties."""
    found = " UNION ALL ".join(f"SELECT doc_id, '{src}' AS source, {g} AS g, {i} AS part, round({score}, 9) AS score, ord, line_idx, token FROM {rest}" for i, (src, g, score, rest) in enumerate(parts))
    return f"WITH {head}, c AS ({found}) SELECT doc_id, '{name}' AS name, source, line_idx, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, score DESC, part, ord) AS nth FROM c WHERE token IS NOT NULL AND {keep}) WHERE nth = 1"


_ZONE = "NOT EXISTS (SELECT 1 FROM v_scan e WHERE e.text = 'EGP' AND e.doc_id = p.doc_id AND p.px BETWEEN greatest(0, e.px - 100) AND least(1676, e.px + 300) AND p.py BETWEEN greatest(0, e.py - 33) AND least(676, e.py + 93))"
_LESS = "confidence - 0.10 * abs(px - {0}) / (0.5 * 1677)"
_EN_CHEQUE, _AR_CHEQUE = r"lang = 'en' AND regexp_matches(text, '(?i)\bcheque\b')", "contains(text, 'شيك')"
_LABELS = f"en AS ({point_sql(_EN_CHEQUE, 'ex', 'ey')}), ar AS ({point_sql(_AR_CHEQUE, 'ax', 'ay')})"
_POINTS = "p LEFT JOIN en ON doc_id = d_ex LEFT JOIN ar ON doc_id = d_ax"
def bm_sql(zone: str) -> str:
    return staged_sql(
        "cheque_number", f"p AS ({page_sql('BANQUE_MISR', f', {run_sql(8)} AS token')}), {_LABELS}, q AS (SELECT * FROM {_POINTS} WHERE NOT regexp_matches(text, '[:\"]') AND length(dg) < 12 AND {zone})",
        [
            ("bm_label_row", 0, _LESS.format("ex"), "q WHERE abs(py - ey) <= 0.08 * 677 AND px >= ex AND px < 0.68 * 1677"), ("bm_label_row_ar", 0, _LESS.format("ax"), "q WHERE abs(py - ay) <= 0.08 * 677 AND px <= ax AND px < 0.78 * 1677"),
            ("bm_fullband_mid", 0, "confidence", "q WHERE py BETWEEN 0.30 * 677 AND 0.55 * 677 AND px < 0.78 * 1677"), ("bm_fullband", 1, "confidence", "q WHERE py BETWEEN 0.01 * 677 AND 0.60 * 677 AND px < 0.78 * 1677"), ("bm_global_8", 2, "confidence", "q WHERE px < 0.90 * 1677"),
        ],
        "NOT (part = 1 AND EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.part = 0 AND o.token IS NOT NULL))",
    )


REG.add("rule_bm", lambda s, d: rules.number_bm(scan(s, d), amount_boxes(s, d)).select(*RULE), bm_sql(_ZONE))
_NBE = f"p AS ({page_sql('NBE', f', coalesce({run_sql(14)}, {join_sql(7)}) AS token, CASE WHEN {run_sql(14)} IS NULL THEN 0.10 ELSE 0.0 END AS less')}), l AS (SELECT doc_id AS ld, min(px) AS lx, min(py) AS ly FROM p WHERE {_EN_CHEQUE} GROUP BY doc_id), q AS (SELECT * FROM p LEFT JOIN l ON doc_id = ld WHERE lang = 'en' AND NOT contains(text, ':') AND length(dg) < 16)"
_NBE_NEAR = staged_sql("cheque_number", _NBE, [("nbe_preselect_cheque", 0, "confidence - 0.25 * abs(px - lx) / (0.5 * 1677) - 0.35 * abs(py - ly) / (0.06 * 677) - less", "q WHERE px BETWEEN lx AND least(1677, lx + 0.68 * 1677) AND NOT regexp_matches(text, '[A-Za-z]')")])
_NBE_ALL = staged_sql("cheque_number", _NBE, [("nbe_final_full_image", 0, "confidence - less", "q")])
REG.add("rule_nbe", lambda s, d: rules.number_nbe(scan(s, d)).select(*RULE), f"SELECT a.doc_id, a.name, coalesce(n.source, a.source) AS source, a.line_idx, a.token FROM ({_NBE_ALL}) a LEFT JOIN ({_NBE_NEAR}) n ON a.doc_id = n.doc_id")
_DENIED = ", ".join(f"'{x}'" for x in rules.DENIED)
REG.add(
    "rule_aaib", lambda s, d: rules.number_aaib(scan(s, d)).select(*RULE),
    staged_sql(
        "cheque_number", f"p AS ({page_sql('AAIB', f', {run_sql(9)} AS token')}), q AS (SELECT *, EXISTS (SELECT 1 FROM p n WHERE n.doc_id = p.doc_id AND n.text = 'Cheque No.' AND abs(n.py - p.py) <= 0.05 * 677 AND n.px <= p.px) AS near FROM p WHERE lang = 'en' AND trim(text) NOT IN ({_DENIED}) AND NOT contains(text, ':') AND length(dg) < 16)",
        [("aaib_fullimage", 0, "confidence + CASE WHEN py <= 0.22 * 677 THEN 0.2 ELSE 0 END + CASE WHEN px <= 0.55 * 1677 THEN 0.15 ELSE 0 END + CASE WHEN near THEN 0.2 ELSE 0 END + CASE WHEN substr(token, 1, 3) IN ('942', '943', '944', '945') THEN 0.3 ELSE 0 END", "q")],
    ),
)
_FAB = staged_sql(
        "cheque_number", f"p AS ({page_sql('FABMISR', f', {run_sql(8)} AS token')}), q AS (SELECT *, starts_with(token, '44139') AS usual FROM p WHERE lang = 'en' AND NOT contains(text, ':') AND length(dg) < 16 AND NOT regexp_matches(text, '[A-Za-z]') AND token IS NOT NULL), h AS (SELECT doc_id AS hd, min(ord) AS head FROM q GROUP BY doc_id)",
        [("fabmisr_cheque_clean", 0, "confidence", "q JOIN h ON doc_id = hd WHERE ord = head AND NOT usual"), ("fabmisr_cheque_clean", 0, "confidence + 1.0", "q WHERE usual")],
    )
REG.add("rule_fab", lambda s, d: rules.number_fab(scan(s, d)).select(*RULE), _FAB)
_SIDE = "CASE WHEN ex IS NOT NULL AND ax IS NOT NULL THEN {both} WHEN ex IS NOT NULL THEN {en} ELSE {ar} END"
_LEFT, _RIGHT = _SIDE.format(both="greatest(0.0, least(ex, ax) + 0.02 * 1677)", en="ex", ar="greatest(0.0, ax - 0.5 * 1677)"), _SIDE.format(both="least(1677.0, greatest(ex, ax) - 0.02 * 1677)", en="least(1677.0, ex + 0.5 * 1677)", ar="ax")
_ZEROS = "(length(token) - length(ltrim(token, '0')))"
_CIB_BAND = f"confidence - (0.3 * abs(px - 0.5 * (lx + rx)) / greatest(1.0, 0.5 * (rx - lx)) + 0.2 * abs(py - 0.60 * 677) / (0.25 * 677)) - 0.05 * {_ZEROS}"
_CIB = staged_sql(
    "cheque_number",
    f"p AS ({page_sql('CIB', f', coalesce({run_sql(12)}, {join_sql(6)}) AS token, {run_sql(12)} IS NOT NULL AS whole')}), {_LABELS}, b AS (SELECT *, {_LEFT} AS lx, {_RIGHT} AS rx FROM {_POINTS}), q AS (SELECT * FROM b WHERE px BETWEEN lx AND rx AND NOT regexp_matches(text, '[A-Za-z:\"]') AND token IS NOT NULL), h AS (SELECT doc_id AS hd, min(ord) AS head FROM q GROUP BY doc_id)",
    [("bm_preselect_band", 0, f"{_CIB_BAND} - 0.10", "q JOIN h ON doc_id = hd WHERE ord = head AND NOT whole"), ("bm_preselect_band", 0, _CIB_BAND, "q WHERE whole"), ("bm_final_full_image", 1, f"confidence - 0.2 * abs(py - 0.60 * 677) / (0.30 * 677) - 0.05 * {_ZEROS}", "p WHERE regexp_matches(text, '^[0-9]{12}$')")],
)
_NO = r"(regexp_matches(t.text, '\b[nN][oO0]\b') OR EXISTS (SELECT 1 FROM v_scan n WHERE n.bank_code = 'CIB' AND n.doc_id = t.doc_id AND regexp_matches(n.text, '\b[nN][oO0]\b') AND abs(n.py - t.py) <= 0.05 * 677 AND t.px BETWEEN n.px - 0.10 * 1677 AND n.px + 0.40 * 1677))"
_CIB_REST = rf"SELECT doc_id, line_idx, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN bad THEN 1 ELSE 0 END, CASE WHEN py <= 0.45 * 677 THEN 0 ELSE 1 END, abs(length(token) - 12), round(abs(px - 0.5 * 1677) / (0.5 * 1677), 9), -confidence, line_idx) AS nth FROM (SELECT *, regexp_extract(text, '\b\d{{6,}}\b', 0) AS token, {_NO} AS bad FROM v_scan t WHERE bank_code = 'CIB') WHERE token <> '') WHERE nth = 1"
CIB_SQL = f"WITH w AS ({_CIB}) SELECT doc_id, name, source, line_idx, token FROM w UNION ALL SELECT doc_id, 'cheque_number' AS name, 'fallback_candidates' AS source, line_idx, token FROM ({_CIB_REST}) r WHERE doc_id NOT IN (SELECT doc_id FROM w)"
REG.add("rule_cib", lambda s, d: rules.number_cib(scan(s, d)).select(*RULE), CIB_SQL)


def repaired_sql(text: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, put in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


_DATE_IN = r"nullif(regexp_extract({0}, '(?i)(?:^|[^0-9])([0-9]{{1,2}}\s*[/\-.]?\s*(?:0ct|0ec|[A-Za-z]{{3}})\s*[/\-.]?\s*[0-9]{{2,4}}(?:[-.][0-9]{{1,2}})?)(?:[^0-9]|$)', 1), '')"
_BESIDE = "confidence - {0} * (px - lx) / (0.5 * 1677)"
_DATES_A = staged_sql(
    "date", f"p AS ({page_sql('AAIB', ', ' + repaired_sql(_DATE_IN.format('text'), txt.REPAIR_A) + ' AS token')}), l AS (SELECT doc_id AS ld, px AS lx, py AS ly FROM p WHERE text = 'Date')",
    [("aaib_date_region", 0, "confidence", "p WHERE px >= 0.50 * 1677 AND py BETWEEN 0.04 * 677 AND 0.40 * 677"), ("aaib_date_label", 1, _BESIDE.format(0.15), "p JOIN l ON doc_id = ld WHERE abs(py - ly) <= 0.05 * 677 AND px >= lx"), ("aaib_date_global", 2, "confidence", "p")],
)
_DATES_B = staged_sql(
    "date", f"p AS ({page_sql('NBE', ', ' + repaired_sql(_DATE_IN.format(repaired_sql('text', txt.REPAIR_B)), txt.REPAIR_B) + ' AS token')}), l AS (SELECT doc_id AS ld, px AS lx, py AS ly FROM p WHERE text = 'Date')",
    [("nbe_date_label", 0, _BESIDE.format(0.12), "p JOIN l ON doc_id = ld WHERE abs(py - ly) <= 0.06 * 677 AND px >= lx"), ("nbe_date_global", 1, "confidence", "p")],
)
REG.add("rule_date", lambda s, d: rules.date_rules(scan(s, d)).select(*RULE), f"SELECT * FROM ({_DATES_A}) UNION ALL SELECT * FROM ({_DATES_B})")
_DECIMAL = r", nullif(regexp_extract(text, '\b\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b', 0), '') AS token"
_AMOUNT_NBE = staged_sql("amount_numeric", f"p AS ({page_sql('NBE', _DECIMAL)})", [("nbe_amount_dec_band", 0, "confidence + 0.2 * (px - 0.62 * 1677) / (0.38 * 1677) + 0.1 * (1.0 - abs(py - 0.40 * 677) / (0.20 * 677))", "p WHERE lang = 'en' AND px >= 0.62 * 1677 AND py BETWEEN 0.22 * 677 AND 0.60 * 677"), ("nbe_amount_dec_global", 1, "confidence", "p WHERE lang = 'en'")])
_AMOUNT_FAB = staged_sql("amount_numeric", f"p AS ({page_sql('FABMISR', _DECIMAL)})", [("fabmisr_amount_clean", 0, "confidence", "p WHERE lang = 'en' AND NOT regexp_matches(text, '(?i)CAIN|EGP|CASH')")])
REG.add("rule_amount", lambda s, d: rules.amount_rules(scan(s, d)).select(*RULE), f"SELECT * FROM ({_AMOUNT_NBE}) UNION ALL SELECT * FROM ({_AMOUNT_FAB})")


def payee_sql(bank: str, box: str, label: str, own_box: str = "SELECT rx1 AS x1, ry1 AS y1, rx2 AS x2, ry2 AS y2 FROM v_tfield WHERE bank_code = '{0}' AND name = 'name'", where: str = "true") -> str:
    fine = r"NOT regexp_matches(text, '[A-Za-z0-9]') AND NOT contains(text, 'فرع')"
    return staged_sql(
        "name", f"p AS ({page_sql(bank, ', text AS token')}), l AS (SELECT doc_id AS ld, px AS lx, py AS ly FROM p WHERE text = 'اسم الحساب'), b AS ({own_box.format(bank)})",
        [(box, 0, "confidence", f"p, b WHERE px BETWEEN x1 - 33 AND x2 + 33 AND py BETWEEN y1 - 13 AND y2 + 13 AND {fine} AND {where}"), (label, 1, _BESIDE.format("0.10"), f"p JOIN l ON doc_id = ld WHERE abs(py - ly) <= 0.06 * 677 AND px >= lx AND {fine}")],
    )


REG.add("rule_payee", lambda s, d: rules.payee_rules(scan(s, d), payee_boxes(s, d)).select(*RULE), f"SELECT * FROM ({payee_sql('NBE', 'nbe_name_roi', 'nbe_name_label')}) UNION ALL SELECT * FROM ({payee_sql('AAIB', 'aaib_name_fallback', 'aaib_name_label')})")
REG.add(
    "candidate_rank", lambda s, d: ex.cib_rank(tok(s, d)).select("doc_id", "line_idx", "token"),
    r"SELECT doc_id, line_idx, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN py <= 0.45 * 677 THEN 0 ELSE 1 END, abs(length(token) - 12), round(abs(px - 0.5 * 1677) / (0.5 * 1677), 9), -confidence, line_idx) AS nth FROM (SELECT *, regexp_extract(text, '\b\d{6,}\b', 0) AS token FROM v_token) WHERE token <> '') WHERE nth = 1",
)
_TAIL = "CASE line_idx % 4 WHEN 0 THEN concat(text, ' /', lpad(CAST(doc_id AS STRING), 12, '5')) WHEN 1 THEN concat('x', lpad(CAST(doc_id AS STRING), 11, '5'), '-', lpad(CAST(doc_id AS STRING), 13, '6')) ELSE text END"
REG.add("tail_cib", lambda s, d: tok(s, d).select("doc_id", "line_idx", ex.tail_cib(F.expr(_TAIL)).alias("token")), rf"""SELECT doc_id, line_idx, coalesce(list_filter(g, lambda x: length(x) = 12)[1], list_sort(list_transform(list_filter(g, lambda x: length(x) BETWEEN 10 AND 13), lambda x, i: {{'d': abs(length(x) - 12), 'l': -length(x), 'i': i, 'g': x}}))[1]['g'], s) AS token FROM (SELECT *, {_TAIL} AS s, regexp_extract_all(regexp_replace({_TAIL}, '\s+', '', 'g'), '\d+') AS g FROM v_token)""")


def records(s: SparkSession, d: str) -> DataFrame:
    chosen = ex.accepted(ex.best_text(tok(s, d), NAMES, True)).select("doc_id", "name", "text", F.col("confidence").alias("ocr_conf"), F.lit(1.0).alias("loc_conf"))
    return ex.field_records(chosen)


RECORDS_SQL = parsed_sql(f"SELECT doc_id, name, CASE WHEN {_FITS} THEN text ELSE '' END AS text, CASE WHEN {_FITS} THEN confidence ELSE 0.0 END AS ocr_conf FROM ({_choice(_RANK_LIVE)})")
_CONF = "round(ocr_conf * CASE WHEN err IS NULL THEN 1.0 ELSE 0.97 END, 6)"
REG.add("field_records", records, f"SELECT doc_id, name, text AS ocr_text, norm AS parse_norm, err IS NULL AS parse_ok, {_CONF} AS field_conf, {_CONF} >= 0.995 AS meets_threshold FROM ({RECORDS_SQL})")


def written(s: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows that several steps read, computed once and kept in the shared folder."""
    path = work.folder(s, name)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def scanned(s: SparkSession, d: str) -> DataFrame:
    """The pages with a polygon around every line, wider for longer texts and slightly turned."""
    half, corner = 4.5 * F.length("text"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("px"), F.col("py")
    return scan(s, d).withColumn("bbox", F.array(corner(x - half, y - 8.5), corner(x + half, y - 6.25), corner(x + half, y + 8.5), corner(x - half, y + 6.25)))


def extracted(s: SparkSession, d: str) -> DataFrame:
    return pipeline.extract_fields(scanned(s, d), fields(s, d), view(s, d, "v_anchor"))


def _extract_sql() -> str:
    """The whole way in SQL: locate, choose in the box, the bank's rules, the winner's box, tidy, parse, score. AAIB has no template
    here, so its rules have no field to change."""
    zone = "NOT EXISTS (SELECT 1 FROM loc e WHERE e.name = 'amount_numeric' AND e.doc_id = p.doc_id AND p.px BETWEEN greatest(0, e.x1 - 100) AND least(1676, e.x2 + 100) AND p.py BETWEEN greatest(0, e.y1 - 33) AND least(676, e.y2 + 33))"
    payee = payee_sql("NBE", "nbe_name_roi", "nbe_name_label", "SELECT doc_id AS bd, x1, y1, x2, y2 FROM loc WHERE name = 'name'", "p.doc_id = bd")
    line = lambda rows: f"SELECT r.doc_id, r.name, r.source, r.token, t.confidence AS rc, r.line_idx FROM ({rows}) r JOIN v_scan t ON t.doc_id = r.doc_id AND t.line_idx = r.line_idx"
    nbe = f"SELECT a.doc_id, a.name, coalesce(n.source, a.source) AS source, a.token, greatest(a.rc, n.rc) AS rc, a.line_idx FROM ({line(_NBE_ALL)}) a LEFT JOIN ({line(_NBE_NEAR)}) n ON a.doc_id = n.doc_id"
    found = " UNION ALL ".join([nbe, *(line(q) for q in (bm_sql(zone), _FAB, CIB_SQL, _DATES_B, _AMOUNT_NBE, _AMOUNT_FAB, payee))])
    rank = _RANK_LIVE.replace("CASE name", "CASE b.name").replace("(text,", "(t.text,")
    inside = f"SELECT t.doc_id, b.name, t.text, t.confidence, t.lang, t.line_idx, {rank} AS rank FROM v_scan t JOIN box b ON t.doc_id = b.doc_id WHERE t.lang = 'en' AND b.name <> 'bank_name' AND t.px BETWEEN x1 AND x2 AND t.py BETWEEN y1 AND y2"
    fits, own = "(rank = 0 OR (b.name = 'amount_numeric' AND rank = 1))", "b.name = 'bank_name'"
    decimal, short = r"regexp_matches(text, '\b\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\b')", "length(trim(text)) < 3"
    digits = "length(regexp_replace(text, '[^0-9]', '', 'g'))"
    noisy = f"({short} OR regexp_matches(text, '[A-Za-z]') OR CASE WHEN bank_code = 'NBE' THEN {digits}::DOUBLE / greatest(length(text), 1) > 0.2 ELSE {digits} > 0 END OR contains(text, 'فرع'))"
    noise = r"(regexp_matches(text, '(?i)(CAIN|EGP|CASH)') OR regexp_matches(text, '\d+\s+[A-Z]+\s+[A-Z]+\s+\d+'))"
    steps = f"""CASE name WHEN 'cheque_number' THEN bank_code <> 'FABMISR' OR contains(text, ':') OR {digits} >= 16 OR NOT regexp_matches(text, '(?:^|[^0-9])44139[0-9]{{3}}(?:[^0-9]|$)')
      WHEN 'date' THEN NOT regexp_matches(text, '{_LOOSE}') WHEN 'amount_numeric' THEN NOT {decimal} OR (bank_code = 'FABMISR' AND {noise})
      WHEN 'name' THEN CASE WHEN source LIKE '%\\_label' ESCAPE '\\' THEN {short} ELSE {noisy} END ELSE false END"""
    plain = r"regexp_replace(text, '\s+', '', 'g')"
    groups = rf"regexp_extract_all({plain}, '\d+')"
    tail = f"coalesce(list_filter({groups}, lambda x: length(x) = 12)[1], list_sort(list_transform(list_filter({groups}, lambda x: length(x) BETWEEN 10 AND 13), lambda x, i: {{'d': abs(length(x) - 12), 'l': -length(x), 'i': i, 'g': x}}))[1]['g'], text)"
    run_plain = run_sql(14).replace("(text,", f"({plain},")
    number = rf"CASE bank_code WHEN 'CIB' THEN {tail} WHEN 'NBE' THEN coalesce({run_plain}, {join_sql(7)}) WHEN 'BANQUE_MISR' THEN coalesce({run_sql(8)}, '') ELSE nullif(regexp_extract({plain}, '\b\d{{6,}}\b', 0), '') END"
    boxed = ", ".join(f"'{x}'" for x in rules.BOXED)
    moved = lambda side, new: f"CASE WHEN hit AND source IN ({boxed}) THEN {new} ELSE {side} END AS {side}"
    clear = f"bank_code = 'NBE' AND name = 'amount_numeric' AND NOT {decimal}"
    parsed = parsed_sql("SELECT * FROM tidy WHERE name IN ('date', 'amount_numeric', 'cheque_number')")
    return f"""WITH loc AS MATERIALIZED ({LOCATE_SQL}),
box AS MATERIALIZED (SELECT d.bank_code, l.doc_id, l.name, l.confidence AS loc_conf, x1, y1, CASE WHEN l.name = 'cheque_number' THEN least(1676, x2 + 201) ELSE x2 END AS x2, y2 FROM loc l JOIN (SELECT DISTINCT doc_id, bank_code FROM v_scan) d ON l.doc_id = d.doc_id),
best AS MATERIALIZED ({pick_sql(inside, "doc_id, name", "rank, confidence DESC, line_idx", "text, confidence, lang, rank")}),
chosen AS (SELECT b.*, CASE WHEN {own} THEN bank_code WHEN {fits} THEN text ELSE '' END AS text, CASE WHEN {own} THEN 1.0 WHEN {fits} THEN confidence ELSE 0.0 END AS conf FROM box b LEFT JOIN best c ON b.doc_id = c.doc_id AND b.name = c.name),
rule AS MATERIALIZED (SELECT f.*, trunc(px - 4.5 * length(text))::INT AS bx1, trunc(py - 8.5)::INT AS by1, trunc(px + 4.5 * length(text))::INT AS bx2, trunc(py + 8.5)::INT AS by2 FROM ({found}) f JOIN v_scan t ON f.doc_id = t.doc_id AND f.line_idx = t.line_idx),
joined AS (SELECT c.*, r.source, r.token, r.rc, bx1, by1, bx2, by2 FROM chosen c LEFT JOIN rule r ON c.doc_id = r.doc_id AND c.name = r.name),
step AS (SELECT *, token IS NOT NULL AND {steps} AS hit, bank_code = 'BANQUE_MISR' AND name = 'cheque_number' AS alone FROM joined),
took AS (SELECT doc_id, bank_code, name, loc_conf, {moved("x1", "greatest(0, bx1 - 33)")}, {moved("y1", "greatest(0, by1 - 13)")}, {moved("x2", "least(1676, bx2 + 33)")}, {moved("y2", "least(676, by2 + 13)")},
 CASE WHEN hit THEN token WHEN alone THEN '' ELSE text END AS text, CASE WHEN alone THEN coalesce(rc, 0.0) WHEN hit THEN greatest(conf, rc) ELSE conf END AS conf, CASE WHEN hit AND name = 'cheque_number' THEN source END AS source FROM step),
tidy AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {clear} THEN '' WHEN name = 'cheque_number' AND text <> '' THEN coalesce({number}, text) ELSE text END AS text, CASE WHEN {clear} THEN 0.0 ELSE conf END AS conf) FROM took),
parsed AS (SELECT *, err IS NULL AS ok FROM ({parsed}) UNION ALL BY NAME
 SELECT *, CASE WHEN text = '' THEN 'EMPTY' WHEN length(text) < 3 THEN 'TOO_SHORT' END AS err, CASE WHEN length(text) >= 3 THEN text END AS norm, length(text) >= 3 AS ok FROM (SELECT * FROM tidy WHERE name = 'name') UNION ALL BY NAME SELECT *, NULL AS err, NULL AS norm, false AS ok FROM tidy WHERE name = 'bank_name'),
rec AS MATERIALIZED (SELECT *, round(greatest(0.0, least(1.0, conf)) * greatest(0.0, least(1.0, loc_conf)) * CASE WHEN ok THEN 1.0 ELSE 0.97 END, 6) AS field_conf FROM parsed),
routes AS ({_route_sql("SELECT doc_id AS cheque_id, name, field_conf AS conf, CASE WHEN field_conf >= 0.995 THEN 'OK' ELSE 'VALIDATION_FAIL' END AS code FROM rec").replace("v_cheque c", "(SELECT DISTINCT doc_id AS cheque_id FROM rec) c")})
"""


EXTRACT_SQL = _extract_sql()


def extract_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Lines to decisions: locate, choose, apply the bank's rules, parse, score, route."""
    return pipeline.decisions(extracted(s, d))


REG.add("extract_pipeline", extract_pipeline, EXTRACT_SQL + "SELECT cheque_id AS doc_id, decision, stp, overall_conf, low_conf_fields, reasons FROM routes")


def extract_audit(s: SparkSession, d: str) -> DataFrame:
    """The same pages as audit documents, written and read back: one row for every field, with its box."""
    records = written(s, extracted(s, d), "records")
    path = work.folder(s, "extracted")
    writers.write_audit(pipeline.audit_documents(records, pipeline.decisions(records)), path, compression="gzip")
    back = readers.scan_audit(s, path).select("bank", "file", "decision.decision", "decision.stp", F.explode("fields").alias("name", "r"))
    return back.select("bank", "file", "decision", "stp", "name", "r.ocr_text", "r.parse_norm", "r.parse_ok", "r.field_conf", "r.source", *(F.col("r.bbox")[i].alias(n) for i, n in enumerate(ex.SIDES)))


REG.add("extract_audit", extract_audit, EXTRACT_SQL + "SELECT bank_code AS bank, concat(lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.jpg') AS file, decision, stp, name, nullif(text, '') AS ocr_text, norm AS parse_norm, ok AS parse_ok, field_conf, source, x1, y1, x2, y2 FROM rec JOIN routes ON doc_id = cheque_id")
REG.add("rtl_assembly", lambda s, d: ex.assemble_rtl(tok(s, d).select("doc_id", "line_idx", "text", "px", "py", (F.length("text") * 11.0).alias("width"))))

# ---------------------------------------------------------------- reports
REG.add(
    "ocr_summary", lambda s, d: reports.ocr_summary(tok(s, d)),
    """SELECT b.*, l.conf_by_lang FROM (SELECT bank_code, count(*) AS images, round(avg(n), 1) AS avg_lines, round(avg(m), 3) AS avg_conf FROM (SELECT bank_code, doc_id, count(*) AS n, avg(confidence) AS m FROM v_token GROUP BY 1, 2) GROUP BY 1) b
 JOIN (SELECT bank_code, string_agg(concat(lang, '=', CAST(c AS DECIMAL(5,3))), ';' ORDER BY lang) AS conf_by_lang FROM (SELECT bank_code, lang, round(avg(confidence), 3) AS c FROM v_token GROUP BY 1, 2) GROUP BY 1) l ON b.bank_code = l.bank_code""",
)
REG.add(
    "ocr_quality", lambda s, d: reports.ocr_quality(tok(s, d)),
    r"SELECT bank_code, count(*) AS files, count(CASE WHEN bank THEN 1 END) AS has_bank, count(CASE WHEN dt THEN 1 END) AS has_date, count(CASE WHEN egp THEN 1 END) AS has_egp, 0::BIGINT AS has_company, round(avg(n), 1) AS avg_lines FROM (SELECT bank_code, doc_id, count(*) AS n, bool_or(contains(upper(text), bank_code)) AS bank, bool_or(regexp_matches(text, '\b\d{1,2}[/-][A-Za-z0-9]{3}[/-]\d{2,4}\b')) AS dt, bool_or(text = 'EGP') AS egp FROM v_token GROUP BY 1, 2) GROUP BY 1",
)
_BOX = "SELECT bank_code, CASE line_idx % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'name' ELSE 'amount_numeric' END AS name, px AS x1, py AS y1, px + 100 + line_idx * 7 AS x2, py + 40 + doc_id % 9 AS y2 FROM v_token"
_N = {"x": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, x1 / 1677::DOUBLE))", "y": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, y1 / 677::DOUBLE))", "w": "greatest(1e-6::DOUBLE, least(1.0::DOUBLE, (x2 - x1) / 1677::DOUBLE))", "h": "greatest(1e-6::DOUBLE, least(1.0::DOUBLE, (y2 - y1) / 677::DOUBLE))"}
_S = {v: f"greatest(0.02::DOUBLE, CASE WHEN n > 2 THEN 1.4826::DOUBLE * d{v} ELSE 0.05 END)" for v in _N}
_E = {v: f"greatest(0.0::DOUBLE, m{v} - {_S[v]})" if v in "xy" else f"least(1.0::DOUBLE, m{v} + {_S[v]})" for v in _N}
_G = {v: f"greatest(0.0::DOUBLE, {_E[v]} - 0.02::DOUBLE)" if v in "xy" else f"least(1.0::DOUBLE, {_E[v]} + 0.04::DOUBLE)" for v in _N}
REG.add(
    "template_refine", lambda s, d: reports.refine_template(tok(s, d).select("bank_code", F.when(F.col("line_idx") % 3 == 0, "date").when(F.col("line_idx") % 3 == 1, "name").otherwise("amount_numeric").alias("name"), F.col("px").alias("x1"), F.col("py").alias("y1"), (F.col("px") + 100 + F.col("line_idx") * 7).alias("x2"), (F.col("py") + 40 + F.col("doc_id") % 9).alias("y2"))),
    f"WITH r AS (SELECT bank_code, name, {', '.join(f'{e} AS {v}' for v, e in _N.items())} FROM ({_BOX})), m AS (SELECT bank_code, name, count(*) AS n, {', '.join(f'median({v}) AS m{v}' for v in _N)} FROM r GROUP BY 1, 2), q AS (SELECT r.bank_code, r.name, n, {', '.join(f'm{v}' for v in _N)}, {', '.join(f'median(abs({v} - m{v})) AS d{v}' for v in _N)} FROM r JOIN m ON r.bank_code = m.bank_code AND r.name = m.name GROUP BY ALL) SELECT bank_code, name, n, {', '.join(f'round({_E[v]}, 3) AS roi_{v}' for v in _N)}, {', '.join(f'round({_G[v]}, 3) AS region_{v}' for v in _N)} FROM q",
)
_VOTE = "SELECT doc_id AS roi, line_idx % 3 AS vote, line_idx, text, confidence FROM v_token"
REG.add("roi_vote", lambda s, d: reports.roi_vote(tok(s, d).select(F.col("doc_id").alias("roi"), (F.col("line_idx") % 3).alias("vote"), "line_idx", "text", "confidence")), f"SELECT v.* FROM ({_VOTE}) v JOIN (SELECT roi, vote, row_number() OVER (PARTITION BY roi ORDER BY c DESC, vote) AS nth FROM (SELECT roi, vote, round(avg(confidence), 9) AS c FROM ({_VOTE}) GROUP BY 1, 2)) w ON v.roi = w.roi AND v.vote = w.vote AND nth = 1")
REG.add(
    "span_rollup", lambda s, d: reports.span_rollup(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("name"), F.col("value").alias("dur"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("parent"))),
    "SELECT event_type AS name, count(*) AS n, sum(CAST(trunc(value * 1000) AS BIGINT))::BIGINT AS ms FROM events WHERE event_id % 3 <> 0 AND value > 0 GROUP BY 1",
)
def raw_results(s: SparkSession, d: str) -> DataFrame:
    """Recognition results of pages in both layouts, by document."""
    lines = tok(s, d).withColumn("poly", F.array(*(F.array(F.col("px") + i, F.col("py") + j) for i, j in ((-9.0, -4.0), (9.0, -4.0), (9.0, 4.0), (-9.0, 4.0)))))
    pages = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text", "confidence", "poly"))).alias("l"))
    newer = F.to_json(F.array(F.struct(F.col("l.text").alias("rec_texts"), F.col("l.confidence").alias("rec_scores"), F.col("l.poly").alias("rec_polys"))))
    pair = lambda x: F.concat(F.lit("["), F.to_json(x["poly"]), F.lit(',["'), x["text"], F.lit('",'), x["confidence"].cast("string"), F.lit("]]"))
    older = F.concat(F.lit("[["), F.array_join(F.transform("l", pair), ","), F.lit("]]"))
    return pages.select("doc_id", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 2 == 0, newer).otherwise(older).alias("results"))


REG.add(
    "ocr_results_to_lines", lambda s, d: readers.results_to_lines(raw_results(s, d), 0.95).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "text", "confidence", "px", "py", F.size("bbox").cast("long").alias("corners")),
    "SELECT doc_id, line_idx, text, confidence, px::DOUBLE AS px, py::DOUBLE AS py, 4::BIGINT AS corners FROM v_token WHERE confidence >= 0.95",
)


def locator_report(s: SparkSession, d: str) -> DataFrame:
    """Located text against the field's own rectangle, with an error row for every page whose bank has no template."""
    lines = tok(s, d)
    hits = ex.locate_pattern(lines, fields(s, d)).select("doc_id", "name", "method", "confidence", "px", "py", F.col("text").alias("pattern_text"))
    both = hits.join(locator_eval(s, d).select("doc_id", "name", "roi_text", "match_flag"), ["doc_id", "name"]).join(lines.groupBy("doc_id").agg(F.first("bank_code").alias("bank")), "doc_id")
    box = [b.cast("int").alias(f"bbox_{n}") for b, n in zip(bbox_around(F.col("px"), F.col("py"), *ex.BOX["region_regex"]), ("x1", "y1", "x2", "y2"), strict=True)]
    located = both.select(F.col("doc_id").cast("string").alias("file"), "bank", F.col("name").alias("field"), "method", "confidence", *box, "pattern_text", "roi_text", "match_flag")
    errors = ex.without_template(lines, fields(s, d)).select(F.col("doc_id").cast("string").alias("file"), F.col("bank_code").alias("bank"), F.lit("template missing").alias("error")).distinct()
    return reports.locator_report(located, errors)


REG.add(
    "locator_report", locator_report,
    f"""SELECT h.doc_id::VARCHAR AS file, bank_code AS bank, h.name AS field, 'region_regex' AS method, CAST(CAST(round(confidence, 3) AS DECIMAL(12,3)) AS VARCHAR) AS confidence,
 greatest(0, px - 167)::VARCHAR AS bbox_x1, greatest(0, py - 27)::VARCHAR AS bbox_y1, least(1677, greatest(0, px - 167) + 335)::VARCHAR AS bbox_x2, least(677, greatest(0, py - 27) + 54)::VARCHAR AS bbox_y2, text AS pattern_text, roi_text, CAST(match_flag AS INT)::VARCHAR AS match_flag
FROM ({pick_sql(_HIT.format("v_tfield"), "doc_id, name", "confidence DESC, line_idx", "bank_code, text, confidence, px, py")}) h JOIN ({LOCATOR_SQL}) e ON h.doc_id = e.doc_id AND h.name = e.name
UNION ALL SELECT DISTINCT doc_id::VARCHAR, bank_code, '<error>', '', '', '', '', '', '', 'template missing', '', '0' FROM v_token WHERE bank_code NOT IN (SELECT bank_code FROM v_tfield)""",
)
_BY_FIELD = f"SELECT t.*, r.name, {_RANK_EVAL} AS rank FROM v_scan t JOIN v_tfield r ON t.bank_code = r.bank_code WHERE px BETWEEN rx1 AND rx2 AND py BETWEEN ry1 AND ry2 AND lang = CASE r.name WHEN 'name' THEN 'ar' ELSE 'en' END"
REG.add(
    "field_ocr_report", lambda s, d: reports.field_ocr_report(scan(s, d), fields(s, d)),
    f"SELECT p.doc_id::VARCHAR AS file, p.bank_code AS bank, f.name AS field, coalesce(text, '') AS text, CAST(CAST(round(coalesce(confidence, 0), 3) AS DECIMAL(12,3)) AS VARCHAR) AS confidence, coalesce(lang, '') AS lang, rx1 AS roi_x1, ry1 AS roi_y1, rx2 AS roi_x2, ry2 AS roi_y2 FROM (SELECT DISTINCT doc_id, bank_code FROM v_scan) p JOIN v_tfield f ON p.bank_code = f.bank_code LEFT JOIN ({pick_sql(_BY_FIELD, 'doc_id, name', 'rank, confidence DESC, line_idx', 'text, confidence, lang')}) c ON c.doc_id = p.doc_id AND c.name = f.name",
)


def payee_match(s: SparkSession, d: str) -> DataFrame:
    """Payees against the master list by similarity, the first best of at least the threshold."""
    parts = s.read.parquet(f"{d}/part.parquet")
    master = parts.groupBy(F.col("p_name").alias("master")).agg(F.min("p_partkey").alias("master_pos"))
    payees = parts.select("p_partkey", F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)")).alias("payee"))
    top = match.best_matches(payees.select("payee").distinct(), master)
    own = validate_payee(F.col("payee"))
    code = F.when(own != "OK", own).when(F.col("ratio").isNotNull(), "OK").otherwise("PAYEE_NOT_IN_MASTER")
    return payees.join(top, "payee", "left").select("p_partkey", "payee", F.col("master").alias("match"), "ratio", code.alias("code"))


REG.add("payee_match", payee_match)
