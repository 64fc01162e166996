"""Queries over the document tables: rates, routing, audit documents, corrections, batches and exports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.functions.text import best_value, sanitize_key
from inkledger.functions.validate import BANKS, KPI_FIELDS, THRESHOLD
from inkledger.operators import audit, kpi, route
from inkledger.plans.domain import Registry, view
from inkledger.plans.scalars import parsed_sql
from inkledger.sources import versions, work

REG = Registry()
KPI_IN = "('date','cheque_number','amount_numeric')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return audit.documents(view(spark, d, "v_cheque"), view(spark, d, "v_full"))


# ---------------------------------------------------------------- rates
KPI_BATCH_SQL = f"""SELECT c.bank_code, c.batch_date, count(DISTINCT c.cheque_id) AS total_cheques, count(DISTINCT CASE WHEN f.corrected THEN c.cheque_id END) AS cheques_with_errors,
 count(f.name) AS total_fields, count(CASE WHEN f.corrected THEN 1 END) AS incorrect_fields,
 round(count(DISTINCT CASE WHEN f.corrected THEN c.cheque_id END) / count(DISTINCT c.cheque_id), 4) AS error_rate_cheques, round(count(CASE WHEN f.corrected THEN 1 END) / nullif(count(f.name), 0), 4) AS error_rate_fields,
 count(DISTINCT CASE WHEN f.corrected THEN c.cheque_id END) / count(DISTINCT c.cheque_id) > 0.8 AS flagged
FROM v_cheque c LEFT JOIN (SELECT * FROM v_field WHERE name IN {KPI_IN}) f ON c.cheque_id = f.cheque_id GROUP BY 1, 2"""
REG.add("kpi_batch", lambda s, d: kpi.kpi_batch(view(s, d, "v_cheque"), view(s, d, "v_field")), KPI_BATCH_SQL)
REG.add("incorrect_per_cheque", lambda s, d: kpi.incorrect_per_cheque(view(s, d, "v_field")).select("cheque_id", "incorrect"), f"SELECT cheque_id, count(CASE WHEN corrected THEN 1 END) AS incorrect FROM v_field WHERE name IN {KPI_IN} GROUP BY 1")
REG.add(
    "kpi_bank", lambda s, d: kpi.kpi_bank(view(s, d, "v_cheque"), view(s, d, "v_field"), view(s, d, "v_correction")),
    """WITH n AS (SELECT cheque_id, count(DISTINCT name) AS n FROM v_field WHERE name <> 'name' GROUP BY 1), w AS (SELECT cheque_id, count(DISTINCT field) AS n FROM v_correction WHERE field <> 'name' GROUP BY 1)
SELECT bank_code, count(*) AS total_cheques, count(w.n) AS cheques_with_errors, coalesce(sum(n.n), 0)::BIGINT AS total_fields, coalesce(sum(w.n), 0)::BIGINT AS incorrect_fields,
 count(w.n) / count(*) AS error_rate_cheques, coalesce(coalesce(sum(w.n), 0) / nullif(coalesce(sum(n.n), 0), 0), 0.0) AS error_rate_fields
FROM v_cheque c LEFT JOIN n ON c.cheque_id = n.cheque_id LEFT JOIN w ON c.cheque_id = w.cheque_id GROUP BY 1""",
)
REG.add(
    "batch_elapsed", lambda s, d: kpi.batch_elapsed(view(s, d, "v_batch").withColumn("ended_at", F.when(F.col("seq") % 3 > 0, F.col("created_at")))).select("bank_code", "batch_date", "processing_ms"),
    "SELECT bank_code, batch_date, CASE WHEN seq % 3 > 0 THEN epoch_ms(created_at::TIMESTAMP) - epoch_ms(started_at::TIMESTAMP) END AS processing_ms FROM v_batch",
)
REG.add("max_seq", lambda s, d: kpi.max_seq(view(s, d, "v_batch")), "SELECT bank_code, batch_date, coalesce(max(seq), 0) AS max_seq FROM v_batch GROUP BY 1, 2")
_NAME_SQL = "concat(strftime(batch_date, '%d_%m_%Y'), '_', bank_code, '_', CASE WHEN seq < 10 THEN concat('0', seq) ELSE seq::VARCHAR END)"
REG.add("batch_name", lambda s, d: view(s, d, "v_batch").select("bank_code", "batch_date", kpi.batch_name(F.col("batch_date"), F.col("bank_code"), F.col("seq")).alias("name")), f"SELECT bank_code, batch_date, {_NAME_SQL} AS name FROM v_batch")


@REG.query("seq_from_name", "SELECT bank_code, batch_date, CASE WHEN month(batch_date) % 3 = 0 THEN 0 ELSE seq::INT END AS parsed FROM v_batch")
def seq_from_name(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, "v_batch")
    named = b.withColumn("name", kpi.batch_name(F.col("batch_date"), F.when(F.month("batch_date") % 3 == 0, F.lit("OTHER_BANK")).otherwise(F.col("bank_code")), F.col("seq")))
    return named.select("bank_code", "batch_date", F.coalesce(kpi.seq_from_name(F.col("name"), F.col("bank_code"), F.col("batch_date")), F.lit(0)).alias("parsed"))


REG.add("business_date", lambda s, d: view(s, d, "v_correction").select("correction_id", kpi.business_date(F.col("made_at")).alias("day")), "SELECT correction_id, CAST(timezone('Africa/Cairo', timezone('UTC', made_at::TIMESTAMP)) AS DATE) AS day FROM v_correction")

# ---------------------------------------------------------------- routing
_C3 = lambda c: f"concat((CAST(round(round({c}, 6) * 1000) AS INT) // 1000)::VARCHAR, '.', lpad((CAST(round(round({c}, 6) * 1000) AS INT) % 1000)::VARCHAR, 3, '0'))"


def _route_sql(coded: str) -> str:
    required = ["date", "amount_numeric", "cheque_number", "name"]
    per = ", ".join(f"max(CASE WHEN name = '{f}' THEN conf END) AS c_{f}, max(CASE WHEN name = '{f}' THEN code END) AS k_{f}" for f in required)
    conf = {f: f"coalesce(c_{f}, 0.0)" for f in required}
    ok = " AND ".join(f"{conf[f]} >= {THRESHOLD} AND coalesce(k_{f}, 'OK') = 'OK'" for f in required)
    low = ", ".join(f"CASE WHEN {conf[f]} < {THRESHOLD} THEN '{f}' END" for f in required)
    why = ", ".join(f"CASE WHEN {conf[f]} < {THRESHOLD} THEN concat('low_confidence:{f}:', {_C3(conf[f])}, '<thr0.995') END, CASE WHEN k_{f} <> 'OK' THEN concat('validation_failed:{f}:', k_{f}) END" for f in required)
    return f"""SELECT cheque_id, CASE WHEN {ok} THEN 'auto_approve' ELSE 'review' END AS decision, {ok} AS stp, round(least({", ".join(conf.values())}), 6) AS overall_conf, concat_ws(';', {low}) AS low_conf_fields, concat_ws(';', {why}) AS reasons
FROM (SELECT c.cheque_id, {per} FROM v_cheque c LEFT JOIN ({coded}) x ON c.cheque_id = x.cheque_id GROUP BY 1)"""


ROUTE_SQL = _route_sql(f"SELECT cheque_id, name, field_conf AS conf, CASE WHEN round(field_conf, 6) >= {THRESHOLD} THEN 'OK' ELSE 'VALIDATION_FAIL' END AS code FROM v_full")


_DIGITS = r"regexp_replace(norm, '[^0-9]', '', 'g')"
VALIDATED_SQL = rf"""SELECT cheque_id, name, conf, CASE
 WHEN name = 'name' THEN CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) < 3 THEN 'PAYEE_TOO_SHORT' ELSE 'OK' END
 WHEN coalesce(norm, '') = '' THEN NULL
 WHEN name = 'date' THEN CASE WHEN CAST(substr(norm, 1, 4) AS INT) NOT BETWEEN 2000 AND 2100 THEN 'DATE_RANGE' WHEN TRY_CAST(norm AS DATE) IS NULL THEN 'DATE_INVALID' ELSE 'OK' END
 WHEN name = 'amount_numeric' THEN CASE WHEN norm::DOUBLE <= 0 THEN 'AMOUNT_NONPOS' WHEN norm::DOUBLE NOT BETWEEN 0.01 AND 1e9 THEN 'AMOUNT_RANGE' ELSE 'OK' END
 WHEN name = 'cheque_number' THEN CASE WHEN regexp_full_match({_DIGITS}, CASE bank_code WHEN 'BANQUE_MISR' THEN '\d{{6,}}' WHEN 'CIB' THEN '\d{{12}}' WHEN 'AAIB' THEN '\d{{9,10}}' WHEN 'NBE' THEN '\d{{14}}' ELSE '\d{{8,12}}' END) THEN 'OK' ELSE 'CHEQUE_PATTERN' END END AS code
FROM ({parsed_sql("SELECT f.cheque_id, bank_code, name, ocr_text AS text, field_conf AS conf FROM v_full f JOIN v_cheque b ON f.cheque_id = b.cheque_id")})"""


def decisions(s: SparkSession, d: str) -> DataFrame:
    f = view(s, d, "v_full").select("cheque_id", "name", F.col("field_conf").alias("conf"), route.threshold_code(F.col("field_conf")).alias("code"))
    return route.route(view(s, d, "v_cheque"), f)


REG.add("route_decision", decisions, ROUTE_SQL)
REG.add("decisions_report", lambda s, d: decisions(s, d).withColumns({"overall_conf": route.three_places(F.col("overall_conf")), "stp": F.lower(F.col("stp").cast("string"))}), f"SELECT cheque_id, decision, lower(stp::VARCHAR) AS stp, {_C3('overall_conf')} AS overall_conf, low_conf_fields, reasons FROM ({ROUTE_SQL})")
REG.add("route_summary", lambda s, d: route.route_summary(view(s, d, "v_cheque"), view(s, d, "v_full").withColumn("conf", F.col("field_conf"))), _route_sql(VALIDATED_SQL))
REG.add(
    "decision_json", lambda s, d: view(s, d, "v_cheque").select("cheque_id", F.to_json(F.struct("decision", "stp")).alias("js")).select("cheque_id", "js", F.from_json("js", "decision string, stp boolean").alias("x")).select("cheque_id", "js", "x.decision", "x.stp"),
    """SELECT cheque_id, concat('{"decision":"', decision, '","stp":', stp::VARCHAR, '}') AS js, decision, stp FROM v_cheque""",
)

# ---------------------------------------------------------------- audit documents
REG.add("fields_long", lambda s, d: audit.field_rows(docs(s, d)).select("cheque_id", "name", "ocr_text", "parse_norm", F.round("field_conf", 6).alias("field_conf")), "SELECT f.cheque_id, name, ocr_text, parse_norm, round(field_conf, 6) AS field_conf FROM v_full f JOIN v_cheque c ON c.cheque_id = f.cheque_id")
_BEST = "coalesce(nullif(parse_norm, ''), nullif(ocr_text, ''))"
WIDE_SQL = f"SELECT c.cheque_id, c.bank_code AS bank, c.file_id AS file, " + ", ".join(f"max(CASE WHEN name = '{f}' THEN {_BEST} END) AS {f}" for f in audit.EXPORT_FIELDS) + ", count(CASE WHEN name IN ('date','cheque_number','amount_numeric') AND valid THEN 1 END) AS n_valid, min(CASE WHEN name IN ('date','cheque_number','amount_numeric') THEN field_conf END) AS conf FROM v_cheque c LEFT JOIN v_full f ON c.cheque_id = f.cheque_id GROUP BY 1, 2, 3"  # noqa: F541
REG.add("fields_wide", lambda s, d: audit.wide(docs(s, d)), f"SELECT cheque_id, bank, file, date, cheque_number, amount_numeric FROM ({WIDE_SQL})")
REG.add("best_value", lambda s, d: view(s, d, "v_full").select("cheque_id", "name", best_value(F.col("parse_norm"), F.col("ocr_text")).alias("value")), f"SELECT cheque_id, name, {_BEST} AS value FROM v_full")
REG.add("approved_filter", lambda s, d: docs(s, d).filter(audit.approved()).select("cheque_id"), "SELECT cheque_id FROM v_cheque WHERE lower(decision) = 'auto_approve' OR coalesce(stp, FALSE)")
REG.add("validated_filter", lambda s, d: docs(s, d).filter(audit.validated()).select("cheque_id"), f"SELECT cheque_id FROM ({WIDE_SQL}) WHERE n_valid = 3")
_ERR_SQL = "concat_ws(';', CASE WHEN coalesce(bank, '') = '' THEN 'missing:bank' END, CASE WHEN coalesce(file, '') = '' THEN 'missing:file' END, " + ", ".join(f"CASE WHEN {f} IS NULL THEN 'missing:{f}' END" for f in audit.EXPORT_FIELDS) + ")"
REG.add("schema_errors", lambda s, d: docs(s, d).select("cheque_id", F.array_join(audit.schema_errors(), ";").alias("errors"), (F.size(audit.schema_errors()) == 0).alias("ok")), f"SELECT cheque_id, {_ERR_SQL} AS errors, {_ERR_SQL} = '' AS ok FROM ({WIDE_SQL})")
REG.add(
    "approved_export", lambda s, d: audit.approved_export(docs(s, d)),
    f"SELECT w.cheque_id, bank, file, date, cheque_number, amount_numeric, coalesce(c.stp, FALSE) AS stp, round(conf, 6) AS overall_conf FROM ({WIDE_SQL}) w JOIN v_cheque c ON w.cheque_id = c.cheque_id WHERE (c.decision = 'auto_approve' OR c.stp) AND n_valid = 3 AND {_ERR_SQL} = ''",
)
REG.add("bank_filter", lambda s, d: view(s, d, "v_cheque").filter(F.upper(F.trim("bank_code")).isin(BANKS[:3])).select("cheque_id", "bank_code", F.col("bank_code").isin([*BANKS, "UNKNOWN"]).alias("known")), "SELECT cheque_id, bank_code, TRUE AS known FROM v_cheque WHERE bank_code IN ('QNB','FABMISR','BANQUE_MISR')")


@REG.query("generated_range", "SELECT cheque_id FROM v_cheque WHERE cheque_id % 17 <> 0 AND created_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'")
def generated_range(s: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("cheque_id") % 17 == 0, F.lit("soon")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ts = F.try_to_timestamp(at)
    return view(s, d, "v_cheque").filter((ts >= F.lit("1994-01-01").cast("timestamp")) & (ts <= F.lit("1995-06-30").cast("timestamp"))).select("cheque_id")


REG.add("batches_range", lambda s, d: view(s, d, "v_batch").filter(F.col("batch_date").between("1994-01-01", "1995-06-30")).select("bank_code", "batch_date", "n"), "SELECT bank_code, batch_date, n FROM v_batch WHERE batch_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'")
DAILY_SQL = f"SELECT bank_code, batch_date, total_cheques, flagged FROM ({KPI_BATCH_SQL.replace('v_cheque', 'v_daily')})"


@REG.query("batches_flagged", f"WITH k AS ({DAILY_SQL}) SELECT 'all' AS wanted, * FROM k UNION ALL SELECT 'flagged', * FROM k WHERE flagged UNION ALL SELECT 'clear', * FROM k WHERE NOT flagged")
def batches_flagged(s: SparkSession, d: str) -> DataFrame:
    """Batches of a day by each state of the filter."""
    daily = kpi.kpi_batch(view(s, d, "v_daily"), view(s, d, "v_field")).select("bank_code", "batch_date", "total_cheques", "flagged")
    states = [kpi.flagged_only(daily, state).select(F.lit(name).alias("wanted"), "*") for name, state in (("all", None), ("flagged", True), ("clear", False))]
    return states[0].union(states[1]).union(states[2])


REG.add("lines_min_conf", lambda s, d: view(s, d, "v_token").filter(F.col("confidence") >= 0.93).select("doc_id", "line_idx", "text"), "SELECT doc_id, line_idx, text FROM v_token WHERE confidence >= 0.93")
REG.add("review_items", lambda s, d: view(s, d, "v_cheque").select(F.col("bank_code").alias("bank"), F.regexp_replace("file_id", r"\.[^.]*$", "").alias("stem")).orderBy("bank", "stem"), r"SELECT bank_code AS bank, regexp_replace(file_id, '\.[^.]*$', '') AS stem FROM v_cheque")


@REG.query("review_item", "SELECT cheque_id, bank_code AS bank, file_id AS file, concat('http://local/files/', bank_code, '/', file_id) AS image_url, concat('http://local/review/', bank_code, '/', file_id) AS review_url FROM v_cheque WHERE bank_code = 'CIB' AND file_id = 'f00000003.jpg'")
def review_item(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cheque").filter((F.col("bank_code") == "CIB") & (F.col("file_id") == "f00000003.jpg"))
    url = lambda part: F.concat_ws("/", F.lit("http://local"), F.lit(part), "bank_code", "file_id")
    return c.select("cheque_id", F.col("bank_code").alias("bank"), F.col("file_id").alias("file"), F.coalesce(F.lit(None).cast("string"), url("files")).alias("image_url"), url("review").alias("review_url"))


REG.add("batches_list", lambda s, d: view(s, d, "v_batch").select("bank_code", "batch_date", "seq", "n").orderBy(F.desc("batch_date"), F.desc("seq"), "bank_code"), "SELECT bank_code, batch_date, seq, n FROM v_batch")
REG.add(
    "manifest_filter", lambda s, d: view(s, d, "v_cheque").select("cheque_id", F.concat(F.element_at(F.array(*map(F.lit, ["a/", "../", "/", ""])), (F.col("cheque_id") % 4 + 1).cast("int")), "file_id", F.when(F.col("cheque_id") % 5 == 0, ".txt").otherwise("")).alias("path"))
    .filter(F.col("path").rlike(r"(?i)\.(jpe?g|png|tiff?)$") & ~F.col("path").contains("..") & ~F.col("path").rlike(r"^[/\\]")),
    "SELECT cheque_id, concat(CASE WHEN cheque_id % 4 = 0 THEN 'a/' ELSE '' END, file_id) AS path FROM v_cheque WHERE cheque_id % 5 <> 0 AND cheque_id % 4 IN (0, 3)",
)

# ---------------------------------------------------------------- corrections
CHAIN_SQL = """SELECT correction_id, k.cheque_id, field, CASE WHEN nth = 1 THEN parse_norm ELSE previous END AS before, after, reviewer_id, made_at FROM
 (SELECT *, lag(after) OVER w AS previous, row_number() OVER w AS nth FROM v_correction WINDOW w AS (PARTITION BY cheque_id, field ORDER BY made_at, correction_id)) k LEFT JOIN v_full f ON k.cheque_id = f.cheque_id AND k.field = f.name"""
REG.add("correction_chain", lambda s, d: audit.correction_chain(view(s, d, "v_correction"), view(s, d, "v_full")), CHAIN_SQL)
REG.add("current_value", lambda s, d: audit.current_values(view(s, d, "v_correction")), "SELECT cheque_id, field, arg_max(after, struct_pack(a := made_at, b := correction_id)) AS after, arg_max(reviewer_id, struct_pack(a := made_at, b := correction_id)) AS reviewer_id, max(made_at) AS made_at, count(*) AS n FROM v_correction GROUP BY 1, 2")
APPLY_SQL = """WITH ch AS (SELECT *, CASE WHEN nth = 1 THEN coalesce(parse_norm, ocr_text) ELSE previous END AS before FROM (SELECT *, lag(after) OVER w AS previous, row_number() OVER w AS nth FROM v_correction WHERE field <> 'name' WINDOW w AS (PARTITION BY cheque_id, field ORDER BY made_at, correction_id)) k
  LEFT JOIN (SELECT cheque_id AS fc, name, parse_norm, ocr_text FROM v_full) f ON k.cheque_id = f.fc AND k.field = f.name),
 l AS (SELECT cheque_id, field, arg_max(after, struct_pack(a := made_at, b := correction_id)) AS after, max(made_at) AS made_at FROM ch WHERE before IS DISTINCT FROM after AND cheque_id IN (SELECT cheque_id FROM v_cheque) GROUP BY 1, 2)
SELECT coalesce(f.cheque_id, l.cheque_id) AS cheque_id, coalesce(f.name, l.field) AS name, CASE WHEN l.made_at IS NOT NULL THEN l.after ELSE parse_norm END AS parse_norm, CASE WHEN l.made_at IS NOT NULL THEN TRUE ELSE parse_ok END AS parse_ok,
 CASE WHEN l.made_at IS NOT NULL THEN TRUE ELSE valid END AS meets_threshold, CASE WHEN l.made_at IS NOT NULL THEN TRUE ELSE corrected END AS corrected, l.made_at AS last_corrected_at FROM v_full f FULL JOIN l ON f.cheque_id = l.cheque_id AND f.name = l.field"""
REG.add("apply_corrections", lambda s, d: audit.apply_corrections(view(s, d, "v_full").withColumnRenamed("valid", "meets_threshold"), view(s, d, "v_correction"), view(s, d, "v_cheque")), APPLY_SQL)
REG.add("affected_batches", lambda s, d: view(s, d, "v_correction").select("cheque_id").distinct().join(view(s, d, "v_cheque"), "cheque_id").select("bank_code", "batch_date").distinct(), "SELECT DISTINCT bank_code, batch_date FROM v_correction k JOIN v_cheque c ON k.cheque_id = c.cheque_id")


def audit_fold(s: SparkSession, d: str) -> DataFrame:
    folded = audit.fold_corrections(docs(s, d), view(s, d, "v_correction"))
    count = F.coalesce(F.size("corrections"), F.lit(0))
    text = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"]["parse_norm"], F.lit(""))))
    return folded.select("cheque_id", F.greatest(count, F.lit(0)).cast("long").alias("n_corrections"), F.array_join(text, ";").alias("fields"))


REG.add(
    "audit_fold", audit_fold,
    """SELECT c.cheque_id, coalesce(max(n), 0)::BIGINT AS n_corrections, coalesce(string_agg(CASE WHEN x.name IS NOT NULL THEN concat(x.name, '=', coalesce(x.v, '')) END, ';' ORDER BY x.name), '') AS fields FROM v_cheque c LEFT JOIN
 (SELECT f.cheque_id, f.name, coalesce(l.after, f.parse_norm) AS v, sum(coalesce(l.n, 0)) OVER (PARTITION BY f.cheque_id) AS n FROM v_full f LEFT JOIN (SELECT cheque_id, field, arg_max(after, struct_pack(a := made_at, b := correction_id)) AS after, count(*) AS n FROM v_correction GROUP BY 1, 2) l ON f.cheque_id = l.cheque_id AND f.name = l.field) x
 ON c.cheque_id = x.cheque_id GROUP BY 1""",
)
#: Overrides typed in at export, one for each exported field of every document: a new value, the recognised one or none.
_VALUE = "CASE cheque_id % 3 WHEN 0 THEN concat('X', ocr_text) WHEN 1 THEN ocr_text END"
_OVER = f"SELECT cheque_id, name, {_VALUE} AS value FROM v_full WHERE name IN ('date','cheque_number','amount_numeric','name')"


def overrides(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_full").filter(F.col("name").isin([*KPI_FIELDS, "name"])).select("cheque_id", "name", F.expr(_VALUE).alias("value"))


def overridden(s: SparkSession, d: str) -> DataFrame:
    """Fields with overrides put in; Arabic fields take the override as recognised text as well."""
    f = view(s, d, "v_full").withColumn("lang", F.when(F.col("name") == "name", "ar").otherwise("en")).join(overrides(s, d), ["cheque_id", "name"], "left")
    return f.withColumns({"old": best_value(F.col("parse_norm"), F.col("ocr_text")), "ocr_text": F.when(F.col("value").isNotNull() & (F.col("lang") == "ar"), F.col("value")).otherwise(F.col("ocr_text")), "parse_norm": F.coalesce("value", "parse_norm")})


REG.add("export_overrides", lambda s, d: overridden(s, d).select("cheque_id", "name", "parse_norm", "ocr_text"), f"SELECT f.cheque_id, f.name, coalesce(o.value, parse_norm) AS parse_norm, CASE WHEN o.value IS NOT NULL AND f.name = 'name' THEN o.value ELSE ocr_text END AS ocr_text FROM v_full f LEFT JOIN ({_OVER}) o ON f.cheque_id = o.cheque_id AND f.name = o.name")
REG.add("export_corrections", lambda s, d: overridden(s, d).filter("value is not null and name <> 'name' and value is distinct from old").select("cheque_id", F.col("name").alias("field"), F.col("old").alias("before"), F.col("value").alias("after"), F.lit("export").alias("reviewer_id")), f"SELECT f.cheque_id, f.name AS field, {_BEST} AS before, o.value AS after, 'export' AS reviewer_id FROM v_full f JOIN ({_OVER}) o ON f.cheque_id = o.cheque_id AND f.name = o.name WHERE f.name <> 'name' AND o.value IS NOT NULL AND o.value IS DISTINCT FROM {_BEST}")


@REG.query("review_export", f"SELECT r.pos, w.bank, w.date, w.cheque_number, w.amount_numeric FROM (SELECT event_id AS pos, user_id AS cheque_id FROM events) r JOIN ({WIDE_SQL}) w ON r.cheque_id = w.cheque_id")
def review_export(s: SparkSession, d: str) -> DataFrame:
    asked = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("pos"), F.col("user_id").alias("cheque_id"))
    return audit.wide(docs(s, d)).join(asked, "cheque_id").select("pos", "bank", *audit.EXPORT_FIELDS).orderBy("pos")


# ---------------------------------------------------------------- batches
NEXT_SQL = "SELECT bank_code, batch_date, day(created_at)::INT AS day, (2 + row_number() OVER (PARTITION BY bank_code, batch_date ORDER BY min(created_at), day(created_at)))::BIGINT AS seq FROM v_cheque GROUP BY bank_code, batch_date, day(created_at)"


@REG.query("next_batch_seq", NEXT_SQL)
def next_batch_seq(s: SparkSession, d: str) -> DataFrame:
    """New batches (here a day's cheques of a bank) are numbered after the highest number their bank and date has."""
    taken = kpi.max_seq(view(s, d, "v_batch").withColumn("seq", F.col("seq") + 1))
    new = view(s, d, "v_cheque").groupBy("bank_code", "batch_date", F.day("created_at").alias("day")).agg(F.min("created_at").alias("first"))
    order = Window.partitionBy("bank_code", "batch_date").orderBy("first", "day")
    return new.join(taken, ["bank_code", "batch_date"], "left").select("bank_code", "batch_date", "day", (F.coalesce("max_seq", F.lit(0)) + F.row_number().over(order)).alias("seq"))


REG.add("index_in_batch", lambda s, d: view(s, d, "v_cheque").select("cheque_id", (F.row_number().over(Window.partitionBy("bank_code", "batch_date").orderBy("created_at", "cheque_id")) - 1).cast("long").alias("idx")), "SELECT cheque_id, row_number() OVER (PARTITION BY bank_code, batch_date ORDER BY created_at, cheque_id) - 1 AS idx FROM v_cheque")
SESSION_SQL = r"""WITH r AS (SELECT event_id, bank, ts, CASE WHEN correlation_id = '' THEN concat('event:', event_id) ELSE coalesce(nullif(substr(regexp_replace(correlation_id, '[^\p{L}\p{N}_-]', '', 'g'), 1, 128), ''), 'anon') END AS key FROM v_session),
 o AS (SELECT bank, key, min(ts) AS first_ts, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_event FROM r GROUP BY 1, 2),
 n AS (SELECT *, CAST(timezone('Africa/Cairo', timezone('UTC', first_ts::TIMESTAMP)) AS DATE) AS batch_date FROM o),
 q AS (SELECT *, row_number() OVER (PARTITION BY bank, batch_date ORDER BY first_ts, first_event) AS seq FROM n)
SELECT event_id, r.bank, batch_date, seq, concat(strftime(batch_date, '%d_%m_%Y'), '_', r.bank, '_', CASE WHEN seq < 10 THEN concat('0', seq) ELSE seq::VARCHAR END) AS batch_name FROM r JOIN q ON r.bank = q.bank AND r.key = q.key"""
REG.add("session_batches", lambda s, d: kpi.session_batches(view(s, d, "v_session"), sanitize_key(F.col("correlation_id"))), SESSION_SQL)
REG.add("new_banks", lambda s, d: kpi.missing_keys(view(s, d, "v_cheque"), view(s, d, "v_region"), ["bank_code"]), "SELECT DISTINCT bank_code FROM v_cheque WHERE bank_code NOT IN (SELECT bank_code FROM v_region)")
_HAVE = "SELECT bank_code, batch_date FROM v_batch WHERE month(batch_date) % 2 = 0"
REG.add("upsert_batches", lambda s, d: kpi.missing_keys(view(s, d, "v_cheque"), view(s, d, "v_batch").filter(F.month("batch_date") % 2 == 0), ["bank_code", "batch_date"]), f"SELECT DISTINCT bank_code, batch_date FROM v_cheque EXCEPT ({_HAVE})")


@REG.query("create_batches", f"SELECT bank_code, batch_date, concat(strftime(batch_date, '%d_%m_%Y'), '_', bank_code, '_01') AS name, CASE WHEN month(batch_date) % 2 = 0 THEN n ELSE 0 END AS n FROM v_batch")
def create_batches(s: SparkSession, d: str) -> DataFrame:
    """Two uploads at once ask for the batches of overlapping months; each batch is there once. Then counts
    are put in for those of every other month."""
    root, keys = work.folder(s, "batches"), ["bank_code", "name"]
    batches = view(s, d, "v_batch").select("bank_code", "batch_date", kpi.batch_name(F.col("batch_date"), F.col("bank_code"), F.lit(1)).alias("name"), "n")
    halves = [batches.filter(F.month("batch_date") <= 8), batches.filter(F.month("batch_date") >= 5)]
    with ThreadPoolExecutor(len(halves)) as pool:
        list(pool.map(lambda h: versions.get_or_create(s, root, h.withColumn("n", F.lit(0).cast("long")), keys), halves))
    return versions.upsert(s, root, batches.filter(F.month("batch_date") % 2 == 0), keys)


REG.add(
    "batch_detail", lambda s, d: view(s, d, "v_batch").select("bank_code", "batch_date", "seq").join(view(s, d, "v_cheque"), ["bank_code", "batch_date"]).select("bank_code", "batch_date", "seq", "cheque_id", "file_id", (F.row_number().over(Window.partitionBy("bank_code", "batch_date").orderBy("created_at", "cheque_id")) - 1).cast("long").alias("idx")),
    "SELECT c.bank_code, c.batch_date, b.seq, cheque_id, file_id, row_number() OVER (PARTITION BY c.bank_code, c.batch_date ORDER BY c.created_at, cheque_id) - 1 AS idx FROM v_cheque c JOIN v_batch b ON c.bank_code = b.bank_code AND c.batch_date = b.batch_date",
)
REG.add(
    "recent_batches", lambda s, d: view(s, d, "v_batch").orderBy(F.desc("started_at"), "bank_code").limit(5).join(REG.queries["kpi_batch"](s, d), ["bank_code", "batch_date"]).select("bank_code", "batch_date", "total_cheques", kpi.accuracy(F.col("error_rate_fields")).alias("accuracy")),
    f"SELECT b.bank_code, b.batch_date, total_cheques, round((1 - error_rate_fields) * 100, 2) AS accuracy FROM (SELECT * FROM v_batch ORDER BY started_at DESC, bank_code LIMIT 5) b JOIN ({KPI_BATCH_SQL}) k ON b.bank_code = k.bank_code AND b.batch_date = k.batch_date",
)


def finalize(s: SparkSession, d: str, batches: DataFrame) -> DataFrame:
    """Batches with their end, elapsed time and rates."""
    done = kpi.batch_elapsed(batches.withColumn("ended_at", F.col("started_at") + F.expr("INTERVAL 90 SECONDS")), "created_at")
    return done.join(REG.queries["kpi_batch"](s, d), ["bank_code", "batch_date"], "left").select("bank_code", "batch_date", "ended_at", "processing_ms", "total_cheques", "incorrect_fields", "error_rate_cheques", "flagged")


FINAL_SQL = f"SELECT b.bank_code, b.batch_date, b.started_at + INTERVAL 90 SECONDS AS ended_at, epoch_ms((b.started_at + INTERVAL 90 SECONDS)::TIMESTAMP) - epoch_ms(b.created_at::TIMESTAMP) AS processing_ms, total_cheques, incorrect_fields, error_rate_cheques, flagged FROM v_batch b LEFT JOIN ({KPI_BATCH_SQL}) k ON b.bank_code = k.bank_code AND b.batch_date = k.batch_date"
REG.add("finalize_batches", lambda s, d: finalize(s, d, view(s, d, "v_batch")), FINAL_SQL)
REG.add("batch_snapshot", lambda s, d: finalize(s, d, view(s, d, "v_batch")).drop("ended_at", "processing_ms").withColumn("accuracy", kpi.accuracy(F.col("error_rate_cheques"))), f"SELECT bank_code, batch_date, total_cheques, incorrect_fields, error_rate_cheques, flagged, round((1 - error_rate_cheques) * 100, 2) AS accuracy FROM ({FINAL_SQL})")


@REG.query("approve_batches", "SELECT bank_code, batch_date, CASE WHEN hit THEN 'approved' ELSE 'pending_review' END AS status, CASE WHEN hit AND ended IS NULL THEN started_at ELSE ended END AS ended_at FROM (SELECT b.*, CASE WHEN month(b.batch_date) % 2 = 0 THEN b.created_at END AS ended, EXISTS (SELECT 1 FROM v_correction k JOIN v_cheque c ON k.cheque_id = c.cheque_id WHERE c.bank_code = b.bank_code AND c.batch_date = b.batch_date) AS hit FROM v_batch b)")
def approve_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches touched by an export are approved; their end is set only where it is not set yet."""
    touched = REG.queries["affected_batches"](s, d).withColumn("hit", F.lit(True))
    b = view(s, d, "v_batch").withColumn("ended", F.when(F.month("batch_date") % 2 == 0, F.col("created_at"))).join(touched, ["bank_code", "batch_date"], "left")
    return b.select("bank_code", "batch_date", F.when(F.col("hit"), "approved").otherwise("pending_review").alias("status"), F.when(F.col("hit") & F.col("ended").isNull(), F.col("started_at")).otherwise(F.col("ended")).alias("ended_at"))


REG.add("uniqueness_audit", lambda s, d: kpi.duplicate_keys(view(s, d, "v_field"), ["cheque_id", "name"]).withColumn("key", F.lit("field")).unionByName(kpi.duplicate_keys(view(s, d, "v_cheque"), ["cheque_id"]).withColumns({"name": F.lit(""), "key": F.lit("cheque")})), "SELECT cheque_id, name, count(*) AS copies, 'field' AS key FROM v_field GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT cheque_id, '' AS name, count(*) AS copies, 'cheque' AS key FROM v_cheque GROUP BY 1 HAVING count(*) > 1")
REG.add("persist_fields", lambda s, d: audit.field_rows(docs(s, d)).filter("name <> 'name'").select("cheque_id", "name", "parse_norm", F.round("field_conf", 3).cast("decimal(5,3)").alias("field_conf"), F.lit(False).alias("corrected")), "SELECT f.cheque_id, name, parse_norm, CAST(round(field_conf, 3) AS DECIMAL(5,3)) AS field_conf, FALSE AS corrected FROM v_full f JOIN v_cheque c ON f.cheque_id = c.cheque_id WHERE name <> 'name'")
REG.add(
    "field_eval_report", lambda s, d: view(s, d, "v_full").select("cheque_id", F.col("name").alias("field"), route.three_places(F.col("loc_conf")).alias("loc_conf"), route.three_places(F.col("ocr_conf")).alias("ocr_conf"), route.three_places(F.col("field_conf")).alias("field_conf"), "ocr_text", F.coalesce("parse_norm", F.lit("")).alias("parse_norm"), F.lower(F.col("parse_ok").cast("string")).alias("parse_ok"), F.lower((F.round("field_conf", 6) >= THRESHOLD).cast("string")).alias("meets_threshold")),
    f"SELECT cheque_id, name AS field, {_C3('loc_conf')} AS loc_conf, {_C3('ocr_conf')} AS ocr_conf, {_C3('field_conf')} AS field_conf, ocr_text, coalesce(parse_norm, '') AS parse_norm, lower(parse_ok::VARCHAR) AS parse_ok, lower((round(field_conf, 6) >= {THRESHOLD})::VARCHAR) AS meets_threshold FROM v_full",
)
