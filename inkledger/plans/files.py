"""Queries of sources, sinks and streams: data derived from the tables is written, read back or streamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger import schemas
from inkledger.functions.text import sanitize_key
from inkledger.operators import audit, extract
from inkledger.plans.domain import TEMPLATE_BANKS, Registry, table, view
from inkledger.plans.tables import KPI_IN, docs
from inkledger.sources import fold, layout, readers, work, writers
from inkledger.streaming import jobs

REG = Registry()
#: Text that a query writes and reads back is compressed; a file is no larger than what one task writes, so it need not be split.
CODEC = "gzip"


@REG.query("scan_audit", "SELECT bank_code AS bank_dir, bank_code AS bank, file_id AS file, decision, stp, count(f.name) AS n_fields FROM v_cheque c LEFT JOIN v_full f ON c.cheque_id = f.cheque_id GROUP BY ALL")
def scan_audit(s: SparkSession, d: str) -> DataFrame:
    path = work.folder(s, "audit")
    writers.write_audit(docs(s, d).drop("cheque_id").withColumn("generated_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("created_at"), path, compression=CODEC)
    return readers.scan_audit(s, path).select("bank_dir", "bank", "file", "decision.decision", "decision.stp", F.size("fields").cast("long").alias("n_fields"))


@REG.query("scan_ocr_lines", "SELECT bank_code AS bank, doc_id::VARCHAR AS file, line_idx, text, confidence, px::DOUBLE AS px, py::DOUBLE AS py FROM v_token WHERE doc_id % 11 <> 0")
def scan_ocr_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents in three layouts; every eleventh has no size."""
    kind, none = F.col("doc_id") % 3, F.lit(None).cast("array<double>")
    place = F.array(F.col("px").cast("double"), F.col("py").cast("double"))
    rect = F.array(F.col("px") - 10.0, F.col("py") - 4.0, F.col("px") + 10.0, F.col("py") + 4.0)
    line = F.struct("line_idx", "text", "confidence", "lang", F.when(kind == 0, place).alias("center"), F.when(kind == 1, F.array(F.col("px") / 1677, F.col("py") / 677)).alias("pos_norm"), F.when(kind == 2, rect).otherwise(none).alias("bbox_rect"))
    pages = view(s, d, "v_token").groupBy("doc_id", "bank_code").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sized = F.col("doc_id") % 11 != 0
    pages = pages.select(F.col("bank_code").alias("bank"), F.col("doc_id").cast("string").alias("file"), F.when(sized & (kind < 2), F.struct(F.lit(677).alias("height"), F.lit(1677).alias("width"))).alias("image_metadata"), F.when(sized, 677).alias("image_height"), F.when(sized, 1677).alias("image_width"), F.when(kind != 1, F.col("lines")).alias("lines"), F.when(kind == 1, F.col("lines")).alias("raw_ocr_results"))
    path = work.folder(s, "ocr")
    pages.write.json(path, compression=CODEC)
    lines, _ = readers.scan_ocr_lines(s, path)
    return lines.select("bank", "file", F.col("line_idx").cast("long").alias("line_idx"), "text", "confidence", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@REG.query("scan_field_csv", "SELECT cheque_id::VARCHAR AS file, name AS field, CASE WHEN cheque_id % 5 = 0 THEN 0.0 ELSE round(ocr_conf, 6) END AS ocr_conf, parse_ok FROM v_one WHERE cheque_id % 7 <> 0")
def scan_field_csv(s: SparkSession, d: str) -> DataFrame:
    one = view(s, d, "v_one").join(view(s, d, "v_cheque").select("cheque_id", F.col("bank_code").alias("bank")), "cheque_id", "left")
    text = lambda c: F.lit(c).cast("string")
    rows = one.select(F.when(F.col("cheque_id") % 7 != 0, F.col("cheque_id").cast("string")).alias("file"), "bank", F.col("name").alias("field"), text("m").alias("method"), F.col("loc_conf").cast("string").alias("loc_conf"), "ocr_text", F.when(F.col("cheque_id") % 5 == 0, "n/a").otherwise(F.col("ocr_conf").cast("string")).alias("ocr_conf"), text("en").alias("ocr_lang"), text("").alias("parse_norm"), F.when(F.col("parse_ok"), " TRUE ").otherwise("no").alias("parse_ok"), text("0").alias("field_conf"), text("false").alias("meets_threshold"), *(text("0").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")))
    path = work.folder(s, "fields")
    rows.write.option("header", True).csv(path, compression=CODEC)
    return readers.scan_field_csv(s, path).select("file", "field", F.round("ocr_conf", 6).alias("ocr_conf"), "parse_ok")


def log_rows(s: SparkSession, d: str) -> DataFrame:
    k = view(s, d, "v_correction").join(view(s, d, "v_cheque"), "cheque_id")
    return k.select(F.col("bank_code").alias("bank"), F.col("file_id").alias("file"), "field", F.lit("x, \"y\"").alias("before"), "after", F.lit(None).cast("string").alias("reason"), "reviewer_id", F.date_format("made_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


LOG_SQL = """SELECT bank_code AS bank, file_id AS file, field, 'x, "y"' AS before, after, reviewer_id, strftime(made_at, '%Y-%m-%dT%H:%M:%S') AS logged FROM v_correction k JOIN v_cheque c ON k.cheque_id = c.cheque_id"""


@REG.query("scan_corrections", LOG_SQL)
def scan_corrections(s: SparkSession, d: str) -> DataFrame:
    path = work.folder(s, "log")
    rows = log_rows(s, d)
    for part in range(2):
        writers.append_corrections(rows.filter(F.abs(F.hash("after")) % 2 == part), path)
    return readers.scan_corrections(s, path).select("bank", "file", "field", "before", "after", "reviewer_id", F.col("at").alias("logged"))


#: Parts of a bank's audit directory in the query of the fold.
SHARDS = 4


def audit_fold_files(s: SparkSession, d: str) -> DataFrame:
    """Corrections folded into an audit directory in place: those of every other reviewer, the others, and these once more."""
    path = work.folder(s, "audit-fold")
    writers.write_audit(docs(s, d).drop("cheque_id", "created_at"), path, shards=SHARDS, compression=CODEC)
    k = view(s, d, "v_correction").join(view(s, d, "v_cheque").select("cheque_id", F.col("bank_code").alias("bank"), F.col("file_id").alias("file")), "cheque_id")
    at = F.concat(F.date_format("made_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.format_string(" %019d", "correction_id"))
    rows = k.select("bank", "file", "field", "after", F.lit(None).cast("string").alias("reason"), "reviewer_id", at.alias("at"))
    for part in (0, 1, 1):
        fold.fold_audit(s, path, rows.filter(F.col("reviewer_id").cast("int") % 2 == part), SHARDS, CODEC)
    text = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"]["parse_norm"], F.lit(""))))
    history = F.transform(F.coalesce("corrections", F.array().cast(f"array<{schemas.CORRECTION}>")), lambda c: F.concat_ws("|", c["field"], F.coalesce(c["before"], F.lit("-")), c["after"]))
    return readers.scan_audit(s, path).select("bank_dir", "file", F.size(history).cast("long").alias("n_corrections"), F.array_join(history, ";").alias("history"), F.array_join(text, ";").alias("fields"))


REG.add(
    "audit_fold_files", audit_fold_files,
    """WITH f AS (SELECT x.cheque_id, name, parse_norm FROM v_full x JOIN v_cheque c ON x.cheque_id = c.cheque_id),
 k AS (SELECT v.cheque_id, field, after, parse_norm, reviewer_id::INT % 2 AS part, made_at, correction_id, lag(after) OVER w AS earlier, row_number() OVER w AS nth FROM v_correction v JOIN f ON v.cheque_id = f.cheque_id AND v.field = f.name
  WINDOW w AS (PARTITION BY v.cheque_id, field ORDER BY reviewer_id::INT % 2, made_at, correction_id)),
 h AS (SELECT cheque_id, count(*) AS n, string_agg(concat(field, '|', coalesce(CASE WHEN nth = 1 THEN parse_norm ELSE earlier END, '-'), '|', after), ';' ORDER BY part, made_at, correction_id) AS history FROM k GROUP BY 1),
 l AS (SELECT cheque_id, field, arg_max(after, nth) AS after FROM k GROUP BY 1, 2),
 v AS (SELECT f.cheque_id, string_agg(concat(name, '=', coalesce(l.after, parse_norm, '')), ';' ORDER BY name) AS fields FROM f LEFT JOIN l ON f.cheque_id = l.cheque_id AND f.name = l.field GROUP BY 1)
SELECT bank_code AS bank_dir, file_id AS file, coalesce(n, 0) AS n_corrections, coalesce(history, '') AS history, coalesce(fields, '') AS fields FROM v_cheque c LEFT JOIN h ON c.cheque_id = h.cheque_id LEFT JOIN v ON c.cheque_id = v.cheque_id""",
)


#: Buckets of the stored tables in the query of corrected fields.
BUCKETS = 8


def stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cheques (by month as well), fields and corrections as tables in buckets by cheque."""
    put = lambda rows, name, by=None: layout.store(rows, layout.new_name(name), "cheque_id", BUCKETS, by)
    cheques = view(s, d, "v_cheque").select("*", layout.month())
    return put(cheques, "cheques", "month"), put(view(s, d, "v_full"), "fields"), put(view(s, d, "v_correction"), "corrections")


@REG.query("stored_corrections", "SELECT c.cheque_id, c.bank_code, c.batch_date, f.name, coalesce(l.after, f.parse_norm) AS value, coalesce(l.n, 0) AS n_corrections FROM v_cheque c JOIN v_full f ON c.cheque_id = f.cheque_id LEFT JOIN (SELECT cheque_id, field, arg_max(after, struct_pack(a := made_at, b := correction_id)) AS after, count(*) AS n FROM v_correction GROUP BY 1, 2) l ON f.cheque_id = l.cheque_id AND f.name = l.field WHERE c.batch_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'")
def stored_corrections(s: SparkSession, d: str) -> DataFrame:
    """Current values of the fields of a range of batches, over stored tables: no exchange but those that stored them."""
    cheques, fields, corrections = stored(s, d)
    return audit.values_between(cheques, fields, corrections, "1994-01-01", "1995-06-30")


@REG.query("template_rules", f"SELECT bank_code AS bank_id, name, count(*) AS lines FROM v_tfield f JOIN (SELECT bank_code AS b FROM v_token) t ON t.b = f.bank_code WHERE bank_code IN ({', '.join(repr(b) for b in TEMPLATE_BANKS)}) GROUP BY 1, 2")
def template_rules(s: SparkSession, d: str) -> DataFrame:
    """Templates written and read as documents; how many lines each field rule meets. Banks without a template meet none."""
    f = view(s, d, "v_tfield")
    share = lambda a, b, c, e: F.array(F.col(a) / 1677, F.col(b) / 677, (F.col(c) - F.col(a)) / 1677, (F.col(e) - F.col(b)) / 677)
    rule = F.struct("pos", "name", share("rx1", "ry1", "rx2", "ry2").alias("roi_norm"), share("x1", "y1", "x2", "y2").alias("region_norm"), "pattern")
    path = work.folder(s, "templates")
    f.groupBy(F.col("bank_code").alias("bank_id")).agg(F.array_sort(F.collect_list(rule)).alias("fields")).withColumn("template_id", F.lit("default")).write.json(path, compression=CODEC)
    rules, _ = readers.scan_templates(s, path)
    per_bank = view(s, d, "v_token").groupBy(F.col("bank_code").alias("bank_id")).agg(F.count("*").alias("lines"))
    return rules.join(per_bank, "bank_id").select("bank_id", "name", "lines")


LOCATED_SQL = "SELECT doc_id::VARCHAR AS file, bank_code AS bank, name, method, text, px::BIGINT AS x1 FROM (SELECT t.*, f.name, 'region_regex' AS method, row_number() OVER (PARTITION BY doc_id, f.name ORDER BY confidence DESC, line_idx) AS nth FROM v_token t JOIN v_tfield f ON t.bank_code = f.bank_code WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AND regexp_matches(text, pattern)) WHERE nth = 1"


@REG.query("scan_located", LOCATED_SQL)
def scan_located(s: SparkSession, d: str) -> DataFrame:
    """Locator results, one document for each page with a map of its fields, written and read back."""
    lines = view(s, d, "v_token")
    hits = extract.locate_pattern(lines, view(s, d, "v_tfield")).join(lines.groupBy("doc_id").agg(F.first("bank_code").alias("bank")), "doc_id")
    record = F.struct(F.array("px", "py", F.col("px") + 335, F.col("py") + 54).alias("bbox"), "confidence", "method", "text")
    path = work.folder(s, "located")
    hits.groupBy("bank", F.col("doc_id").cast("string").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("name", record))).alias("results")).write.json(path, compression=CODEC)
    return readers.scan_located(s, path).select("bank", "file", "name", "method", "text", F.col("bbox")[0].cast("long").alias("x1"))


@REG.query("scan_spans", "SELECT concat('u', user_id::VARCHAR) AS image, event_type AS name, round(value, 6) AS dur, (event_id % 3)::BIGINT AS parent FROM events")
def scan_spans(s: SparkSession, d: str) -> DataFrame:
    """Profiles, one document for each user with its spans, written and read back."""
    span = F.struct(F.col("event_type").alias("name"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("value").alias("dur"), (F.col("event_id") % 3).cast("int").alias("parent"))
    path = work.folder(s, "spans")
    table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(span), lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).otherwise(0)).alias("spans")).select(F.create_map(F.lit("image"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("meta"), "spans").write.json(path, compression=CODEC)
    return readers.scan_spans(s, path).select(F.col("meta")["image"].alias("image"), "name", F.round("dur", 6).alias("dur"), F.col("parent").cast("long").alias("parent"))


# ---------------------------------------------------------------- streams
#: Files of a slice of the events, and so of a micro-batch; slices.
FILES, SLICES = 4, 4


def slices(rows: DataFrame) -> list[DataFrame]:
    """The rows in order of their time, in equal spans."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    nth = F.least(F.lit(SLICES - 1), F.floor((at - F.lit(low)) * SLICES / F.lit(max(1, high - low + 1)))) if low is not None else F.lit(0)
    return [rows.filter(F.coalesce(nth, F.lit(0)) == i) for i in range(SLICES)]


def events(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of several micro-batches: they are laid down in the order of their time, a slice after the other."""
    rows, path = table(s, d, "events"), work.folder(s, "events")
    for part in slices(rows):
        part.repartition(FILES).write.mode("append").parquet(path)
    return jobs.stream_of(s, path, rows.schema, FILES)


def field_of() -> Column:
    return F.when(F.col("event_type") == "click", "date").when(F.col("event_type") == "view", "cheque_number").when(F.col("event_type") == "purchase", "amount_numeric").when(F.col("event_type") == "signup", "name").otherwise("bank_name")


REG.add(
    "stream_kpi", lambda s, d: jobs.refresh_kpis(events(s, d).select(F.col("user_id").alias("cheque_id"), field_of().alias("field")), view(s, d, "v_cheque"), view(s, d, "v_field"), work.folder(s, "stream-kpi")),
    f"""WITH k AS (SELECT DISTINCT cheque_id AS kc, field FROM v_correction), t AS (SELECT DISTINCT bank_code AS tb, batch_date AS td FROM k JOIN v_cheque ON kc = cheque_id), o AS (SELECT v_cheque.* FROM v_cheque JOIN t ON bank_code = tb AND batch_date = td),
 f AS (SELECT v_field.cheque_id AS fc, name, corrected OR k.field IS NOT NULL AS bad FROM v_field LEFT JOIN k ON v_field.cheque_id = kc AND v_field.name = k.field WHERE name IN {KPI_IN})
SELECT bank_code, batch_date, count(DISTINCT cheque_id) AS total_cheques, count(DISTINCT CASE WHEN bad THEN cheque_id END) AS cheques_with_errors, count(name) AS total_fields, count(CASE WHEN bad THEN 1 END) AS incorrect_fields,
 round(count(DISTINCT CASE WHEN bad THEN cheque_id END) / count(DISTINCT cheque_id), 4) AS error_rate_cheques, round(count(CASE WHEN bad THEN 1 END) / nullif(count(name), 0), 4) AS error_rate_fields, count(DISTINCT CASE WHEN bad THEN cheque_id END) / count(DISTINCT cheque_id) > 0.8 AS flagged
FROM o LEFT JOIN f ON cheque_id = fc GROUP BY 1, 2""",
)


def uploads(rows: DataFrame) -> DataFrame:
    bank = F.element_at(F.array(*map(F.lit, ["QNB", "FABMISR", "CIB", "AAIB", "NBE"])), (F.col("user_id") % 5 + 1).cast("int"))
    return rows.select(bank.alias("bank"), sanitize_key(F.concat(F.lit("s/"), F.col("user_id").cast("string"))).alias("key"), F.col("ts").cast("timestamp").alias("ts"))


REG.add(
    "stream_sessions", lambda s, d: jobs.stream_sessions(uploads(events(s, d)), uploads(table(s, d, "events")), work.folder(s, "stream-sessions")),
    """WITH e AS (SELECT CASE user_id % 5 WHEN 0 THEN 'QNB' WHEN 1 THEN 'FABMISR' WHEN 2 THEN 'CIB' WHEN 3 THEN 'AAIB' ELSE 'NBE' END AS bank, concat('s', user_id) AS key, ts::TIMESTAMP AS t FROM events),
 n AS (SELECT *, CASE WHEN t - lag(t) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY bank, key ORDER BY t)), g AS (SELECT *, sum(new) OVER (PARTITION BY bank, key ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM n)
SELECT bank, key, min(t) AS started_at, max(t) AS ended_at, count(*) AS uploads, epoch_us(max(t)) // 1000 - epoch_us(min(t)) // 1000 AS processing_ms FROM g GROUP BY bank, key, grp""",
)


def session_events(rows: DataFrame) -> DataFrame:
    """Uploads and, as every signup, requests to finalize; uploads without a key are sessions of their own."""
    bank = F.element_at(F.array(*map(F.lit, ["QNB", "FABMISR", "CIB", "AAIB", "NBE"])), (F.col("user_id") % 5 + 1).cast("int"))
    key = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("event:"), F.col("event_id").cast("string"))).otherwise(sanitize_key(F.concat(F.lit("s/"), F.col("user_id").cast("string"))))
    return rows.select(bank.alias("bank"), key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "signup").alias("final"))


REG.add(
    "stream_batches", lambda s, d: jobs.assign_batches(session_events(events(s, d)), work.folder(s, "stream-batches")),
    """WITH e AS (SELECT bank, CASE WHEN correlation_id = '' THEN concat('event:', s.event_id::VARCHAR) ELSE replace(correlation_id, '/', '') END AS key, s.ts::TIMESTAMP AS t, s.event_id, event_type = 'signup' AS final FROM v_session s JOIN (SELECT event_id AS e_id, event_type FROM events) k ON event_id = e_id),
 o AS (SELECT bank, key, min(t) AS first_ts, arg_min(event_id, t) AS first_event, count(*) AS uploads FROM e WHERE NOT final GROUP BY 1, 2),
 n AS (SELECT *, CAST(timezone('Africa/Cairo', timezone('UTC', first_ts)) AS DATE) AS batch_date FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY bank, batch_date ORDER BY first_ts, first_event) AS seq FROM n),
 f AS (SELECT e.bank, e.key, min(t) AS ended_at FROM e JOIN o ON e.bank = o.bank AND e.key = o.key WHERE final AND t >= first_ts GROUP BY 1, 2)
SELECT q.bank, batch_date, seq, concat(strftime(batch_date, '%d_%m_%Y'), '_', q.bank, '_', CASE WHEN seq < 10 THEN concat('0', seq) ELSE seq::VARCHAR END) AS batch_name, uploads, first_ts AS started_at, ended_at, epoch_us(ended_at) // 1000 - epoch_us(first_ts) // 1000 AS processing_ms FROM q LEFT JOIN f ON q.bank = f.bank AND q.key = f.key""",
)
REG.add("stream_ingest", lambda s, d: jobs.ingest_once(events(s, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), work.folder(s, "stream-ingest"), ["user_id", "event_type"], "2 days").select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")
def stream_audit(s: SparkSession, d: str) -> DataFrame:
    """An audit directory that grows by snapshots of its documents, followed as a stream: the last version of each."""
    path = work.folder(s, "audit-stream")
    for part in slices(table(s, d, "events")):
        docs = part.groupBy(F.col("event_type").alias("bank"), F.col("user_id").cast("string").alias("file")).agg(F.max_by("props", "event_id").alias("correlation_id"))
        writers.write_audit(docs.withColumn("schema_version", F.lit(1)).repartition(FILES, "bank"), path, compression=CODEC)
    last = jobs.latest_documents(readers.stream_audit(s, path, files_per_batch=FILES), work.folder(s, "stream-audit"), every=2)
    return last.select("bank", "file", F.col("payload.correlation_id").alias("payload"))


REG.add(
    "stream_audit", stream_audit,
    f"""WITH t AS (SELECT *, epoch_us(ts::TIMESTAMP) AS us FROM events), n AS (SELECT *, least({SLICES - 1}, floor((us - min(us) OVER ()) * {SLICES} / greatest(1, max(us) OVER () - min(us) OVER () + 1))) AS slice FROM t)
SELECT bank, file, payload FROM (SELECT event_type AS bank, user_id::VARCHAR AS file, props AS payload, row_number() OVER (PARTITION BY event_type, user_id ORDER BY slice DESC, event_id DESC) AS nth FROM n) WHERE nth = 1""",
)
REG.add(
    "stream_corrections", lambda s, d: jobs.append_log(events(s, d).select("event_id", F.col("user_id").alias("cheque_id"), field_of().alias("field")), work.folder(s, "stream-log")),
    "SELECT correction_id AS event_id, cheque_id, field FROM v_correction",
)
