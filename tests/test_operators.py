"""Small goldens of rates, routing, audit documents, extraction, sinks and sources."""

import difflib
import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkledger.operators import audit, bank_rules, extract, kpi, match, pipeline, reports, route
from inkledger.plans import extraction
from inkledger.sources import readers, writers


def batch_of(spark, corrected):
    cheques = spark.createDataFrame([(i, "QNB", date(2025, 1, 1)) for i in range(5)], "cheque_id long, bank_code string, batch_date date")
    fields = spark.createDataFrame([(i, f, f == "date" and i < corrected) for i in range(5) for f in ("date", "cheque_number", "amount_numeric", "name")], "cheque_id long, name string, corrected boolean")
    return kpi.kpi_batch(cheques, fields).first()


def test_batch_flag(spark):
    four, five = batch_of(spark, 4), batch_of(spark, 5)
    assert (four.error_rate_cheques, four.flagged, four.total_fields) == (0.8, False, 15)
    assert (five.error_rate_cheques, five.flagged) == (1.0, True)


def test_bank_rates_ignore_muted_field(spark):
    cheques = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "cheque_id long, bank_code string")
    fields = spark.createDataFrame([(1, "date"), (1, "name"), (2, "date")], "cheque_id long, name string")
    fixes = spark.createDataFrame([(1, "name"), (2, "date"), (2, "date")], "cheque_id long, field string")
    got = {r.bank_code: r for r in kpi.kpi_bank(cheques, fields, fixes).collect()}
    assert (got["A"].total_cheques, got["A"].cheques_with_errors, got["A"].total_fields, got["A"].incorrect_fields) == (2, 1, 2, 1)
    assert got["B"].error_rate_fields == 0.0


def test_routing(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "cheque_id long")
    rows = [(1, f, 1.0, "OK") for f in ("date", "amount_numeric", "cheque_number", "name")] + [(2, "date", 0.9365, None), (2, "amount_numeric", 1.0, "AMOUNT_RANGE"), (2, "cheque_number", 1.0, None), (2, "name", 1.0, None)]
    got = {r.cheque_id: r for r in route.route(keys, spark.createDataFrame(rows, "cheque_id long, name string, conf double, code string")).collect()}
    assert (got[1].decision, got[1].stp, got[1].reasons) == ("auto_approve", True, "")
    assert got[2].low_conf_fields == "date" and got[2].reasons.split(";")[1] == "validation_failed:amount_numeric:AMOUNT_RANGE"
    assert got[3].overall_conf == 0.0 and got[3].low_conf_fields.count(";") == 3


def test_corrections_fold_in_order(spark):
    cheques = spark.createDataFrame([(1, "A", "f", "review", False, None)], "cheque_id long, bank_code string, file_id string, decision string, stp boolean, created_at timestamp")
    fields = spark.createDataFrame([(1, "date", "t", "n", 1.0, True, True)], "cheque_id long, name string, ocr_text string, parse_norm string, field_conf double, parse_ok boolean, valid boolean")
    fixes = spark.createDataFrame([(2, 1, "date", "b", "r"), (1, 1, "date", "a", "r"), (3, 1, "none", "x", "r")], "correction_id long, cheque_id long, field string, after string, reviewer_id string").withColumn("made_at", F.lit("2025-01-01").cast("timestamp"))
    doc = audit.fold_corrections(audit.documents(cheques, fields), fixes).first()
    assert [(c.before, c.after) for c in doc.corrections] == [("n", "a"), ("a", "b")]
    assert doc.fields["date"].parse_norm == "b"
    assert audit.documents(cheques, fields.limit(0)).first().fields == {}


LINES = "doc_id long, bank_code string, line_idx long, text string, px int, py int, confidence double, lang string"


def test_later_anchor_rule_wins_and_first_line_wins_ties(spark):
    lines = spark.createDataFrame([(1, "A", 0, "Date", 10, 10, 0.9, "en"), (1, "A", 1, "date", 20, 10, 0.9, "en"), (1, "A", 2, "DATE:", 900, 10, 0.5, "en")], LINES)
    rules = spark.createDataFrame([("A", 0, "d", 0, 0, 100, 100, "(?i)date"), ("A", 1, "d", 800, 0, 1000, 100, "(?i)date")], "bank_code string, pos int, name string, x1 int, y1 int, x2 int, y2 int, pattern string")
    assert extract.anchors(lines, rules).first().line_idx == 2
    assert extract.anchors(lines, rules.filter("pos = 0")).first().line_idx == 0


def page(spark, bank, *lines):
    """Lines of documents: (doc, text, x, y, confidence) with x and y in shares of the page; Arabic text is Arabic."""
    rows = []
    for i, (doc, text, x, y, conf) in enumerate(lines):
        rows.append((doc, bank, i, text, int(x * 1677), int(y * 677), conf, "ar" if any("\u0600" <= c <= "\u06ff" for c in text) else "en"))
    return spark.createDataFrame(rows, LINES)


def tokens(rows):
    return {r.doc_id: (r.token, r.source) for r in rows.collect()}


def test_number_of_the_label_row_and_bands(spark):
    lines = page(
        spark, "BANQUE_MISR", (1, "CHEQUE", 0.2, 0.1, 0.9), (1, "12345678", 0.4, 0.15, 0.9), (1, "87654321", 0.3, 0.4, 0.84), (2, "CHEQUE", 0.2, 0.1, 0.9), (2, "12345678", 0.4, 0.15, 0.9), (2, "87654321", 0.3, 0.4, 0.87),
        (3, "شيك", 0.7, 0.1, 0.9), (3, "11112222", 0.5, 0.12, 0.9), (4, "12345678", 0.8, 0.4, 0.9), (4, "1234 5678", 0.4, 0.4, 0.9), (5, "12345678 123456", 0.4, 0.4, 0.9), (6, "12345678", 0.4, 0.2, 0.7),
    )
    none = spark.createDataFrame([], "doc_id long, x1 int, y1 int, x2 int, y2 int")
    got = tokens(bank_rules.number_bm(lines, none))
    assert got == {1: ("12345678", "bm_label_row"), 2: ("87654321", "bm_fullband_mid"), 3: ("11112222", "bm_label_row_ar"), 4: ("12345678", "bm_global_8"), 6: ("12345678", "bm_fullband")}
    box = spark.createDataFrame([(6, 600, 100, 700, 160)], none.schema)
    assert 6 not in tokens(bank_rules.number_bm(lines, box))


def test_numbers_of_other_banks(spark):
    nbe = page(spark, "NBE", (1, "CHEQUE", 0.1, 0.1, 0.9), (1, "1234567 - 7654321", 0.3, 0.1, 0.8), (2, "11112222333344", 0.5, 0.9, 0.6), (3, "CHEQUE", 0.1, 0.1, 0.9), (3, "11112222333344", 0.3, 0.1, 0.7), (3, "55556666777788", 0.3, 0.9, 0.8))
    assert tokens(bank_rules.number_nbe(nbe)) == {1: ("12345677654321", "nbe_preselect_cheque"), 2: ("11112222333344", "nbe_final_full_image"), 3: ("55556666777788", "nbe_preselect_cheque")}
    aaib = page(spark, "AAIB", (1, "909006500", 0.3, 0.1, 0.99), (1, "123456789", 0.3, 0.5, 0.8), (1, "944123456", 0.9, 0.5, 0.7), (2, "Cheque No.", 0.1, 0.5, 0.9), (2, "123456789", 0.3, 0.5, 0.6), (2, "987654321", 0.3, 0.7, 0.7))
    assert tokens(bank_rules.number_aaib(aaib)) == {1: ("944123456", "aaib_fullimage"), 2: ("123456789", "aaib_fullimage")}
    fab = page(spark, "FABMISR", (1, "12345678", 0.1, 0.1, 0.9), (1, "44139123", 0.1, 0.1, 0.5), (2, "12345678", 0.1, 0.1, 0.4), (2, "87654321", 0.1, 0.1, 0.9), (3, "A 12345678", 0.1, 0.1, 0.9))
    assert {k: v[0] for k, v in tokens(bank_rules.number_fab(fab)).items()} == {1: "44139123", 2: "12345678"}
    cib = page(spark, "CIB", (1, "CHEQUE", 0.2, 0.5, 0.9), (1, "شيك", 0.8, 0.5, 0.9), (1, "123456789012", 0.5, 0.6, 0.7), (1, "999999999999", 0.1, 0.6, 0.99), (2, "123456789012", 0.1, 0.6, 0.5), (2, "1234567", 0.5, 0.1, 0.9), (3, "1234567", 0.5, 0.1, 0.9))
    assert tokens(bank_rules.number_cib(cib)) == {1: ("123456789012", "bm_preselect_band"), 2: ("123456789012", "bm_final_full_image"), 3: ("1234567", "fallback_candidates")}


def test_dates_amounts_payees(spark):
    aaib = page(spark, "AAIB", (1, "05/JuV/2024", 0.6, 0.2, 0.5), (1, "06/Jan/2024", 0.2, 0.2, 0.9), (2, "Date", 0.1, 0.7, 0.9), (2, "07/Feb/2024", 0.3, 0.7, 0.5), (2, "08/Mar/2024", 0.3, 0.9, 0.9))
    assert tokens(bank_rules.date_rules(aaib)) == {1: ("05/Jul/2024", "aaib_date_region"), 2: ("07/Feb/2024", "aaib_date_label")}
    nbe = page(spark, "NBE", (1, "05/lan/2024", 0.6, 0.2, 0.5), (1, "1,234.50", 0.7, 0.4, 0.6), (1, "9,999.00", 0.2, 0.4, 0.99), (1, "شركة فرع", 0.3, 0.35, 0.9), (1, "شركة النيل", 0.3, 0.35, 0.7))
    assert tokens(bank_rules.date_rules(nbe)) == {1: ("05/Jan/2024", "nbe_date_global")} and tokens(bank_rules.amount_rules(nbe)) == {1: ("1,234.50", "nbe_amount_dec_band")}
    box = spark.createDataFrame([(1, 400, 200, 700, 300)], "doc_id long, x1 int, y1 int, x2 int, y2 int")
    assert tokens(bank_rules.payee_rules(nbe, box)) == {1: ("شركة النيل", "nbe_name_roi")}


def test_repaired_date_must_still_be_one(spark, monkeypatch):
    """A stage whose date is none any more after the repair gives way to the next, which keeps its name; without a next it stays."""
    monkeypatch.setattr(bank_rules.txt, "REPAIR_A", [("XXX", "Month")])
    aaib = page(spark, "AAIB", (1, "05/XXX/2024", 0.6, 0.2, 0.5), (1, "06/Jan/2024", 0.2, 0.2, 0.9), (2, "05/XXX/2024", 0.6, 0.2, 0.5))
    assert tokens(bank_rules.date_rules(aaib)) == {1: ("06/Jan/2024", "aaib_date_region"), 2: ("05/Month/2024", "aaib_date_region")}


def boxed_page(spark, bank, *lines):
    """Lines with a polygon of the given half width and height around their place."""
    x, y = F.col("px").cast("double"), F.col("py").cast("double")
    corners = [F.struct((x + i * 40.6).alias("x"), (y + j * 9.7).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return page(spark, bank, *lines).withColumn("bbox", F.array(*corners))


def test_box_of_the_winning_line(spark):
    """A rule's line replaces the field's box, padded by 2 % and kept on the page; rules of other kinds, and lines without a
    polygon, leave it."""
    fields = spark.createDataFrame([("FABMISR", 0, "cheque_number", 10, 10, 100, 50, 10, 10, 100, 50, None), ("NBE", 0, "cheque_number", 10, 10, 100, 50, 10, 10, 100, 50, None)], "bank_code string, pos int, name string, rx1 int, ry1 int, rx2 int, ry2 int, x1 int, y1 int, x2 int, y2 int, pattern string")
    anchors = spark.createDataFrame([("NBE", 0, "x", 0, 0, 1, 1, "y")], "bank_code string, pos int, name string, x1 int, y1 int, x2 int, y2 int, pattern string")
    nbe = ("NBE", (1, "11112222333344", 0.5, 0.9, 0.6), (2, "11112222333344", 0.01, 0.01, 0.6))
    box = lambda r: (r.source, r.x1, r.y1, r.x2, r.y2)
    got = {r.doc_id: box(r) for r in pipeline.extract_fields(boxed_page(spark, *nbe), fields, anchors).collect()}
    assert got == {1: ("nbe_final_full_image", 797 - 33, 599 - 13, 878 + 33, 618 + 13), 2: ("nbe_final_full_image", 0, 0, 56 + 33, 15 + 13)}
    plain = {r.doc_id: box(r) for r in pipeline.extract_fields(page(spark, *nbe), fields, anchors).collect()}
    assert plain == {d: ("nbe_final_full_image", 10, 10, 100 + 201, 50) for d in (1, 2)}
    fab = pipeline.extract_fields(boxed_page(spark, "FABMISR", (1, "44139123", 0.5, 0.5, 0.9)), fields, anchors).first()
    assert box(fab) == ("fabmisr_cheque_clean", 10, 10, 301, 50) and fab.ocr_text == "44139123"


def test_pages_of_odd_lines(spark):
    """Null texts, places, banks and confidences, repeated lines, documents without a template, no lines at all."""
    fields = spark.createDataFrame([("CIB", 0, "date", 0, 0, 1600, 600, 0, 0, 1600, 600, "[0-9]{2}/"), ("CIB", 1, "bank_name", 0, 0, 9, 9, 0, 0, 9, 9, None)], "bank_code string, pos int, name string, rx1 int, ry1 int, rx2 int, ry2 int, x1 int, y1 int, x2 int, y2 int, pattern string")
    anchors = spark.createDataFrame([], "bank_code string, pos int, name string, x1 int, y1 int, x2 int, y2 int, pattern string")
    rows = [(1, "CIB", 0, None, 5, 5, 0.9, "en"), (1, "CIB", 1, "05/Jan/2024", None, None, 0.9, "en"), (1, "CIB", 2, "06/Jan/2024", 5, 5, None, "en"), (1, "CIB", 3, "07/Jan/2024", 5, 5, 0.8, "en"), (1, "CIB", 3, "07/Jan/2024", 5, 5, 0.8, "en"), (2, "OTHER", 0, "08/Jan/2024", 5, 5, 0.9, "en"), (3, None, 0, "09/Jan/2024", 5, 5, 0.9, None), (4, "CIB", 0, "", 5, 5, 0.9, None)]
    lines = spark.createDataFrame(rows, LINES)
    got = {(r.doc_id, r.name): (r.ocr_text, r.parse_norm) for r in pipeline.extract_fields(lines, fields, anchors).collect()}
    assert got == {(1, "date"): ("07/Jan/2024", "2024-01-07"), (1, "bank_name"): ("CIB", None), (4, "date"): ("", None), (4, "bank_name"): ("CIB", None)}
    assert pipeline.extract_fields(lines.limit(0), fields, anchors).count() == 0


def test_one_shuffle_serves_all_rules(spark, sf):
    """Shuffles and scans of the whole way from lines to routes, templates included."""
    plan = entry.queries()["extract_pipeline"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8 and plan.count("FileScan") == 1 and "SortAggregate" not in plan


def test_page_to_audit_document(spark, tmp_path):
    """A whole page: the box of the number is widened, the bank's rules step in where the text does not do, one record a field."""
    fields = spark.createDataFrame([("NBE", i, n, *box, *box, None) for i, (n, box) in enumerate((("bank_name", (0, 0, 300, 60)), ("date", (1200, 40, 1600, 120)), ("cheque_number", (600, 40, 700, 100)), ("amount_numeric", (1200, 200, 1600, 300)), ("name", (200, 200, 1100, 300))))], "bank_code string, pos int, name string, rx1 int, ry1 int, rx2 int, ry2 int, x1 int, y1 int, x2 int, y2 int, pattern string")
    anchors = spark.createDataFrame([], "bank_code string, pos int, name string, x1 int, y1 int, x2 int, y2 int, pattern string")
    lines = spark.createDataFrame([(7, "NBE", i, t, x, y, c, "ar" if t[0] > "z" else "en") for i, (t, x, y, c) in enumerate((("11112222333344", 850, 70, 1.0), ("05/lan/2024", 1300, 500, 1.0), ("1,234.50", 1400, 250, 1.0), ("شركة النيل", 600, 250, 1.0)))], LINES)
    records = pipeline.extract_fields(lines, fields, anchors)
    got = {r.name: r for r in records.collect()}
    assert {n: (r.ocr_text, r.parse_norm, r.parse_ok) for n, r in got.items()} == {
        "bank_name": ("NBE", None, False), "date": ("05/Jan/2024", "2024-01-05", True), "cheque_number": ("11112222333344", "11112222333344", True), "amount_numeric": ("1,234.50", "1234.50", True), "name": ("شركة النيل", "شركة النيل", True),
    }
    assert (got["cheque_number"].x2, got["cheque_number"].source, got["bank_name"].ocr_conf) == (901, "nbe_final_full_image", 1.0)
    writers.write_audit(pipeline.audit_documents(records, pipeline.decisions(records)), f"{tmp_path}/a")
    doc = readers.scan_audit(spark, f"{tmp_path}/a").first()
    assert (doc.bank, doc.file, doc.decision.decision, len(doc.fields)) == ("NBE", "00000007.jpg", "review", 5) and doc.fields["date"].loc_conf == 0.9


def test_payee_is_no_line_of_prepositions(spark):
    rules = spark.createDataFrame([("A", 0, "pay_to_label", 0, 0, 1677, 677, "(?i)pay to")], "bank_code string, pos int, name string, x1 int, y1 int, x2 int, y2 int, pattern string")
    lines = spark.createDataFrame([(1, "A", 0, "Pay to", 100, 100, 0.9, "en"), (1, "A", 1, "السيد الى فلان", 400, 100, 0.99, "ar"), (1, "A", 2, "شركه البناء", 500, 110, 0.7, "ar")], LINES)
    at = extract.anchor_points(extract.anchors(lines, rules))
    assert extract.locate_by(lines, at, extract.payee_way()).first().text == "شركه البناء"


def test_names_match_as_by_all_pairs(spark):
    rng, letters = random.Random(5), "aabcdeefgh "
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 24))).strip() or "x" for _ in range(120)]
    other = []
    for n in names:
        c = list(n)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(len(c))] = rng.choice(letters)
        other.append("".join(c)[rng.randint(0, 1) :] or "y")
    got = {r.payee: (r.master, r.ratio) for r in match.best_matches(spark.createDataFrame([(n,) for n in other], "payee string"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "master string, master_pos int")).collect()}
    for n in set(other):
        best = max(((round(difflib.SequenceMatcher(None, n, m).ratio(), 6), -i, m) for i, m in enumerate(names)))
        if best[0] >= 0.85 and len(n) > 1:
            assert got[n] == (best[2], best[0])
        elif best[0] < 0.85:
            assert n not in got


def test_rtl_rows(spark):
    rows = [(1, 0, "b", 100, 50, 20.0), (1, 1, "a", 300, 52, 20.0), (1, 2, "c", 200, 300, 20.0)]
    assert extract.assemble_rtl(spark.createDataFrame(rows, "doc_id long, line_idx long, text string, px int, py int, width double")).first().text == "abc"


def assembled(page_lines):
    """One page line by line: what the fold must give."""
    bands = []
    for line in sorted(page_lines, key=lambda r: (r[3], r[0])):
        home = next((b for b in bands if abs(line[3] - sum(x[3] for x in b) / len(b)) <= 0.05 * 677), None)
        bands.append([line]) if home is None else home.append(line)
    bands.sort(key=lambda b: sum(x[3] for x in b) / len(b))
    row = [x for b in bands for x in sorted(b, key=lambda x: (-x[2], x[0])) if (x[1] or "").strip()]
    left, right = [x[2] - x[4] / 2 for x in row], [x[2] + x[4] / 2 for x in row]
    widths, gaps = sorted(x[4] for x in row if x[4] > 0), [left[i - 1] - right[i] for i in range(1, len(row))]
    limit = max(0.5 * (widths[len(widths) // 2] if widths else 1.0), 1.5 * (sorted(gaps)[len(gaps) // 2] if gaps else 0.0))
    return "".join((" " if i and gaps[i - 1] > limit else "") + x[1].strip() for i, x in enumerate(row))


def test_rtl_fold_is_the_loop(spark, sf):
    """Random pages with ties, blanks and nulls, and the query's own table."""
    rng = random.Random(6)
    pages = {d: [(i, rng.choice(["ab", " c ", "\u00a0d", "", " ", None, "شيك"]), rng.randrange(0, 600, 20), rng.randrange(0, 300, 7), float(rng.choice([0, 11, 30, 55]))) for i in range(rng.randint(1, 25))] for d in range(200)}
    df = spark.createDataFrame([(d, *x) for d, rows in pages.items() for x in rows], "doc_id long, line_idx long, text string, px int, py int, width double").repartition(3)
    assert {r.doc_id: r.text for r in extract.assemble_rtl(df).collect()} == {d: assembled(rows) for d, rows in pages.items()}
    table = {}
    for r in extraction.tok(spark, sf).collect():
        table.setdefault(r.doc_id, []).append((r.line_idx, r.text, r.px, r.py, len(r.text) * 11.0))
    assert {r.doc_id: r.text for r in entry.queries()["rtl_assembly"](spark, sf).collect()} == {d: assembled(rows) for d, rows in table.items()}


def test_no_sorting_for_winners(spark, sf):
    for key in ("best_text", "locate_fields", "rule_bm", "rule_cib"):
        assert "SortAggregate" not in entry.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString(), key


def test_refine_two_samples(spark):
    boxes = spark.createDataFrame([("A", "date", 0, 0, 1677, 677)] * 2, "bank_code string, name string, x1 int, y1 int, x2 int, y2 int")
    assert reports.refine_template(boxes).first().roi_w == 1.0


def test_sinks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("A", "f1", None), ("B", "f2", "x")], "bank string, file string, correlation_id string").withColumn("fields", F.create_map(F.lit("date"), F.struct(F.lit("v").alias("parse_norm"))))
    writers.write_audit(docs, f"{tmp_path}/audit")
    (tmp_path / "audit" / "bank_code=A" / "bad.json").write_text("{not json")
    back = readers.scan_audit(spark, f"{tmp_path}/audit").collect()
    assert sorted((r.bank_dir, r.bank, r.fields["date"].parse_norm) for r in back) == [("A", "A", "v"), ("B", "B", "v")]

    rows = spark.createDataFrame([("B", "d2", "n2", "a2", 2), ("A", "d1", "n1", "a1", 1)], "bank string, date string, cheque_number string, amount_numeric string, pos int")
    writers.write_review(rows, f"{tmp_path}/review", "pos")
    raw = next((tmp_path / "review").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfBank,date,cheque number,amount") and raw.splitlines()[1] == b"A,d1,n1,a1"

    lines = spark.createDataFrame([("A", "f", 677, 1677, 0, "t", 0.5, [1.0, 2.0])], "bank string, file string, height int, width int, line_idx int, text string, confidence double, center array<double>")
    writers.write_ocr_lines(lines, f"{tmp_path}/ocr")
    got, bad = readers.scan_ocr_lines(spark, f"{tmp_path}/ocr")
    assert (got.first().px, got.first().py, bad.count()) == (1.0, 2.0, 0)


def test_templates_and_reports_written(spark, tmp_path):
    boxes = spark.createDataFrame([("A", "date", 10, 10, 110, 50)] * 3, "bank_code string, name string, x1 int, y1 int, x2 int, y2 int")
    writers.write_templates(reports.refine_template(boxes), f"{tmp_path}/t")
    fields, anchors = readers.scan_templates(spark, f"{tmp_path}/t")
    assert fields.first().name == "date" and len(fields.first().roi_norm) == 4 and anchors.count() == 0
    writers.write_report(spark.createDataFrame([("f", ["a", "b"], 0.12345)], "file string, low array<string>, conf double"), f"{tmp_path}/r", ("low",), ("conf",))
    written = [x for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()]
    assert set(written) == {"file,low,conf", "f,a;b,0.123"}
    writers.write_export(spark.createDataFrame([("A", "f", "d", "n", "a", True, 0.5, "more")], "bank string, file string, date string, cheque_number string, amount_numeric string, stp boolean, overall_conf double, other string"), f"{tmp_path}/e")
    written = [x for f in (tmp_path / "e").glob("part-*") for x in f.read_text().splitlines()]
    assert set(written) == {"bank,file,date,cheque_number,amount_numeric,stp,overall_conf", "A,f,d,n,a,true,0.5"}


def test_indented_documents(spark, tmp_path):
    """Files with one indented document each are read as such; read line by line they fail instead of vanishing."""
    box = [0.1, 0.2, 0.3, 0.1]
    put = lambda folder, name, doc: ((tmp_path / folder).mkdir(parents=True, exist_ok=True), (tmp_path / folder / name).write_text(json.dumps(doc, ensure_ascii=False, indent=2)))
    put("audit/NBE", "f1.json", {"schema_version": 1, "bank": "NBE", "file": "f1", "decision": {"decision": "review", "stp": False}, "fields": {"date": {"parse_norm": "2024-01-05", "bbox": [1, 2, 3, 4]}}, "corrections": []})
    put("audit/NBE", "broken.json", {})
    (tmp_path / "audit/NBE/broken.json").write_text("{\n  \"bank\": ")
    put("tpl/NBE", "auto.json", {"bank_id": "NBE", "template_id": "auto", "version": "0.1.0", "fields": [{"name": "date", "roi_norm": box, "region_norm": box, "pattern": "x"}, {"name": "name", "roi_norm": box}], "anchors": [{"name": "date_label", "region_norm": box, "pattern": "(?i)date"}]})
    put("loc", "NBE_f1_loc.json", {"file": "f1", "bank": "NBE", "results": {"date": {"bbox": [1, 2, 3, 4], "confidence": 0.9, "method": "template_roi"}}})
    put("profile", "p.json", {"schema": 1, "generated_at": 1, "meta": {"bank": "NBE"}, "spans": [{"name": "a", "ts": 1.0, "dur": 0.5}, {"name": "b", "ts": 2.0, "dur": 0.1, "parent": 0}]})
    put("ocr", "f1.json", {"bank": "NBE", "file": "f1", "image_height": 677, "image_width": 1677, "raw_ocr_results": [{"text": "t", "confidence": 0.5, "pos": [1, 2]}]})
    one = readers.scan_audit(spark, f"{tmp_path}/audit", True).collect()
    assert [(r.bank_dir, r.file, r.fields["date"].bbox) for r in one] == [("NBE", "f1", [1, 2, 3, 4])]
    fields, anchors = readers.scan_templates(spark, f"{tmp_path}/tpl", True)
    assert [(r.pos, r.name, r.pattern) for r in fields.orderBy("pos").collect()] == [(0, "date", "x"), (1, "name", None)] and anchors.first().pattern == "(?i)date"
    assert readers.scan_located(spark, f"{tmp_path}/loc", True).first().bbox == [1, 2, 3, 4]
    assert [(r.meta["bank"], r.idx, r.name, r.parent) for r in readers.scan_spans(spark, f"{tmp_path}/profile", True).orderBy("idx").collect()] == [("NBE", 0, "a", None), ("NBE", 1, "b", 0)]
    assert readers.scan_ocr_lines(spark, f"{tmp_path}/ocr", True)[0].first().px == 1.0
    for read in (lambda: readers.scan_audit(spark, f"{tmp_path}/audit"), lambda: readers.scan_templates(spark, f"{tmp_path}/tpl")[0], lambda: readers.scan_spans(spark, f"{tmp_path}/profile")):
        with pytest.raises(Exception, match="multi_line"):
            read().collect()
    with pytest.raises(Exception, match="unreadable"):
        readers.scan_audit(spark, f"{tmp_path}/audit", True, strict=True).collect()


def test_results_in_both_layouts(spark):
    poly = [[0, 0], [10, 0], [10, 4], [0, 4]]
    new = json.dumps([{"rec_texts": ["a١", "low"], "rec_scores": [0.9, 0.2], "rec_polys": [poly, poly]}], ensure_ascii=False)
    old = json.dumps([[[poly, ["أحمد", 0.8]], [poly, ["x", 0.1]]]], ensure_ascii=False)
    rows = spark.createDataFrame([(1, "en", new), (2, "ar", old), (3, "en", "[]"), (4, "en", None)], "doc_id long, lang string, results string")
    assert sorted((r.doc_id, r.line_idx, r.text, r.raw_text, r.confidence, r.px, r.py) for r in readers.results_to_lines(rows).collect()) == [(1, 0, "a1", "a١", 0.9, 5.0, 2.0), (2, 0, "احمد", "أحمد", 0.8, 5.0, 2.0)]
