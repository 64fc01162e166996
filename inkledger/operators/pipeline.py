"""From the lines of a page to its audit document: locate, choose, apply the bank's rules, parse, score, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as txt
from inkledger.functions.geometry import WIDTH, padded
from inkledger.functions.parse import once
from inkledger.functions.validate import REQUIRED
from inkledger.operators import audit, bank_rules, extract, page, route

BOX = ["x1", "y1", "x2", "y2"]
#: Fields whose lines are ranked by what they hold.
RANKED = ("date", "amount_numeric", "cheque_number")


def chosen(wide: float = 0.12) -> Column:
    """``located`` with its boxes as they are read, and of the English lines in each the one that suits the field best, nothing if that
    does not suit. The box of the cheque number reaches further right, as numbers run out of it; the bank's name is the bank."""

    def of(f: Column) -> Column:
        x2 = F.when(f["name"] == "cheque_number", F.least(F.lit(WIDTH - 1), f["x2"] + int(wide * WIDTH))).otherwise(f["x2"])
        rank = lambda x: F.coalesce(*(F.when(f["name"] == n, x[f"rank_{n}"]) for n in RANKED), F.lit(0))
        inside = lambda x: x["english"] & x["px"].between(f["x1"], x2) & x["py"].between(f["y1"], f["y2"])
        best = page.greatest(inside, lambda x: F.struct((-rank(x)).alias("fit"), x["confidence"], (-x["line_idx"]).alias("i"), x["text"], x["lang"]))
        return once(F.when(f["name"] != "bank_name", best), lambda w: read(f, x2, w))

    def read(f: Column, x2: Column, w: Column) -> Column:
        own, fits = f["name"] == "bank_name", (w["fit"] == 0) | ((f["name"] == "amount_numeric") & (w["fit"] == -1))
        value = lambda bank, c, none: F.when(own, bank).otherwise(F.coalesce(F.when(fits, c), none))
        return F.struct(
            f["name"].alias("name"), f["confidence"].alias("loc_conf"), f["x1"].alias("x1"), f["y1"].alias("y1"), x2.alias("x2"), f["y2"].alias("y2"),
            value(F.col("bank_code"), w["text"], F.lit("")).alias("text"), value(F.lit(1.0), w["confidence"], F.lit(0.0)).alias("ocr_conf"), value(F.lit("en"), w["lang"], F.lit("")).alias("lang"),
        )

    return F.transform("located", of)


def steps_in() -> Column:
    """Whether a rule's finding replaces the text chosen so far."""
    t, bank, name = F.col("text"), F.col("bank_code"), F.col("name")
    short, digits = F.length(F.trim(t)) < 3, t.rlike(r"\d")
    noisy = F.when(bank == "NBE", txt.payee_noisy(t)).otherwise(short | t.rlike("[A-Za-z]") | digits) | t.contains(bank_rules.BRANCH)
    number = F.when(bank == "FABMISR", txt.micr_like(t, ":", 16) | ~t.rlike(bank_rules.FAB_NUMBER)).otherwise(True)
    amount = ~t.rlike(txt.AMOUNT_DECIMAL) | ((bank == "FABMISR") & txt.amount_noise(t))
    payee = F.when(F.col("r_source").endswith("_label"), short).otherwise(noisy)
    return F.when(name == "cheque_number", number).when(name == "date", ~t.rlike(txt.DATE_LOOSE)).when(name == "amount_numeric", amount).when(name == "name", payee).otherwise(False)


def tidied(text: Column) -> Column:
    """A number in its bank's form, where the text holds one."""
    bank, plain = F.col("bank_code"), F.regexp_replace(text, r"\s+", "")
    run = lambda s, n: F.nullif(F.regexp_extract(s, rf"(?<!\d)\d{{{n}}}(?!\d)", 0), F.lit(""))
    own = (
        F.when(bank == "CIB", extract.tail_cib(text)).when(bank == "NBE", F.coalesce(run(plain, 14), txt.digit_join(text, (7, 7)))).when(bank == "BANQUE_MISR", F.coalesce(run(text, 8), F.lit("")))
        .when(bank == "AAIB", run(plain, 9)).otherwise(F.nullif(F.regexp_extract(plain, txt.NUMBER, 0), F.lit("")))
    )
    return F.when((F.col("name") == "cheque_number") & (text != ""), F.coalesce(own, text)).otherwise(text)


def after_rules(rows: DataFrame) -> DataFrame:
    """The chosen texts after the bank's rules (r_source, r_token, r_conf, r_box; NULL where none found anything). One bank's number comes
    from its rules alone; another's amount has decimals or is empty. Where a rule of a kind that looks at lines wins, its line's
    box, padded by 2 %, replaces the field's."""
    alone = (F.col("bank_code") == "BANQUE_MISR") & (F.col("name") == "cheque_number")
    found = F.col("r_token").isNotNull() & steps_in()
    t = F.when(found, F.col("r_token")).when(alone, "").otherwise(F.col("text"))
    c = F.when(found & ~alone, F.greatest("ocr_conf", "r_conf")).when(alone, F.coalesce("r_conf", F.lit(0.0))).otherwise(F.col("ocr_conf"))
    lang = F.when(found, F.when(F.col("name") == "name", "ar").otherwise("en")).when(alone, "").otherwise(F.col("lang"))
    clear = (F.col("bank_code") == "NBE") & (F.col("name") == "amount_numeric") & ~t.rlike(txt.AMOUNT_DECIMAL)
    moved = found & F.col("r_source").isin(*bank_rules.BOXED) & F.col("r_box").isNotNull()
    box = [F.when(moved, side).otherwise(F.col(n)).alias(n) for n, side in zip(BOX, padded(*(F.col("r_box")[n] for n in BOX), 0.02, 0.02), strict=True)]
    return rows.select(
        "doc_id", "bank_code", "name", "loc_conf", *box, F.when(clear, "").otherwise(tidied(t)).alias("text"), F.when(clear, 0.0).otherwise(c).alias("ocr_conf"), F.when(clear, "").otherwise(lang).alias("ocr_lang"),
        F.when(found & (F.col("name") == "cheque_number"), F.col("r_source")).alias("source"),
    )


def extract_fields(lines: DataFrame, fields: DataFrame, anchors: DataFrame) -> DataFrame:
    """One record for every document and field of its bank's template: doc_id, bank_code, box, confidences, texts, parsed values. lines
    may carry their polygons (bbox: an array of (x, y)).

    A document's lines meet once, as a page; locating, choosing and the rules of all banks work on it, and the records of a
    document stay in its partition. Documents without a template have no records; lines without text or place are never chosen."""
    ranks = {f"rank_{n}": extract.preference(F.lit(n), F.col("text"), True) for n in RANKED}
    rows = extract.with_templates(page.pages(lines, bank_rules.features() | ranks), fields, anchors).filter("fields is not null")
    rows = extract.locate_on_pages(rows)
    boxes = lambda name: F.transform(F.filter("located", lambda f: f["name"] == name), lambda f: F.struct(*(f[n] for n in BOX)))
    rows = bank_rules.found(rows.withColumns({"zones": boxes("amount_numeric"), "payee_box": F.get(boxes("name"), F.lit(0))}))
    rows = page.exploded(rows, chosen(), "doc_id", "bank_code", "rules")
    rows = rows.select("doc_id", "bank_code", "f.*", F.get(F.filter("rules", lambda r: r["name"] == F.col("f.name")), F.lit(0))["w"].alias("w"))
    ready = after_rules(rows.select("*", F.col("w.source").alias("r_source"), F.col("w.token").alias("r_token"), F.col("w.confidence").alias("r_conf"), F.col("w.box").alias("r_box")).drop("w"))
    return extract.field_records(ready, True, ["bank_code", "ocr_conf", "loc_conf", "ocr_lang", "source", *BOX])


def decisions(records: DataFrame) -> DataFrame:
    """doc_id and its route. records: those of extract_fields. One hash aggregate of plain numbers; names pass through Arrow
    before it, which hides that a document's records are together, so the partial maxima are exchanged."""
    per = records.groupBy("doc_id").agg(*(F.max(F.when(F.col("name") == f, F.col("field_conf"))).alias(f) for f in REQUIRED))
    rows = per.select("doc_id", *(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("conf"), route.threshold_code(F.col(f)).alias("code"))).alias(f) for f in REQUIRED))
    return route.judged(rows, key="doc_id")


def audit_documents(records: DataFrame, decided: DataFrame, source: str = "upload") -> DataFrame:
    """Audit documents of the extracted records: bank, file, decision, fields, meta."""
    none = F.lit(None).cast("string")
    full = records.select("doc_id", "name", "field_conf", "loc_conf", "ocr_conf", "parse_ok", "parse_norm", F.nullif("ocr_text", F.lit("")).alias("ocr_text"), F.nullif("ocr_lang", F.lit("")).alias("ocr_lang"), "meets_threshold", F.struct(F.col("meets_threshold").alias("ok"), none.alias("code")).alias("validation"), F.array(*BOX).alias("bbox"), "source")
    banks = records.groupBy("doc_id").agg(F.first("bank_code").alias("bank"))
    words = lambda c: F.filter(F.split(c, ";"), lambda w: w != "")
    decision = F.struct("decision", "stp", "overall_conf", words(F.col("low_conf_fields")).alias("low_conf_fields"), words(F.col("reasons")).alias("reasons"))
    docs = audit.field_map(full, "doc_id").join(banks, "doc_id").join(decided.select("doc_id", decision.alias("decision")), "doc_id")
    return docs.select(F.lit(1).alias("schema_version"), "bank", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".jpg")).alias("file"), "decision", "fields", F.struct(F.lit(source).alias("source")).alias("meta"))
