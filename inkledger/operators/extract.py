"""Field extraction over recognised lines: regions, anchors, staged candidates and their winners.

Lines are (doc_id, bank_code, line_idx, text, px, py, confidence, lang); text is taken as cleaned. Rules are small tables joined
on the bank; every other join carries doc_id, so range conditions are residual predicates of hash joins. A winner is an
aggregate (the highest score, the first line on ties), which combines map-side, instead of a window over all candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as txt
from inkledger.functions.geometry import HEIGHT, WIDTH, bbox_around
from inkledger.functions.parse import once, parse_field
from inkledger.functions.validate import THRESHOLD, field_confidence
from inkledger.operators import page

SIDES = ("x1", "y1", "x2", "y2")
LINE = ["line_idx", "text", "px", "py", "confidence"]
# What a payee's line does not hold (labels of sums and payees, the words for cheque, pay, by, this, order and to).
PAYEE_NOT = r"(?i)\bthe\s+sum\s+of\b|\begp\b|pay\s+.*this\s+cheque\s+.*order\s+of|\bagainst\s+this\s+cheque\b|\bpay\s*to\b|\bpayto\b"
PAYEE_NOT_AR = r"(?U)شيك|ادفع|دفع|بموجب|هذا|الشيك|ل\s*أ\s*مر|لا\s*مر|لٱمر|لآمر|\bالى\b|\bالي\b"


def best(rows: DataFrame, keys: list[str], score: Column, keep: list[str] = LINE) -> DataFrame:
    """The row of each key with the highest score; the first line wins ties."""
    top = F.max_by(F.struct(*keep), F.struct(score.alias("s"), (-F.col("line_idx")).alias("i")))
    return rows.groupBy(*keys).agg(top.alias("w")).select(*keys, "w.*")


def inside(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.col("px").between(F.col(x1), F.col(x2)) & F.col("py").between(F.col(y1), F.col(y2))


def lines_in_region(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with every rule of their bank whose rectangle they lie in. The rules (some for each of a fixed list of banks)
    are small; the planner broadcasts them by their size."""
    return lines.join(rules, "bank_code").filter(inside("x1", "y1", "x2", "y2"))


# ---------------------------------------------------------------- choosing a line


def preference(field: Column, text: Column, live: bool) -> Column:
    """How well a line suits a field: lower is better. The live rules prefer decimal amounts and know misread months."""
    if live:
        amount = F.when(text.rlike(txt.AMOUNT_DECIMAL), 0).when(text.rlike(txt.AMOUNT), 1).otherwise(2)
        date = F.when(text.rlike(txt.DATE_LOOSE), 0).otherwise(1)
    else:
        amount = F.when(text.rlike(txt.AMOUNT_PLAIN), 0).otherwise(1)
        date = F.when(text.rlike(txt.DATE_STRICT), 0).otherwise(1)
    number = F.when(text.rlike(txt.NUMBER), 0).otherwise(1)
    return F.when(field == "amount_numeric", amount).when(field == "date", date).when(field == "cheque_number", number).otherwise(0)


def best_text(lines: DataFrame, fields: list[str], live: bool) -> DataFrame:
    """doc_id, name and the chosen line of every document and field. A page's lines are ranked for all fields at once, without a
    row for each line and field and without sorting."""
    ranks = {f"rank_{i}": preference(F.lit(f), F.col("text"), live) for i, f in enumerate(fields)}

    def pick(i: int, f: str) -> Column:
        chosen = page.greatest(lambda x: F.lit(True), lambda x: F.struct((-x[f"rank_{i}"]).alias("r"), x["confidence"].alias("c"), (-x["line_idx"]).alias("i"), *(x[k].alias(k) for k in (*LINE, "lang"))))
        return once(chosen, lambda w: F.struct(F.lit(f).alias("name"), *(w[k].alias(k) for k in (*LINE, "lang")), (-w["r"]).alias("rank")))

    rows = page.pages(lines, ranks)
    return page.exploded(rows, F.array(*(pick(i, f) for i, f in enumerate(fields))), "doc_id").select("doc_id", "f.*")


def accepted(chosen: DataFrame) -> DataFrame:
    """Keeps a chosen text only if it suits its field; else the result is empty."""
    fits = (F.col("rank") == 0) | ((F.col("name") == "amount_numeric") & (F.col("rank") == 1))
    return chosen.select("doc_id", "name", F.when(fits, F.col("text")).otherwise("").alias("text"), F.when(fits, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(fits, F.col("lang")).otherwise("").alias("lang"))


# ---------------------------------------------------------------- locating


def anchors(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, name and place of each anchor: of rules with one name the last that matches anything, its most confident line."""
    hits = lines_in_region(lines, rules).filter(F.rlike("text", F.col("pattern")))
    return best(hits, ["doc_id", "name"], F.struct(F.col("pos").alias("p"), F.col("confidence").alias("c")))


def anchor_points(found: DataFrame) -> DataFrame:
    """doc_id, at: a map from anchor name to its point."""
    return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("px", "py")))).alias("at"))


def _located(rows: DataFrame, stage: int, method: str) -> DataFrame:
    return rows.select("doc_id", "name", F.lit(stage).alias("stage"), "line_idx", "text", "px", "py", F.col("confidence").alias("score"), "confidence", F.lit(method).alias("method"))


def locate_pattern(lines: DataFrame, fields: DataFrame) -> DataFrame:
    hits = lines_in_region(lines, fields.filter("pattern is not null")).filter(F.rlike("text", F.col("pattern")))
    return _located(best(hits, ["doc_id", "name"], F.col("confidence")), 2, "region_regex")


def pixel(share: Column, full: int) -> Column:
    return F.least(F.lit(full), F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * full)).cast("int")


#: A way to find a field: field, stage, method, when a line (joined with its document's anchors) is a candidate, its score.
Way = tuple[str, int, str, Column, Column]


#: Where a way finds a line's columns and its document's anchors: in the row, or in a page's line and columns.
Get = Callable[[str], Column]


def anchor_of_row(name: str) -> Column:
    return F.col("at")[name]


def right_of_label(name: str, anchor: str, pattern: str, wide: float, up: float, high: float, method: str, c: Get, at_: Get) -> Way:
    """Lines of a pattern in a rectangle to the right of an anchor, given in shares of the page and rounded as regions are."""
    at = at_(anchor)
    x, y = F.least(F.lit(1.0), at["px"] / WIDTH), F.greatest(F.lit(0.0), (at["py"] - up * HEIGHT) / HEIGHT)
    w = F.least(F.lit(wide), 1.0 - at["px"] / WIDTH)
    inside_x = c("px").between(pixel(x, WIDTH), F.rint((x + w) * WIDTH).cast("int"))
    inside_y = c("py").between(pixel(y, HEIGHT), F.least(F.lit(HEIGHT), F.rint((y + high) * HEIGHT).cast("int")))
    return name, 3, method, inside_x & inside_y & c("text").rlike(pattern), c("confidence")


def date_way(c: Get = F.col, at: Get = anchor_of_row) -> Way:
    return right_of_label("date", "date_label", txt.DATE_ANCHOR, 0.35, 0.10, 0.22, "anchor_date_right", c, at)


def amount_way(c: Get = F.col, at: Get = anchor_of_row) -> Way:
    return right_of_label("amount_numeric", "egp_label", txt.AMOUNT_PLAIN, 0.40, 0.10, 0.25, "anchor_egp_right", c, at)


def payee_way(c: Get = F.col, at: Get = anchor_of_row) -> Way:
    """Best line beside the pay-to anchors: between both, right of the one, left of the other. Score: confidence, less
    distance from the anchors' row, plus cues of a company name, less shortness and distance from the middle."""
    en, ar, total = at("pay_to_label"), at("pay_to_label_ar"), at("sum_label")
    both = en.isNotNull() & ar.isNotNull()
    margin = int(0.02 * WIDTH)
    row = F.when(both, F.floor((en["py"] + ar["py"]) / 2)).otherwise(F.coalesce(en["py"], ar["py"]))
    left = F.when(both, F.least(en["px"], ar["px"]) + margin).when(en.isNotNull(), en["px"] + margin + 1).otherwise(0)
    right = F.when(both, F.greatest(en["px"], ar["px"]) - margin).when(en.isNotNull(), WIDTH).otherwise(ar["px"] - margin - 1)
    top = F.greatest(F.lit(0), row - F.when(both, int(0.10 * HEIGHT)).otherwise(int(0.08 * HEIGHT)))
    high = F.when(both, int(0.22 * HEIGHT)).otherwise(int(0.20 * HEIGHT))
    t, n = c("text"), F.length(c("text"))
    arabic = F.length(F.regexp_replace(t, "[^\u0600-\u06ff]", ""))
    label = t.rlike(PAYEE_NOT) | t.rlike(PAYEE_NOT_AR)
    place = c("px").between(left, right) & c("py").between(top, top + high) & (total["py"].isNull() | (c("py") <= total["py"] - int(0.02 * HEIGHT)))
    shape = (c("confidence") >= 0.6) & ~label & (txt.digit_ratio(t) <= 0.3) & ((arabic >= 6) | ((arabic == 0) & (n >= 6)))
    score = c("confidence") - 0.6 * F.abs(c("py") - row) / HEIGHT + F.when(arabic > 0, 0.1).otherwise(0.0) + F.when(t.rlike("شركة|شركه"), 0.2).otherwise(0.0)
    score = score + F.when(t.rlike(r"(?i)\bcompany\b|\bco\.?\b"), 0.1).otherwise(0.0) - F.when(n < 10, 0.2).otherwise(0.0) - F.when(both, 0.4 * F.abs(c("px") - (left + right) / 2) / WIDTH).otherwise(0.0)
    return "name", 1, "anchor_payee_scored", (en.isNotNull() | ar.isNotNull()) & place & shape, score


def cheque_way(c: Get = F.col, at: Get = anchor_of_row, fixed: tuple[str, ...] = ("BANQUE_MISR", "CIB", "AAIB")) -> Way:
    """Best number between the cheque labels, or beside the one there is. Banks with a fixed place are left to their region.
    Score: confidence, plus half the share of digits over 0.6, less 0.3 for each digit away from the bank's length."""
    en, ar = at("cheque_label"), at("cheque_label_ar")
    both, margin, up = en.isNotNull() & ar.isNotNull(), int(0.02 * WIDTH), int(0.06 * HEIGHT)
    middle = F.floor((en["py"] + ar["py"]) / 2)
    top = F.when(both, F.least(F.greatest(F.lit(0), middle - up), F.lit(int(0.40 * HEIGHT)))).otherwise(F.greatest(F.lit(0), F.coalesce(en["py"], ar["py"]) - up))
    left = F.when(both, F.least(en["px"], ar["px"]) + margin).when(en.isNotNull(), en["px"]).otherwise(0)
    right = F.when(both, F.greatest(en["px"], ar["px"]) - margin).when(en.isNotNull(), F.least(F.lit(WIDTH), en["px"] + int(0.45 * WIDTH))).otherwise(F.least(ar["px"], F.lit(int(0.48 * WIDTH))))
    t = c("text")
    long = F.regexp_extract_all(t, F.lit(r"(\d{10,16})"), 1)
    groups = F.when(F.size(long) > 0, long).otherwise(F.regexp_extract_all(t, F.lit(r"(\d{6,})"), 1))
    target = F.when(c("bank_code") == "NBE", 14).otherwise(12)
    away = F.array_min(F.transform(groups, lambda g: F.abs(F.length(g) - target)))
    share = F.length(txt.digits_of(t)) / F.greatest(F.length(F.regexp_replace(t, r"\s+", "")), F.lit(1))
    place = ~c("bank_code").isin(*fixed) & (en.isNotNull() | ar.isNotNull()) & c("px").between(left, right) & c("py").between(top, top + int(0.14 * HEIGHT))
    return "cheque_number", 1, "anchor_cheque_band", place & ~t.rlike('[A-Za-z:"]') & (F.size(groups) > 0), c("confidence") + 0.5 * F.greatest(F.lit(0.0), share - 0.6) - 0.3 * away


def too_low(name: Column, line: Column) -> Column:
    """A number beside a label counts in the upper 55 % of the page only."""
    return (name == "cheque_number") & (line["py"] > int(0.55 * HEIGHT))


def locate_by(lines: DataFrame, points: DataFrame, way: Way) -> DataFrame:
    """The best line of one way."""
    name, stage, method, when, score = way
    found = best(lines.join(points, "doc_id").filter(when), ["doc_id"], score).withColumn("name", F.lit(name))
    return _located(found.filter(~too_low(F.col("name"), F.struct("py"))) if stage == 1 else found, stage, method)


def locate_fallback(documents: DataFrame, fields: DataFrame, located: DataFrame) -> DataFrame:
    """The template's own rectangle for every field that nothing located. documents: doc_id, bank_code."""
    roi = documents.join(fields.select("bank_code", "name", "rx1", "ry1", "rx2", "ry2"), "bank_code")
    return roi.join(located.select("doc_id", "name"), ["doc_id", "name"], "left_anti").select("doc_id", "name", "rx1", "ry1", "rx2", "ry2", F.lit(0.9).alias("confidence"), F.lit("template_roi").alias("method"))


#: Share of the page a located field's box takes, by method.
BOX = {"region_regex": (0.20, 0.08), "anchor_date_right": (0.20, 0.08), "anchor_cheque_band": (0.20, 0.08), "anchor_egp_right": (0.22, 0.10), "anchor_payee_scored": (0.45, 0.10)}


def with_templates(pages: DataFrame, fields: DataFrame, anchor_rules: DataFrame) -> DataFrame:
    """Pages with the fields and anchor rules of their bank's template, NULL without one. Templates (a few rows for each of a fixed list
    of banks) are small; the planner broadcasts them by their size."""
    for name, rules, columns in (("fields", fields, ["name", "rx1", "ry1", "rx2", "ry2", "x1", "y1", "x2", "y2", "pattern"]), ("anchors", anchor_rules, ["name", "x1", "y1", "x2", "y2", "pattern"])):
        per_bank = rules.groupBy("bank_code").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias(name))
        pages = pages.join(per_bank, "bank_code", "left")
    return pages


def locate_on_pages(pages: DataFrame) -> DataFrame:
    """Pages (with their templates) with ``located``: for each field of the template name, method, confidence, text and box, from the first
    of the ways that finds it. A line meets its bank's patterns within their rectangles only."""
    hit = lambda x, r: x["px"].between(r["x1"], r["x2"]) & x["py"].between(r["y1"], r["y2"]) & F.rlike(x["text"], r["pattern"])
    seen = lambda r: F.transform(F.filter("lines", lambda x: hit(x, r)), lambda x: F.struct(r["pos"], x["confidence"], (-x["line_idx"]).alias("i"), r["name"], x["px"], x["py"]))
    rows = pages.select("*", F.flatten(F.transform("anchors", seen)).alias("_hits"))
    points = ("pay_to_label", "pay_to_label_ar", "sum_label", "cheque_label", "cheque_label_ar", "date_label", "egp_label")
    called = lambda n: lambda h: h["name"] == n
    rows = rows.select("*", *(F.array_max(F.filter("_hits", called(n))).alias(f"_at_{n}") for n in points))

    def way(make: Callable[[Get, Get], Way], *anchors: str) -> tuple[str, int, Column]:
        kind: list[tuple[str, int]] = []

        def of(x: Column) -> Column:
            name, stage, method, when, score = make(lambda n: F.col(n) if n == "bank_code" else x[n], lambda n: F.col(f"_at_{n}"))
            kind.append((name, stage))
            return F.when(when, candidate(x, score, method))

        # a page without the way's anchors has no candidates, so its lines are not looked at
        found = F.when(F.coalesce(*(F.col(f"_at_{n}.px") for n in anchors)).isNotNull(), F.array_max(F.transform("lines", of)))
        return *kind[0], found

    def candidate(x: Column, score: Column, method: str) -> Column:
        return F.struct(score.cast("double").alias("score"), (-x["line_idx"]).alias("i"), F.lit(method).alias("method"), x["text"].alias("text"), x["px"].alias("px"), x["py"].alias("py"), x["confidence"].alias("confidence"))

    ways = [way(payee_way, "pay_to_label", "pay_to_label_ar"), way(cheque_way, "cheque_label", "cheque_label_ar"), way(date_way, "date_label"), way(amount_way, "egp_label")]
    rows = rows.select("*", *(w.alias(f"_way_{n}_{stage}") for n, stage, w in ways))
    of_name = lambda f, stage: F.coalesce(*(F.when(f["name"] == n, F.col(f"_way_{n}_{stage}")) for n, own, _ in ways if own == stage))

    def one(f: Column) -> Column:
        labelled = of_name(f, 1)
        by_rule = F.when(f["pattern"].isNotNull(), page.greatest(lambda x: hit(x, f), lambda x: candidate(x, x["confidence"], "region_regex")))
        return once(F.coalesce(F.when(~too_low(f["name"], labelled), labelled), by_rule, of_name(f, 3)), lambda w: boxed(f, w))

    def boxed(f: Column, w: Column) -> Column:
        box = [F.coalesce(*(F.when(w["method"] == m, bbox_around(w["px"], w["py"], wide, high)[i]) for m, (wide, high) in BOX.items()), f[f"r{side}"]).cast("int").alias(side) for i, side in enumerate(SIDES)]
        return F.struct(f["name"].alias("name"), F.coalesce(w["method"], F.lit("template_roi")).alias("method"), F.coalesce(w["confidence"], F.lit(0.9)).alias("confidence"), w["text"].alias("text"), *box)

    return rows.select(*pages.columns, F.transform("fields", one).alias("located"))


def locate_fields(lines: DataFrame, fields: DataFrame, anchor_rules: DataFrame) -> DataFrame:
    """doc_id, name, method, confidence, text and box of every template field, from the first of the ways that finds it; all on the
    document's page, so lines are shuffled once."""
    rows = locate_on_pages(with_templates(page.pages(lines, {}), fields, anchor_rules))
    return page.exploded(rows, "located", "doc_id").select("doc_id", "f.*")


def without_template(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Lines of documents whose bank has no template. The table of templates is small; the planner broadcasts it by its size."""
    return lines.join(fields.select("bank_code").distinct(), "bank_code", "left_anti")


def locate_unknown(lines: DataFrame) -> DataFrame:
    """Fields of documents without a template: three by pattern, the payee by score, the bank unknown."""
    t, n = F.col("text"), F.length("text")
    picks = [("date", txt.DATE_UNKNOWN), ("amount_numeric", txt.AMOUNT_PLAIN), ("cheque_number", txt.NUMBER)]
    payee = txt.has_arabic(t) & ~t.rlike(r"(?i)\b(pay\s*to|against\s+this\s+cheque|date|egp)\b") & ~t.rlike("شيك|ادفع|بموجب|هذا") & (txt.digit_ratio(t) <= 0.2)
    score = F.col("confidence") + 0.2 - 0.3 * F.abs(F.col("py") - 0.35 * HEIGHT) / HEIGHT - 0.2 * F.abs(F.col("px") - 0.55 * WIDTH) / WIDTH + 0.1 * F.least(F.lit(1.0), n / 20.0)
    kinds = F.array_compact(F.array(*(F.when(t.rlike(p), F.struct(F.lit(f).alias("name"), F.col("confidence").alias("score"))) for f, p in picks), F.when(payee, F.struct(F.lit("name").alias("name"), score.alias("score")))))
    rows = lines.withColumn("k", F.explode(kinds)).select("*", "k.name", "k.score").drop("k")
    found = best(rows, ["doc_id", "name"], F.col("score")).select("doc_id", "name", "text", "confidence", F.when(F.col("name") == "name", "unknown_payee").otherwise("unknown_regex").alias("method"))
    bank = lines.select("doc_id").distinct().select("doc_id", F.lit("bank_name").alias("name"), F.lit("UNKNOWN").alias("text"), F.lit(0.5).alias("confidence"), F.lit("unknown_bank").alias("method"))
    return found.unionByName(bank)


# ---------------------------------------------------------------- neighbours


def beside_label(lines: DataFrame, label: str, pattern: str, near: float, weight: float) -> DataFrame:
    """Lines of a pattern in the row of a label and right of it, with score = confidence - weight * distance."""
    labels = lines.filter(F.col("text").rlike(label)).select("doc_id", F.col("px").alias("lx"), F.col("py").alias("ly"))
    rows = lines.filter(F.col("text").rlike(pattern)).join(labels, "doc_id").filter((F.abs(F.col("py") - F.col("ly")) <= near * HEIGHT) & (F.col("px") >= F.col("lx")))
    return rows.withColumn("score", F.col("confidence") - weight * (F.col("px") - F.col("lx")) / (0.5 * WIDTH))


def outside_boxes(lines: DataFrame, boxes: DataFrame, wide: float = 0.06, high: float = 0.05) -> DataFrame:
    """Lines that lie in no padded box of their document. boxes: doc_id, x1, y1, x2, y2."""
    pad_x, pad_y = int(wide * WIDTH), int(high * HEIGHT)
    b = boxes.select(F.col("doc_id").alias("_d"), F.greatest(F.lit(0), F.col("x1") - pad_x).alias("_x1"), F.greatest(F.lit(0), F.col("y1") - pad_y).alias("_y1"), F.least(F.lit(WIDTH - 1), F.col("x2") + pad_x).alias("_x2"), F.least(F.lit(HEIGHT - 1), F.col("y2") + pad_y).alias("_y2"))
    return lines.join(b, (F.col("doc_id") == F.col("_d")) & inside("_x1", "_y1", "_x2", "_y2"), "left_anti")


def near_label(lines: DataFrame, label: str = txt.NO_LABEL) -> DataFrame:
    """All lines with a flag: a label lies in the row, from 10 % of the width right of the line to 40 % left of it."""
    labels = lines.filter(F.col("text").rlike(label)).select("doc_id", F.col("px").alias("nx"), F.col("py").alias("ny"))
    hit = (F.abs(F.col("ny") - F.col("py")) <= 0.05 * HEIGHT) & F.col("px").between(F.col("nx") - 0.10 * WIDTH, F.col("nx") + 0.40 * WIDTH)
    near = lines.select("doc_id", "line_idx", "px", "py").join(labels, "doc_id").filter(hit).select("doc_id", "line_idx", F.lit(True).alias("near")).distinct()
    return lines.join(near, ["doc_id", "line_idx"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


# ---------------------------------------------------------------- ranked numbers


def cib_rank(lines: DataFrame) -> DataFrame:
    """Numbers of six or more digits ranked: no label near, upper half, length near 12, near the middle, confidence."""
    rows = near_label(lines).withColumn("token", F.nullif(F.regexp_extract("text", txt.NUMBER, 0), F.lit(""))).filter("token is not null")
    centre = F.round(F.abs(F.col("px") - 0.5 * WIDTH) / (0.5 * WIDTH), 9)
    key = F.struct(F.when(F.col("near") | F.col("text").rlike(txt.NO_LABEL), 1).otherwise(0).alias("a"), F.when(F.col("py") <= 0.45 * HEIGHT, 0).otherwise(1).alias("b"), F.abs(F.length("token") - 12).alias("c"), centre.alias("d"), (-F.col("confidence")).alias("e"), F.col("line_idx").alias("f"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("line_idx", "token", "confidence", "px", "py"), key).alias("w")).select("doc_id", "w.*")


def tail_cib(text: Column) -> Column:
    """The first group of twelve digits, else of ten to thirteen the one nearest to twelve (the longer on ties), else the text."""
    groups = F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(r"(\d+)"), 1)
    twelve = F.get(F.filter(groups, lambda g: F.length(g) == 12), F.lit(0))
    ranked = F.array_sort(F.transform(F.filter(groups, lambda g: F.length(g).between(10, 13)), lambda g, i: F.struct(F.abs(F.length(g) - 12).alias("d"), (-F.length(g)).alias("l"), i.alias("i"), g.alias("g"))))
    return F.coalesce(twelve, F.get(ranked, F.lit(0))["g"], text)


# ---------------------------------------------------------------- records


def field_records(chosen: DataFrame, names: bool = False, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Parsed and scored records. chosen: doc_id, name, text, ocr_conf, loc_conf. A field is valid when it meets the threshold."""
    parsed = chosen.withColumn("p", parse_field(F.col("name"), F.col("text"), names))
    conf = F.round(field_confidence(F.col("ocr_conf"), F.col("loc_conf"), F.col("p.ok")), 6)
    return parsed.select("doc_id", *keep, "name", F.col("text").alias("ocr_text"), F.col("p.norm").alias("parse_norm"), F.col("p.ok").alias("parse_ok"), conf.alias("field_conf"), (conf >= THRESHOLD).alias("meets_threshold"))


ROW_NEAR = 0.05 * HEIGHT


def banded(lines: Column) -> Column:
    """Lines (in order of py) with their bands: a line joins the first band whose mean so far is near, else it opens one. Gives bands
    (sum of py, lines) and rows (band, line)."""
    none = F.struct(F.array().cast("array<struct<sum:double,n:int>>").alias("bands"), F.array().cast("array<struct<band:int,line:struct<py:double,line_idx:bigint,px:double,width:double,text:string>>>").alias("rows"))

    def add(acc: Column, x: Column) -> Column:
        near = F.array_position(F.transform(acc["bands"], lambda b: F.abs(x["py"] - b["sum"] / b["n"]) <= ROW_NEAR), True).cast("int")
        return once(F.when(near > 0, near).otherwise(F.size(acc["bands"]) + 1), lambda band: joined(acc, x, band))

    def joined(acc: Column, x: Column, band: Column) -> Column:
        own = F.struct(x["py"].alias("sum"), F.lit(1).alias("n"))
        grown = F.transform(acc["bands"], lambda b, i: F.when(i + 1 == band, F.struct((b["sum"] + x["py"]).alias("sum"), (b["n"] + 1).alias("n"))).otherwise(b))
        bands = F.when(band > F.size(acc["bands"]), F.array_append(acc["bands"], own)).otherwise(grown)
        return F.struct(bands.alias("bands"), F.array_append(acc["rows"], F.struct(band.alias("band"), x.alias("line"))).alias("rows"))

    return F.aggregate(lines, none, add)


def middle(values: Column, none: float) -> Column:
    """The upper median."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(none))


def spaced(row: Column) -> Column:
    """The texts of fragments in reading order, with a space where the gap to the one before is wide for this page."""
    rest = F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
    gaps = F.zip_with(F.slice(row, 1, F.greatest(F.size(row) - 1, F.lit(0))), rest, lambda a, b: (a["px"] - a["width"] / 2) - (b["px"] + b["width"] / 2))
    widths = F.filter(F.transform(row, lambda x: x["width"]), lambda w: w > 0)
    limit = F.greatest(0.5 * middle(widths, 1.0), 1.5 * middle(gaps, 0.0))
    text = lambda m: F.concat(F.get(row, F.lit(0))["text"], F.array_join(F.zip_with(m["gaps"], rest, lambda g, x: F.concat(F.when(g > m["limit"], " ").otherwise(""), x["text"])), ""))
    return F.when(F.size(row) > 0, once(F.struct(gaps.alias("gaps"), limit.alias("limit")), text)).otherwise("")


def assemble_rtl(lines: DataFrame) -> DataFrame:
    """doc_id, text: fragments put together right to left within rows, rows top to bottom. Rows are banded greedily against the mean of
    the band so far, which depends on all lines before: a fold over the page's sorted lines, all in built-in functions. lines:
    doc_id, line_idx, text, px, py, width. Blank and null texts take a place in their band and are not written; a page of these
    only is ''. Ties go by line_idx."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    line = F.struct(F.col("py").cast("double").alias("py"), F.col("line_idx").cast("long").alias("line_idx"), F.col("px").cast("double").alias("px"), F.col("width").cast("double").alias("width"), bare.alias("text"))
    folded = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).select("doc_id", banded(F.col("lines")).alias("f"))
    mean = lambda band: once(F.get("f.bands", band - 1), lambda b: b["sum"] / b["n"])
    place = lambda r: F.struct(mean(r["band"]).alias("mean"), r["band"].alias("band"), (-r["line"]["px"]).alias("right"), r["line"]["line_idx"].alias("i"), r["line"]["px"].alias("px"), r["line"]["width"].alias("width"), r["line"]["text"].alias("text"))
    rows = folded.select("doc_id", F.filter(F.array_sort(F.transform("f.rows", place)), lambda x: x["text"] != "").alias("row"))
    return rows.select("doc_id", spaced(F.col("row")).alias("text"))
