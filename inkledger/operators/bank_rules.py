"""Rule sets of single banks: where a bank prints a number, a date, an amount or a payee, in stages.

Lines are those of extract.py. English lines are read before Arabic ones, which decides ties: the earlier line wins. Every rule
works on pages (page.py): ``features`` says what a line holds, ``stages`` the best line of every stage of its bank, ``picks`` which
stage counts; so all rules of all banks cost the one shuffle that brings a document's lines together. A rule gives doc_id, name,
source, token, confidence, line_idx, px, py. The names of sources are fixed values: audit documents carry them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as txt
from inkledger.functions.geometry import HEIGHT, WIDTH
from inkledger.operators import page

# Labels that the rules look for.
CHEQUE_LABEL, CHEQUE_LABEL_AR, DATE_LABEL = r"(?i)\bcheque\b", "شيك", r"(?i)\bdate\b"
NUMBER_LABEL, NUMBER_LABEL_ENDS = r"(?i)\bcheque\s*no\.?\b", r"(?i)(cheque\s*no\.?|cheaue\s*no\.?)$"
PAYEE_LABEL = r"(ادفعوا\s*لأمر|اسم\s*الحساب|بحاسلا\s*مس)"
BRANCH = "فرع"
# Misread numbers of one bank that recur on many cheques, and the first digits of its real ones.
DENIED = ("909006500", "909004500", "909001500", "190900500", "909000500", "005700606", "455990776", "185599046", "095990746", "690972776", "020100175", "1909006500")
NINE_STARTS = ("944", "943", "945", "942")
FAB_NUMBER = r"(?<!\d)(44139\d{3})(?!\d)"
#: The rules whose line replaces the box of its field.
BOXED = ("bm_label_row", "bm_label_row_ar", "bm_fullband_mid", "bm_fullband", "bm_global_8", "nbe_preselect_cheque", "nbe_final_full_image", "aaib_fullimage", "nbe_amount_dec_band", "bm_preselect_band", "bm_final_full_image")


# ---------------------------------------------------------------- what a line holds


def all_of(n: int) -> Column:
    """The runs of exactly n digits of a line."""
    return F.regexp_extract_all("text", F.lit(rf"(?<!\d)(\d{{{n}}})(?!\d)"), 1)


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def found_in(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def by_bank(**values: Column) -> Column:
    """The value of the line's bank; other banks' are not evaluated."""
    out = None
    for bank, value in values.items():
        when = F.col("bank_code") == bank
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def features(denied: tuple[str, ...] = DENIED) -> dict[str, Column]:
    """Flags and tokens of a line, by its bank: ``number`` is what the bank's first stages look for, ``other`` what its later ones
    do, ``plain`` whether the line can hold a number at all."""
    line, en = F.col("text"), F.col("lang") == "en"
    strip, letters = txt.micr_like(line, ":", 16), line.rlike("[A-Za-z]")
    usual = found_in(line, FAB_NUMBER)
    # of several numbers on a line the one with fewest leading zeros, the first of these
    ranked = F.transform(all_of(12), lambda t, i: F.struct(txt.leading_zeros(t).alias("z"), i.alias("i"), t.alias("t")))
    return {
        "english": en, "letters": letters,
        "cheque": en & line.rlike(CHEQUE_LABEL), "cheque_ar": line.rlike(CHEQUE_LABEL_AR), "date_label": line.rlike(DATE_LABEL), "payee_label": line.rlike(PAYEE_LABEL),
        "number_label": by_bank(AAIB=line.rlike(NUMBER_LABEL), CIB=line.rlike(txt.NO_LABEL)),
        "plain": by_bank(
            BANQUE_MISR=~txt.micr_like(line, ':"', 12) & ~txt.amount_like(line), NBE=en & ~strip, FABMISR=en & ~strip & ~letters, CIB=~line.rlike('[A-Za-z:"]') & ~line.rlike(txt.NO_LABEL),
            AAIB=en & ~F.trim(line).rlike(NUMBER_LABEL_ENDS) & ~F.trim(line).isin(*denied) & ~strip,
        ),
        "number": by_bank(
            BANQUE_MISR=first(F.filter(all_of(8), lambda t: txt.token_isolated(t, line))), NBE=first(all_of(14)), AAIB=first(all_of(9)), FABMISR=usual, CIB=F.array_min(ranked)["t"],
        ),
        "other": by_bank(
            BANQUE_MISR=F.when(txt.token_isolated(first(all_of(8)), line), first(all_of(8))), NBE=txt.digit_join(line, (7, 7)), FABMISR=first(all_of(8)),
            CIB=F.coalesce(txt.digit_join(line, (4, 4, 4)), txt.digit_join(line, (6, 6))),
        ),
        "exact": by_bank(CIB=F.when(F.trim(line).rlike(r"^\d{12}$"), F.trim(line))),
        "loose": by_bank(CIB=found_in(line, txt.NUMBER)),
        "usual": by_bank(AAIB=F.exists(all_of(9), lambda t: F.substring(t, 1, 3).isin(*NINE_STARTS))),
        # a date has letters and digits, and no repair adds any to a line without
        "date": by_bank(AAIB=txt.repair(found_in(line, txt.DATE_LOOSE), txt.REPAIR_A), NBE=F.when(letters & line.rlike(r"\d"), txt.repair(found_in(txt.repair(line, txt.REPAIR_B), txt.DATE_LOOSE), txt.REPAIR_B))),
        "amount": by_bank(NBE=F.when(en, found_in(line, txt.AMOUNT_DECIMAL)), FABMISR=F.when(en & ~txt.amount_noise(line), found_in(line, txt.AMOUNT_DECIMAL))),
        # a line that is nothing but a label wins its stage and then gives way to the next
        "payee": by_bank(**{b: F.when(~line.rlike(r"[A-Za-z\d]") & ~line.contains(BRANCH), F.coalesce(F.nullif(txt.payee_clean(line), F.lit("")), F.lit(""))) for b in ("NBE", "AAIB")}),
    }


# ---------------------------------------------------------------- the stages of each bank
# Each function gives the places that the stages measure from, the stages' winners, and the pick among them, as columns over a
# page. They are selected one after the other, so a winner that several expressions name is worked out once.

Stages = tuple[dict[str, Column], dict[str, Column], Column]


def held(name: str) -> page.Test:
    return lambda x: x[name]


def always(x: Column) -> Column:
    return F.lit(True)


def outside(x: Column, zones: Column) -> Column:
    """The line lies in no padded zone of its page."""
    pad_x, pad_y = int(0.06 * WIDTH), int(0.05 * HEIGHT)
    inside = lambda z: x["px"].between(F.greatest(F.lit(0), z["x1"] - pad_x), F.least(F.lit(WIDTH - 1), z["x2"] + pad_x)) & x["py"].between(F.greatest(F.lit(0), z["y1"] - pad_y), F.least(F.lit(HEIGHT - 1), z["y2"] + pad_y))
    return ~F.coalesce(F.exists(zones, inside), F.lit(False))


def bm_number() -> Stages:
    """Eight digits outside the amount: in the row right of the English label, else left of the Arabic one; lines of the middle
    band compete with these by confidence; then a broad band, then anywhere. Halves of four digits are never isolated, so they
    are not joined. Labels count wherever they stand, also inside the amount."""
    places = {"bm_en": page.label(held("cheque")), "bm_ar": page.label(held("cheque_ar"))}
    en, ar, zones, conf, token = F.col("bm_en"), F.col("bm_ar"), F.col("zones"), held("confidence"), held("number")
    fits = lambda more: lambda x: x["plain"] & more(x) & outside(x, zones)
    row = lambda x, p: F.abs(x["py"] - p["py"]) <= 0.08 * HEIGHT
    less = lambda p: lambda x: x["confidence"] - 0.10 * F.abs(x["px"] - p["px"]) / (0.5 * WIDTH)
    left = lambda x: x["px"] < 0.78 * WIDTH
    stages = {
        "bm_n1": page.top(fits(lambda x: row(x, en) & (x["px"] >= en["px"]) & (x["px"] < 0.68 * WIDTH)), less(en), token, "bm_label_row"),
        "bm_n2": page.top(fits(lambda x: row(x, ar) & (x["px"] <= ar["px"]) & left(x)), less(ar), token, "bm_label_row_ar"),
        "bm_n3": page.top(fits(lambda x: x["py"].between(0.30 * HEIGHT, 0.55 * HEIGHT) & left(x)), conf, token, "bm_fullband_mid"),
        "bm_n4": page.top(fits(lambda x: x["py"].between(0.01 * HEIGHT, 0.60 * HEIGHT) & left(x)), conf, token, "bm_fullband"),
        "bm_n5": page.top(fits(lambda x: x["px"] < 0.90 * WIDTH), conf, held("other"), "bm_global_8"),
    }
    row_first = F.coalesce("bm_n1", "bm_n2")
    return places, stages, F.coalesce(page.better(row_first, F.col("bm_n3")), "bm_n4", "bm_n5")


def nbe_number() -> Stages:
    """Fourteen digits, whole or as two joined halves. The best English line of the document wins; one right of the labels is
    looked for first and lends its confidence and name."""
    found = F.filter("lines", held("cheque"))
    places = {"nbe_en": F.struct(F.array_min(F.transform(found, held("px"))).alias("px"), F.array_min(F.transform(found, held("py"))).alias("py"))}
    p, token = F.col("nbe_en"), lambda x: F.coalesce(x["number"], x["other"])
    penalty = lambda x: F.when(x["number"].isNull(), 0.10).otherwise(0.0)
    beside_it = lambda x: x["plain"] & x["px"].between(p["px"], F.least(F.lit(float(WIDTH)), p["px"] + 0.68 * WIDTH)) & ~x["letters"]
    score = lambda x: x["confidence"] - 0.25 * F.abs(x["px"] - p["px"]) / (0.5 * WIDTH) - 0.35 * F.abs(x["py"] - p["py"]) / (0.06 * HEIGHT) - penalty(x)
    stages = {"nbe_n1": page.top(beside_it, score, token, "nbe_preselect_cheque"), "nbe_n2": page.top(held("plain"), lambda x: x["confidence"] - penalty(x), token, "nbe_final_full_image")}
    near, whole = F.col("nbe_n1"), F.col("nbe_n2")
    pick = whole.withField("source", F.coalesce(near["source"], whole["source"])).withField("confidence", F.greatest(near["confidence"], whole["confidence"]))
    return places, stages, pick


def aaib_number() -> Stages:
    """Nine digits on an English line that is no known misreading: more for the top, the left, a number label to the left in the
    row, and usual first digits."""
    near = lambda x: F.exists("aaib_at", lambda p: (F.abs(p["py"] - x["py"]) <= 0.05 * HEIGHT) & (p["px"] <= x["px"]))
    places = {"aaib_at": page.labels(lambda x: x["english"] & x["number_label"])}  # labels are those of English lines
    bonus = lambda when, by: F.when(when, by).otherwise(0.0)
    score = lambda x: x["confidence"] + bonus(x["py"] <= 0.22 * HEIGHT, 0.2) + bonus(x["px"] <= 0.55 * WIDTH, 0.15) + bonus(near(x), 0.2) + bonus(x["usual"], 0.3)
    return places, {"aaib_n1": page.top(held("plain"), score, held("number"), "aaib_fullimage")}, F.col("aaib_n1")


def fab_number() -> Stages:
    """Eight digits on an English line without letters: the best with the usual start, else the first of any start."""
    plain, source = held("plain"), "fabmisr_cheque_clean"
    stages = {
        "fab_n1": page.top(plain, lambda x: x["confidence"] + 1.0, held("number"), source),
        "fab_n2": page.earliest(plain, lambda x: F.coalesce(x["number"], x["other"]), lambda x: F.when(x["number"].isNull(), x["confidence"]), source),
    }
    usual, head = F.col("fab_n1"), F.col("fab_n2")  # a line of any start counts only while there is no other
    return {}, stages, F.when(head["score"].isNull(), usual).otherwise(page.better(head, usual))


def cib_number() -> Stages:
    """Twelve digits in the band that the cheque labels span, whole or joined; else a line of nothing but twelve digits; else the
    ranked numbers of the document: no label near, upper half, length near 12, near the middle, confidence."""
    places = {"cib_en": page.label(held("cheque")), "cib_ar": page.label(held("cheque_ar")), "cib_at": page.labels(held("number_label"))}
    en, ar = F.col("cib_en.px"), F.col("cib_ar.px")
    both, w = en.isNotNull() & ar.isNotNull(), float(WIDTH)
    left = F.when(both, F.greatest(F.lit(0.0), F.least(en, ar) + 0.02 * w)).when(en.isNotNull(), en).otherwise(F.greatest(F.lit(0.0), ar - 0.50 * w))
    right = F.when(both, F.least(F.lit(w), F.greatest(en, ar) - 0.02 * w)).when(en.isNotNull(), F.least(F.lit(w), en + 0.50 * w)).otherwise(ar)
    inside = lambda x: x["plain"] & x["px"].between(left, right)
    away = lambda x: 0.3 * F.abs(x["px"] - 0.5 * (left + right)) / F.greatest(F.lit(1.0), 0.5 * (right - left)) + 0.2 * F.abs(x["py"] - 0.60 * HEIGHT) / (0.25 * HEIGHT)
    score = lambda x, t: x["confidence"] - away(x) - 0.05 * txt.leading_zeros(t)
    alone = lambda x: x["confidence"] - 0.2 * F.abs(x["py"] - 0.60 * HEIGHT) / (0.30 * HEIGHT) - 0.05 * txt.leading_zeros(x["exact"])
    near = lambda x: x["number_label"] | F.exists("cib_at", lambda p: (F.abs(p["py"] - x["py"]) <= 0.05 * HEIGHT) & x["px"].between(p["px"] - 0.10 * WIDTH, p["px"] + 0.40 * WIDTH))
    centre = lambda x: F.round(F.abs(x["px"] - 0.5 * WIDTH) / (0.5 * WIDTH), 9)
    rank = lambda x: F.struct(F.when(near(x), 1).otherwise(0).alias("a"), F.when(x["py"] <= 0.45 * HEIGHT, 0).otherwise(1).alias("b"), F.abs(F.length(x["loose"]) - 12).alias("c"), centre(x).alias("d"), (-x["confidence"]).alias("e"), x["line_idx"].alias("f"), page.winner(x, F.lit(0.0), x["loose"], "fallback_candidates").alias("w"))
    stages = {
        "cib_n1": page.top(inside, lambda x: score(x, x["number"]), held("number"), "bm_preselect_band"),
        "cib_n2": page.earliest(inside, lambda x: F.coalesce(x["number"], x["other"]), lambda x: F.when(x["number"].isNull(), score(x, x["other"]) - 0.10), "bm_preselect_band"),
        "cib_n3": page.top(always, alone, held("exact"), "bm_final_full_image"),
        "cib_n4": F.array_min(F.transform(F.filter("lines", lambda x: x["loose"].isNotNull()), rank))["w"],
    }
    band, head = F.col("cib_n1"), F.col("cib_n2")
    return places, stages, F.coalesce(F.when(head["score"].isNull(), band).otherwise(page.better(head, band)), "cib_n3", "cib_n4")


def beside(places: str, when: page.Test, near: float, weight: float) -> page.Test:
    """The best score of a line beside a label of its page: in its row and right of it, less for distance; NULL if there is none."""

    def score(x: Column) -> Column:
        fits = F.filter(places, lambda p: (F.abs(x["py"] - p["py"]) <= near * HEIGHT) & (x["px"] >= p["px"]))
        return F.when(when(x), F.array_max(F.transform(fits, lambda p: x["confidence"] - weight * (x["px"] - p["px"]) / (0.5 * WIDTH))))

    return score


def still_date(stages: list[str]) -> Column:
    """The first stage whose repaired text still is a date, else the last that found any; the first that found any names it."""
    found = [F.col(s) for s in stages]
    good = [F.when(f["token"].rlike(txt.DATE_LOOSE), f) for f in found]
    won, named = F.coalesce(*good, *reversed(found)), F.coalesce(*found)
    return won.withField("source", named["source"])


def aaib_date() -> Stages:
    """A date in the upper right region, beside the label, anywhere; months are repaired in the date that was found."""
    region = lambda x: (x["px"] >= 0.50 * WIDTH) & x["py"].between(0.04 * HEIGHT, 0.40 * HEIGHT)
    near, conf, token = beside("aaib_d_at", always, 0.05, 0.15), held("confidence"), held("date")
    stages = {"aaib_d1": page.top(region, conf, token, "aaib_date_region"), "aaib_d2": page.top(lambda x: near(x).isNotNull(), near, token, "aaib_date_label"), "aaib_d3": page.top(always, conf, token, "aaib_date_global")}
    return {"aaib_d_at": page.labels(held("date_label"))}, stages, still_date(["aaib_d1", "aaib_d2", "aaib_d3"])


def nbe_date() -> Stages:
    """A date beside an English label, then anywhere; months are repaired before a date is looked for."""
    near, conf, token = beside("nbe_d_at", always, 0.06, 0.12), held("confidence"), held("date")
    stages = {"nbe_d1": page.top(lambda x: near(x).isNotNull(), near, token, "nbe_date_label"), "nbe_d2": page.top(always, conf, token, "nbe_date_global")}
    return {"nbe_d_at": page.labels(lambda x: x["english"] & x["date_label"])}, stages, still_date(["nbe_d1", "nbe_d2"])


def nbe_amount() -> Stages:
    """Amounts with decimals by their place in the right band, then anywhere."""
    band = lambda x: (x["px"] >= 0.62 * WIDTH) & x["py"].between(0.22 * HEIGHT, 0.60 * HEIGHT)
    score = lambda x: x["confidence"] + 0.2 * (x["px"] - 0.62 * WIDTH) / (0.38 * WIDTH) + 0.1 * (1.0 - F.abs(x["py"] - 0.40 * HEIGHT) / (0.20 * HEIGHT))
    stages = {"nbe_a1": page.top(band, score, held("amount"), "nbe_amount_dec_band"), "nbe_a2": page.top(always, held("confidence"), held("amount"), "nbe_amount_dec_global")}
    return {}, stages, F.coalesce("nbe_a1", "nbe_a2")


def fab_amount() -> Stages:
    """Amounts with decimals on lines that are not the machine-read strip."""
    return {}, {"fab_a1": page.top(always, held("confidence"), held("amount"), "fabmisr_amount_clean")}, F.col("fab_a1")


def payee(prefix: str, ends: str) -> Stages:
    """The most confident line without Latin letters, digits or a branch name in the field's box (``payee_box``), padded by 2 %;
    then one right of a payee label."""
    pad_x, pad_y, b = int(0.02 * WIDTH), int(0.02 * HEIGHT), F.col("payee_box")
    box = lambda x: b.isNotNull() & x["px"].between(F.greatest(F.lit(0), b["x1"] - pad_x), F.least(F.lit(WIDTH - 1), b["x2"] + pad_x)) & x["py"].between(F.greatest(F.lit(0), b["y1"] - pad_y), F.least(F.lit(HEIGHT - 1), b["y2"] + pad_y))
    near = beside(f"{prefix}_p_at", lambda x: x["payee"].isNotNull(), 0.06, 0.10)
    stages = {f"{prefix}_p1": page.top(box, held("confidence"), held("payee"), f"{prefix}_name_{ends}"), f"{prefix}_p2": page.top(lambda x: near(x).isNotNull(), near, held("payee"), f"{prefix}_name_label")}
    some = lambda c: F.when(F.col(c)["token"] != "", F.col(c))
    return {f"{prefix}_p_at": page.labels(held("payee_label"))}, stages, F.coalesce(some(f"{prefix}_p1"), some(f"{prefix}_p2"))


#: field -> bank -> its stages.
RULES: dict[str, dict[str, Callable[[], Stages]]] = {
    "cheque_number": {"BANQUE_MISR": bm_number, "NBE": nbe_number, "AAIB": aaib_number, "FABMISR": fab_number, "CIB": cib_number},
    "date": {"AAIB": aaib_date, "NBE": nbe_date},
    "amount_numeric": {"NBE": nbe_amount, "FABMISR": fab_amount},
    "name": {"NBE": lambda: payee("nbe", "roi"), "AAIB": lambda: payee("aaib", "fallback")},
}


def found(pages: DataFrame, rules: dict[str, dict[str, Callable[[], Stages]]] = RULES) -> DataFrame:
    """The pages with ``rules``: an array of (name, w), a winner for each field that the rules of the page's bank find. pages: those of
    page.pages with these features, zones (an array of boxes that hold no number) and payee_box."""
    made = [(name, bank, *make()) for name, banks in rules.items() for bank, make in banks.items()]
    of = lambda bank, value: F.when(F.col("bank_code") == bank, value)
    rows = pages
    for step in (2, 3):
        rows = rows.select("*", *(of(m[1], value).alias(c) for m in made for c, value in m[step].items()))
    won = [F.struct(F.lit(name).alias("name"), F.coalesce(*(of(m[1], m[4]) for m in made if m[0] == name)).alias("w")) for name in rules]
    return rows.select(*pages.columns, F.filter(F.array(*won), lambda r: r["w"].isNotNull()).alias("rules"))


def run(lines: DataFrame, *names: str, banks: tuple[str, ...] = (), zones: DataFrame | None = None, payees: DataFrame | None = None) -> DataFrame:
    """What the rules of some fields find on the lines of some banks. zones and payees: doc_id, x1, y1, x2, y2."""
    rules = {n: {b: m for b, m in RULES[n].items() if not banks or b in banks} for n in names}
    rows = page.pages(lines.filter(F.col("bank_code").isin(*{b for m in rules.values() for b in m})), features())
    box = F.struct("x1", "y1", "x2", "y2")
    for name, given, gather in (("zones", zones, F.collect_list(box)), ("payee_box", payees, F.first(box))):
        rows = rows.join(given.groupBy("doc_id").agg(gather.alias(name)), "doc_id", "left") if given is not None else rows.withColumn(name, F.lit(None).cast(f"array<{page.NO_BOX}>" if name == "zones" else page.NO_BOX))
    return page.exploded(found(rows, rules), "rules", "doc_id").select("doc_id", "f.name", *(f"f.w.{c}" for c in ("source", "token", "confidence", "line_idx", "px", "py")))


def number_bm(lines: DataFrame, amount_boxes: DataFrame) -> DataFrame:
    return run(lines, "cheque_number", banks=("BANQUE_MISR",), zones=amount_boxes)


def number_nbe(lines: DataFrame) -> DataFrame:
    return run(lines, "cheque_number", banks=("NBE",))


def number_aaib(lines: DataFrame) -> DataFrame:
    return run(lines, "cheque_number", banks=("AAIB",))


def number_fab(lines: DataFrame) -> DataFrame:
    return run(lines, "cheque_number", banks=("FABMISR",))


def number_cib(lines: DataFrame) -> DataFrame:
    return run(lines, "cheque_number", banks=("CIB",))


def date_rules(lines: DataFrame) -> DataFrame:
    return run(lines, "date")


def amount_rules(lines: DataFrame) -> DataFrame:
    return run(lines, "amount_numeric")


def payee_rules(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    return run(lines, "name", payees=boxes)
