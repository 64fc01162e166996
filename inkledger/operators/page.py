"""Pages: all lines of a document as one row, so that any number of rules costs one shuffle.

``lines`` is the array of a document's lines, English before Arabic, each a struct of what the line says (text, place, confidence)
and of what the rules ask of it (labels, tokens), which is worked out line by line before the rows meet. Rules are higher-order
functions over that array: a label is the best of the lines that are one, a winner the greatest (score, earlier line, payload).
A page holds as many lines as one image shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]

#: Arabic lines come after all English ones.
LAST = 1 << 40


def order() -> Column:
    """The place of a line among all of its document: English lines first."""
    return F.col("line_idx") + F.when(F.col("lang") == "en", 0).otherwise(LAST)


def line_box(points: Column) -> Column:
    """The box around a line's polygon in whole pixels; NULL without one."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("int")), F.transform(points, lambda p: p["y"].cast("int"))
    sides = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.size(points) > 0, sides)


NO_BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def pages(lines: DataFrame, features: dict[str, Column]) -> DataFrame:
    """doc_id, bank_code, lines. ``features`` are columns over a line; a polygon (bbox) is optional."""
    box = line_box(F.col("bbox")) if "bbox" in lines.columns else F.lit(None).cast(NO_BOX)
    plain = ["line_idx", "text", "px", "py", "confidence", "lang"]
    line = F.struct(order().alias("order"), *plain, box.alias("box"), *(c.alias(n) for n, c in features.items()))
    rows = lines.select("doc_id", "bank_code", line.alias("line"))
    return rows.groupBy("doc_id").agg(F.first("bank_code", ignorenulls=True).alias("bank_code"), F.array_sort(F.collect_list("line")).alias("lines"))


def winner(line: Column, score: Column, token: Column, source: str) -> Column:
    kept = ("confidence", "line_idx", "px", "py", "box")
    return F.struct(F.round(score, 9).alias("score"), (-line["order"]).alias("o"), F.lit(source).alias("source"), token.alias("token"), *(line[c].alias(c) for c in kept))


def greatest(when: Test, value: Test, lines: str = "lines") -> Column:
    """The greatest value among the lines that fit; NULL without one, as array_max passes over NULL."""
    return F.array_max(F.transform(lines, lambda x: F.when(when(x), value(x))))


def top(when: Test, score: Test, token: Test, source: str, lines: str = "lines") -> Column:
    """The best line that fits, the earliest on ties; NULL without one."""
    return greatest(lambda x: when(x) & token(x).isNotNull(), lambda x: winner(x, score(x), token(x), source), lines)


def earliest(when: Test, token: Test, score: Test, source: str, lines: str = "lines") -> Column:
    """The first line that fits."""
    return F.get(F.transform(F.slice(F.filter(lines, lambda x: when(x) & token(x).isNotNull()), 1, 1), lambda x: winner(x, score(x), token(x), source)), F.lit(0))


def label(when: Test, lines: str = "lines") -> Column:
    """The place of the most confident line that is a label."""
    return greatest(when, lambda x: F.struct(x["confidence"], (-x["order"]).alias("o"), x["px"], x["py"]), lines)


def labels(when: Test, lines: str = "lines") -> Column:
    """The places of all lines that are labels."""
    return F.transform(F.filter(lines, when), lambda x: F.struct(x["px"], x["py"]))


def better(a: Column, b: Column) -> Column:
    """The better of two winners, the first where they tie or the other is NULL."""
    return F.when(a.isNull() | (b["score"] > a["score"]), F.coalesce(b, a)).otherwise(a)


def exploded(rows: DataFrame, array: str | Column, *keep: str) -> DataFrame:
    """``keep`` and each member f of an array. The optimizer would push the test that an array has members below all that makes it
    up, and so work it out twice; here it stays behind."""
    return rows.select(*keep, F.explode_outer(array).alias("f")).filter("f is not null")
