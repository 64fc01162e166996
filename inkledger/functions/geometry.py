"""Boxes and points on a page as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Height and width of a page.
HEIGHT, WIDTH = 677, 1677


def clip(value: Column, low: int | Column, high: int | Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(low), F.least(value, as_col(high)))


def rect_to_pixels(x: Column, y: Column, w: Column, h: Column, height: int = HEIGHT, width: int = WIDTH) -> list[Column]:
    """x1, y1, x2, y2 of a rectangle in shares of the page, rounded half to even, at least a pixel wide and high."""
    one = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x, y, w, h = map(one, (x, y, w, h))
    pixel = lambda v: F.rint(v).cast("int")
    x1, y1 = clip(pixel(x * width), 0, width - 1), clip(pixel(y * height), 0, height - 1)
    x2, y2 = pixel((x + w) * width), pixel((y + h) * height)
    return [x1, y1, clip(F.greatest(x2, x1 + 1), 0, width), clip(F.greatest(y2, y1 + 1), 0, height)]


def rect_center(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2)]


def bbox_around(px: Column, py: Column, wide: float, high: float, height: int = HEIGHT, width: int = WIDTH) -> list[Column]:
    """A box of fixed size around a point, kept on the page."""
    bw, bh = int(wide * width), int(high * height)
    x1, y1 = F.greatest(F.lit(0), px - bw // 2), F.greatest(F.lit(0), py - bh // 2)
    return [x1, y1, F.least(F.lit(width), x1 + bw), F.least(F.lit(height), y1 + bh)]


def normalized(x1: Column, y1: Column, x2: Column, y2: Column, height: int = HEIGHT, width: int = WIDTH) -> list[Column]:
    """x, y, w, h of a pixel box in shares of the page; sizes are at least 1e-6."""
    at = lambda v, full: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / full))
    size = lambda v, full: F.greatest(F.lit(1e-6), F.least(F.lit(1.0), v / full))
    return [at(x1, width), at(y1, height), size(x2 - x1, width), size(y2 - y1, height)]


def padded(x1: Column, y1: Column, x2: Column, y2: Column, wide: float, high: float, height: int = HEIGHT, width: int = WIDTH) -> list[Column]:
    px, py = int(wide * width), int(high * height)
    return [F.greatest(F.lit(0), x1 - px), F.greatest(F.lit(0), y1 - py), F.least(F.lit(width - 1), x2 + px), F.least(F.lit(height - 1), y2 + py)]


def polygon_box(points: Column) -> list[Column]:
    """center x, center y, x1, y1, x2, y2 of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)
    return [mean(xs), mean(ys), F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
