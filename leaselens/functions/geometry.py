"""Boxes: overlap, bounds of quadrilaterals, percentages of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs (x, y, w, h); 0 for boxes apart."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = (wide * high).cast("double")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when((wide <= 0) | (high <= 0) | (union <= 0), 0.0).otherwise(both / union)


def bounds(vertices: Column) -> Column:
    """struct(x, y, w, h) around an array of points; missing coordinates are 0."""
    xs = F.transform(vertices, lambda p: F.coalesce(p["x"], F.lit(0.0)))
    ys = F.transform(vertices, lambda p: F.coalesce(p["y"], F.lit(0.0)))
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def quad_percent(vertices: Column) -> Column:
    """Bounds in percent of points given as parts of 1; zeros for less than four points."""
    b = bounds(vertices)
    full = F.struct(*((b[c] * 100).alias(c) for c in "xywh"))
    return F.when(F.size(vertices) >= 4, full).otherwise(F.struct(*(F.lit(0.0).alias(c) for c in "xywh")))


def pairs_percent(pairs: Column) -> Column:
    """quad_percent() of points given as arrays (x, y)."""
    return quad_percent(F.transform(pairs, lambda p: F.struct(F.get(p, 0).cast("double").alias("x"), F.get(p, 1).cast("double").alias("y"))))


def unit_box_percent(box: Column) -> Column:
    """A box (x, y, width, height) given as parts of 1, in percent; missing parts are 0."""
    return F.struct(*((F.coalesce(box[c], F.lit(0.0)) * 100).alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))))


def box_percent(box: Column, width: Column, height: Column) -> Column:
    """A pixel box in percent of its page; null for a page without size."""
    return F.struct(*((F.try_divide(F.coalesce(box[c], F.lit(0)), side) * 100).alias(c) for c, side in zip("xywh", (width, height, width, height))))


def corners(box: Column) -> Column:
    return F.struct(box["x"].alias("x1"), box["y"].alias("y1"), (box["x"] + box["w"]).alias("x2"), (box["y"] + box["h"]).alias("y2"))
