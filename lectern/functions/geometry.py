"""Boxes as columns: struct<x0, y0, x1, y1> in, expressions out. Disjoint boxes meet in area 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aspect ratios an image model offers, in the order that breaks ties.
ASPECTS = (("1:1", 1, 1), ("4:5", 4, 5), ("3:4", 3, 4), ("2:3", 2, 3), ("9:16", 9, 16), ("16:9", 16, 9), ("3:2", 3, 2), ("5:4", 5, 4))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_x(a: Column, b: Column) -> Column:
    return overlap(a["x0"], a["x1"], b["x0"], b["x1"])


def overlap_y(a: Column, b: Column) -> Column:
    return overlap(a["y0"], a["y1"], b["y0"], b["y1"])


def intersection_area(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (inner["x1"] <= outer["x1"]) & (inner["y1"] <= outer["y1"])


def union_agg(b: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def inflate(b: Column, dx: float, dy: float) -> Column:
    return box(b["x0"] - dx, b["y0"] - dy, b["x1"] + dx, b["y1"] + dy)


def clip(b: Column, page_width: Column, page_height: Column) -> Column:
    return box(F.greatest(F.lit(0.0), b["x0"]), F.greatest(F.lit(0.0), b["y0"]), F.least(page_width, b["x1"]), F.least(page_height, b["y1"]))


def redaction_box(b: Column, margin: float = 0.0) -> Column:
    return inflate(b, max(0.3, margin), 0.4)


def safe_box(b: Column) -> Column:
    return inflate(b, 0.5, 0.5)


def page_box(image: Column, image_width: Column, image_height: Column, pixels: Column) -> Column:
    """A pixel box of an image in page coordinates, given where the image stands."""
    sx = width(image) / F.greatest(F.lit(1), image_width)
    sy = height(image) / F.greatest(F.lit(1), image_height)
    return box(image["x0"] + pixels["x0"] * sx, image["y0"] + pixels["y0"] * sy, image["x0"] + pixels["x1"] * sx, image["y0"] + pixels["y1"] * sy)


def valid_box(values: Column, image_width: Column, image_height: Column) -> Column:
    """array<string> of four numbers -> box inside the image, ends in order; null if malformed or a side is under 2."""
    v = F.transform(values, lambda x: x.try_cast("double"))
    a0, b0 = F.greatest(F.lit(0.0), F.get(v, 0)), F.greatest(F.lit(0.0), F.get(v, 1))
    a1, b1 = F.least(image_width.cast("double"), F.get(v, 2)), F.least(image_height.cast("double"), F.get(v, 3))
    found = box(F.least(a0, a1), F.least(b0, b1), F.greatest(a0, a1), F.greatest(b0, b1))
    ok = (F.size(values) == 4) & ~F.exists(v, lambda x: x.isNull()) & (width(found) >= 2) & (height(found) >= 2)
    return F.when(ok, found)


def sent_size(w: Column, h: Column, longest: int) -> Column:
    """struct<w, h, scale> after scaling down so that no edge passes ``longest``."""
    edge = F.greatest(w, h)
    scale = F.when(edge > longest, F.lit(float(longest)) / edge).otherwise(F.lit(1.0))
    side = lambda x: F.when(edge > longest, F.greatest(F.lit(1), (x * scale).cast("int"))).otherwise(x)
    return F.struct(side(w).alias("w"), side(h).alias("h"), scale.alias("scale"))


def aspect(w: Column, h: Column) -> Column:
    """Name of the nearest offered ratio; the first wins a tie."""
    ratio = w / F.greatest(h, F.lit(1))
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(a / b) - ratio).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, a, b) in enumerate(ASPECTS)]))["name"]


def baseline(b: Column, size: Column) -> Column:
    return b["y0"] + size * 0.82


def aligned_x(b: Column, text_width: Column, align: Column) -> Column:
    """Left (0), centre (1) or right (2), then kept inside the box."""
    x = F.when(align == 1, (b["x0"] + b["x1"] - text_width) / 2).when(align == 2, b["x1"] - text_width).otherwise(b["x0"])
    return F.greatest(b["x0"], F.least(x, b["x1"] - text_width))


def cluster(values: Column, tolerance: float = 1.5) -> Column:
    """Sorted doubles folded left to right: a value within ``tolerance`` of the last centre moves it to their midpoint.

    The centre depends on the order of merges, so this is a fold, not a gap test.
    """

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (F.abs(v - last) <= tolerance)
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array((last + v) / 2))
        return F.when(joins, merged).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)
