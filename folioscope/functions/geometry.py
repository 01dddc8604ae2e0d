"""Polygons and baselines as column expressions: arrays of [x, y] arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN = 20  # pixels that a baseline's box reaches above and below it


def points(c: Column) -> Column:
    """Pairs of a string of numbers; decimals are cut towards zero, an odd last number is dropped, commas count as blanks."""
    v = F.filter(F.split(F.translate(c, ",", " "), r"\s+"), lambda x: x != "")
    n = F.floor(F.size(v) / 2).cast("int")
    one = lambda i: F.get(v, i).cast("double").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(one(2 * i), one(2 * i + 1)))
    return F.when(c.isNull(), F.lit(None)).when(n < 1, F.array().cast("array<array<int>>")).otherwise(pairs)


def _axis(poly: Column, k: int) -> Column:
    return F.transform(poly, lambda p: p[k])


def bbox(poly: Column) -> Column:
    """Struct x0, y0, x1, y1 around a polygon; null for an empty or null one."""
    return F.when(F.size(poly) > 0, F.struct(F.array_min(_axis(poly, 0)).alias("x0"), F.array_min(_axis(poly, 1)).alias("y0"), F.array_max(_axis(poly, 0)).alias("x1"), F.array_max(_axis(poly, 1)).alias("y1")))


def baseline_to_box(line: Column, margin: int = MARGIN) -> Column:
    """Four corners of the box around a baseline, `margin` wider above and below; null for an empty or null one."""
    b = bbox(line)
    x0, x1, y0, y1 = b["x0"], b["x1"], b["y0"] - margin, b["y1"] + margin
    return F.when(F.size(line) > 0, F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs of `bbox`); 0 without a true overlap, null where one is null."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda r: (r["x1"] - r["x0"]).cast("double") * (r["y1"] - r["y0"])
    both = w.cast("double") * h
    union = area(a) + area(b) - both
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def polygon_iou(a: Column, b: Column) -> Column:
    """IoU of the bounding boxes of two polygons."""
    return iou(bbox(a), bbox(b))


def greedy_ious(truth: Column, found: Column) -> Column:
    """IoU of each true box with the best found box not yet used, in the order of the true ones.

    Both are arrays of `bbox` structs. The first of equally good boxes wins; a true box without overlap gets
    0 and uses none.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<double>").alias("ious"))

    def take(acc: Column, t: Column) -> Column:
        free = F.transform(found, lambda p, j: F.struct(F.when(F.array_contains(acc["used"], j), F.lit(0.0)).otherwise(F.coalesce(iou(t, p), F.lit(0.0))).alias("v"), (-j).alias("k")))
        best = F.array_max(free)
        v = F.coalesce(best["v"], F.lit(0.0))
        return F.struct(F.when(v > 0, F.concat(acc["used"], F.array(-best["k"]))).otherwise(acc["used"]).alias("used"), F.concat(acc["ious"], F.array(v)).alias("ious"))

    return F.aggregate(truth, start, take)["ious"]


def positional_ious(truth: Column, found: Column) -> Column:
    """IoUs of the polygons at the same places of two arrays, as many as the shorter has."""
    n = F.least(F.size(truth), F.size(found))
    both = F.arrays_zip(F.slice(truth, 1, n).alias("a"), F.slice(found, 1, n).alias("b"))
    return F.transform(both, lambda p: polygon_iou(p["a"], p["b"]))
