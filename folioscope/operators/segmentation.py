"""Scores of predicted against true line boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.geometry import baseline_to_box, bbox, greedy_ious, positional_ious

THRESHOLD = 0.75


def page_iou(pages: DataFrame, truth: str = "truth", found: str = "found", threshold: float = THRESHOLD) -> DataFrame:
    """`pages` with iou_mean, iou_share (of boxes from `threshold` up) and n_lines, by greedy matching.

    `truth` and `found` are arrays of `bbox` structs, null counts as none. Without true boxes all three are 0. Boxes are those of a page.
    """
    ious = greedy_ious(F.coalesce(F.col(truth), F.array()), F.coalesce(F.col(found), F.array()))
    x = pages.withColumn("__i", ious)
    n = F.size("__i")
    total = F.aggregate("__i", F.lit(0.0), lambda a, v: a + v)
    good = F.size(F.filter("__i", lambda v: v >= threshold))
    return x.withColumns({"iou_mean": F.when(n > 0, total / n).otherwise(F.lit(0.0)), "iou_share": F.when(n > 0, good / n).otherwise(F.lit(0.0)), "n_lines": n.cast("bigint")}).drop("__i")


def manuscript_iou(pages: DataFrame, manuscript: str = "manuscript") -> DataFrame:
    """Per manuscript: unweighted means over pages, sum of lines, number of pages; pages without scores only count as pages."""
    return pages.groupBy(manuscript).agg(F.avg("iou_mean").alias("iou_mean"), F.avg("iou_share").alias("iou_share"), F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.count(F.lit(1)).alias("pages"))


def overall_iou(manuscripts: DataFrame) -> DataFrame:
    """Unweighted mean over manuscripts."""
    return manuscripts.agg(F.avg("iou_mean").alias("iou_mean"), F.avg("iou_share").alias("iou_share"), F.sum("n_lines").alias("n_lines"))


def evaluate_manuscripts(pages: DataFrame, images: DataFrame, segments: DataFrame, threshold: float = THRESHOLD, digits: int = 4) -> DataFrame:
    """(manuscript, iou_mean, iou_share, n_lines, pages, reached) from true pages, images and a segmenter's output.

    `pages` has manuscript, page and `true` (struct of `baselines`); `images` (manuscript, image) those that exist; `segments` (manuscript,
    page, found) the found baselines, none where the segmenter failed. A page whose image or segments are missing is skipped but counted
    in `pages`; a manuscript of such pages alone has null means and 0 lines. Page values and means are rounded to `digits` places.
    """
    present = pages.withColumn("image", F.col("true.image")).join(images.select("manuscript", "image").distinct(), ["manuscript", "image"], "left_semi")
    boxes = lambda c: F.transform(c, lambda b: bbox(baseline_to_box(b)))
    scored = page_iou(present.join(segments, ["manuscript", "page"]).select("manuscript", "page", boxes(F.col("true.baselines")).alias("truth"), boxes(F.col("found")).alias("found")), threshold=threshold)
    rounded = scored.select("manuscript", "page", F.round("iou_mean", digits).alias("iou_mean"), F.round("iou_share", digits).alias("iou_share"), "n_lines")
    every = manuscript_iou(pages.select("manuscript", "page").join(rounded, ["manuscript", "page"], "left"))
    return every.withColumns({"iou_mean": F.round("iou_mean", digits), "iou_share": F.round("iou_share", digits)}).withColumn("reached", F.col("iou_mean") >= threshold)


def positional_stats(pages: DataFrame, truth: str = "truth", found: str = "found", threshold: float = THRESHOLD) -> DataFrame:
    """(iou_mean, iou_share, n) over polygons at the same places; no row where there are none."""
    i = pages.select(F.explode(positional_ious(F.col(truth), F.col(found))).alias("i"))
    return i.agg(F.avg("i").alias("iou_mean"), F.avg((F.col("i") >= threshold).cast("double")).alias("iou_share"), F.count(F.lit(1)).alias("n")).where("n > 0")
