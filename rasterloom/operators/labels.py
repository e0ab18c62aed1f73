"""Numbers on the page and what they cover; painting and tinting; detail inside boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import paper_under, tint
from .boxes import pixels_in_boxes
from .pictures import _grid, _kind, planes
from .regions import slivers
from .scores import grouped_windows, kept_boxes
from .settle import edge_vote as vote


def label_coverage(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, regions, labeled, region_share, area_share) of regions (image_id, region_id, area) and labels (image_id, region_id)."""
    named = labels.select("image_id", "region_id").distinct().withColumn("hit", F.lit(1))
    both = regions.join(named, ["image_id", "region_id"], "left")
    sums = both.groupBy("image_id").agg(F.count(F.lit(1)).alias("regions"), F.count("hit").alias("labeled"), F.sum("area").alias("area"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("area"))), F.lit(0)).alias("covered"))
    return sums.select("image_id", "regions", "labeled", F.round(F.col("labeled") / F.col("regions"), 6).alias("region_share"), F.round(F.col("covered") / F.col("area"), 6).alias("area_share"))


def unlabeled(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, region_id, area): regions without a number."""
    return regions.join(labels.select("image_id", "region_id"), ["image_id", "region_id"], "left_anti").select("image_id", "region_id", "area")


def label_sizes(labels: DataFrame, px_per_pt: float, least_pt: float) -> DataFrame:
    """(image_id, labels, small_share, least_pt): numbers below a size, and the smallest one."""
    pt = F.col("font_px") / px_per_pt
    return labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("labels"), F.round(F.avg((pt < least_pt).cast("double")), 6).alias("small_share"), F.round(F.min(pt), 6).alias("least_pt"))


def labels_on_ink(boxes: DataFrame, px: DataFrame, ink: str) -> DataFrame:
    """(image_id, box_id, inked): boxes that cover ink, and how many pixels of it."""
    return pixels_in_boxes(px.where(ink), boxes).groupBy("image_id", "box_id").agg(F.count(F.lit(1)).alias("inked"))


def share_in_boxes(px: DataFrame, boxes: DataFrame, mark: str) -> DataFrame:
    """(image_id, share, worst): marked share of the pixels in any box, and the largest share of one box."""
    hit = F.expr(mark).cast("double")
    inside = pixels_in_boxes(px, boxes).join(px.select("image_id", "x", "y", hit.alias("hit")), ["image_id", "x", "y"])
    each = inside.groupBy("image_id", "box_id").agg(F.avg("hit").alias("share"))
    whole = inside.dropDuplicates(["image_id", "x", "y"]).groupBy("image_id").agg(F.round(F.avg("hit"), 6).alias("share"))
    return whole.join(each.groupBy("image_id").agg(F.round(F.max("share"), 6).alias("worst")), "image_id")


def unlabeled_figures(regions: DataFrame, labels: DataFrame, pixels: int) -> DataFrame:
    """(image_id, unlabeled, area_share): regions without a number, and their share of a page of so many pixels."""
    named = labels.select("image_id", "region_id").distinct().withColumn("hit", F.lit(1))
    both = regions.join(named, ["image_id", "region_id"], "left")
    return both.groupBy("image_id").agg(F.count_if(F.col("hit").isNull()).alias("unlabeled"), F.round(F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("area"))), F.lit(0)) / pixels, 6).alias("area_share"))


def tube_regions(px: DataFrame, ink: str, radius: float) -> DataFrame:
    """(image_id, tubes, thin_ink): regions that are ink to a half or more, and the share of all ink that lies in parts of regions no
    brush of that radius reaches; null without ink."""
    hit = F.expr(ink)
    sums = px.where("region_id >= 0").groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("inked"))
    tubes = sums.groupBy("image_id").agg(F.count_if(F.col("inked") * 2 >= F.col("n")).alias("tubes"))
    thin = px.where(hit).select("image_id", "x", "y").join(slivers(px, radius), ["image_id", "x", "y"], "left")
    return tubes.join(thin.groupBy("image_id").agg(F.round(F.avg(F.coalesce("sliver", F.lit(False)).cast("double")), 6).alias("thin_ink")), "image_id", "left")


def suppressed(boxes: DataFrame, most: float = 0.3, least: float = 0.0) -> DataFrame:
    """Boxes (image_id, box_id, x, y, w, h, score) that stay when the best of those left drops all that it overlaps by more than `most`
    of their union, again and again; equal scores go by id. A picture to a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("box_id", kind="stable").reset_index(drop=True)
        return rows.loc[kept_boxes(rows[["x", "y", "w", "h"]].to_numpy(np.float64), rows["score"].to_numpy(np.float64), most, least)]

    some = boxes.select("image_id", "box_id", "x", "y", "w", "h", "score")
    return some.groupBy("image_id").applyInPandas(run, some.schema)


def window_groups(windows: DataFrame, least: int, slack: float = 0.2) -> DataFrame:
    """(image_id, x, y, w, h, windows): the mean boxes of groups of more than `least` detection windows (image_id, x, y, w, h) that lie
    within `slack` of their size of each other. A picture to a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = grouped_windows(rows.sort_values(["x", "y", "w", "h"])[["x", "y", "w", "h"]].to_numpy(), least, slack)
        return pd.DataFrame([(rows["image_id"].iloc[0], *box, n) for box, n in found], columns=["image_id", "x", "y", "w", "h", "windows"])

    return windows.select("image_id", "x", "y", "w", "h").groupBy("image_id").applyInPandas(run, f"image_id {_kind(windows)}, x int, y int, w int, h int, windows int")


def equalized(px: DataFrame, value: str) -> DataFrame:
    """(image_id, x, y, value): values from 0 to 255 spread by their cumulative counts; a window has 256 rows of a picture."""
    bins = px.groupBy("image_id", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order, whole = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    bins = bins.withColumns({"upto": F.sum("n").over(order), "first": F.first("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "all": F.sum("n").over(whole)})
    mapped = F.when(F.col("all") == F.col("first"), F.col("v")).otherwise(F.rint((F.col("upto") - F.col("first")) * 255 / (F.col("all") - F.col("first"))))
    return px.select("image_id", "x", "y", F.col(value).alias("v")).join(bins.select("image_id", "v", mapped.cast("int").alias("value")), ["image_id", "v"]).select("image_id", "x", "y", "value")


def page_pixels(px: DataFrame, coverage: str, ink_gray: int = 0x59) -> DataFrame:
    """(image_id, x, y, paper, b, g, r): the line page's gray, and the page tinted by its paint: the wash under the ink."""
    gray = paper_under(F.expr(coverage), F.lit(ink_gray))
    wash = lambda c: F.floor((gray * tint(F.col(c)) + 127) / 255).cast("int").alias(c)
    return px.select("image_id", "x", "y", gray.alias("paper"), wash("b"), wash("g"), wash("r"))


def completed(px: DataFrame, coverage: str, ink_gray: int = 0) -> DataFrame:
    """(image_id, x, y, b, g, r): paint with the picture's ink of a coverage (0 to 255) laid over it."""
    laid = lambda c: F.rint(F.col(c) + (ink_gray - F.col(c)) * (F.expr(coverage) / 255)).cast("int").alias(c)
    return px.select("image_id", "x", "y", *map(laid, "bgr"))


def edge_vote(px: DataFrame, palette: list[tuple[int, int, int]], sigma: float, step: float, digits: int | None = 9) -> DataFrame:
    """(image_id, x, y, label): labels (-1 for none) of pictures (image_id, x, y, label, b, g, r) after one vote on their edges, told by
    each pixel's own colour. Shares that are equal to so many decimal places tie: the pixel's own label wins, then the lowest. A picture
    to a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        labels = _grid(rows, "label", -1)
        out = vote(planes(rows), labels, np.array(palette), sigma, step, digits)
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "x": x, "y": y, "label": out[y, x].astype(np.int32)})

    return px.select("image_id", "x", "y", "label", "b", "g", "r").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, label int")
