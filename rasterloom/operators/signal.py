"""Structural similarity, thresholds, text error rates and polyline geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pictures import _kind
from .scores import normalized_text as plain_text
from .scores import ssim_map


def ssim(first: DataFrame, second: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, ssim): mean structural similarity of the luma of two pictures of that size over the pixels that both have, from
    11 x 11 windows; beyond their edge pictures go on mirrored, and pixels that one lacks add nothing. A picture to a task."""
    one = first.select("image_id", "x", "y", *[F.col(c).alias(f"{c}1") for c in "bgr"])
    both = one.join(second.select("image_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in "bgr"]), ["image_id", "x", "y"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["y"].to_numpy(), rows["x"].to_numpy()
        p, q, there = np.zeros((height, width, 3)), np.zeros((height, width, 3)), np.zeros((height, width), bool)
        p[at], q[at], there[at] = rows[["b1", "g1", "r1"]], rows[["b2", "g2", "r2"]], True
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "ssim": [round(float(ssim_map(p, q, there)[there].mean()), 6)]})

    return both.groupBy("image_id").applyInPandas(run, f"image_id {_kind(first)}, ssim double")


def otsu_contrast(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, contrast): distance between the means of the two classes that a threshold parts a group into with the largest
    variance between them, the lowest threshold of equals; 0 for fewer than two values. Equal values are counted first, so a
    window has the different values of a group only.

    With n of N values and s of their sum S below a threshold the means are (n S - N s) / (n (N - n)) apart, and the variance
    between the classes goes with the square of that times n (N - n).
    """
    bins = values.groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("held"))
    upto = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    moments = bins.groupBy(group).agg(F.sum("held").alias("all"), F.sum(F.col("v") * F.col("held")).alias("sum"))
    cuts = bins.withColumns({"n": F.sum("held").over(upto), "s": F.sum(F.col("v") * F.col("held")).over(upto)}).join(moments, group).where("n < all")
    weight = F.col("n") * (F.col("all") - F.col("n"))
    gap = (F.col("n") * F.col("sum") - F.col("all") * F.col("s")) / weight
    rated = cuts.select(group, gap.alias("gap"), (gap * gap * weight).alias("between"), "v")
    best = rated.groupBy(group).agg(F.max_by("gap", F.struct("between", (-F.col("v")).alias("low"))).alias("gap"))
    return moments.select(group).join(best, group, "left").select(group, F.round(F.coalesce("gap", F.lit(0.0)), 6).alias("contrast"))


def tones(values: DataFrame, group: str, value: str, least: float = 20.0) -> DataFrame:
    """(group, dark, light): 2nd and 98th percentile; null where the two classes of the values are less than `least` apart, or the
    percentiles are equal."""
    ends = values.groupBy(group).agg(F.percentile(value, F.lit(0.02)).alias("dark"), F.percentile(value, F.lit(0.98)).alias("light"))
    both = ends.join(otsu_contrast(values, group, value), group)
    kept = (F.col("contrast") >= least) & (F.col("light") > F.col("dark"))
    return both.select(group, F.when(kept, F.round("dark", 6)).alias("dark"), F.when(kept, F.round("light", 6)).alias("light"))


@F.pandas_udf(StringType())
def normalized_text(text: pd.Series) -> pd.Series:
    """Text for comparison: compatibility forms made plain (NFKC), typographic signs as ASCII, blanks collapsed."""
    return text.map(plain_text, na_action="ignore")


def character_errors(pairs: DataFrame) -> DataFrame:
    """(block, errors, length): edit distance of what was read to what is there, whole texts. pairs (block, truth, read)."""
    both = pairs.select("block", normalized_text("truth").alias("truth"), normalized_text("read").alias("read"))
    return both.select("block", F.levenshtein("truth", "read").alias("errors"), F.length("truth").alias("length"))


def character_error_rate(pairs: DataFrame) -> DataFrame:
    """(blocks, cer): all edits over all characters; null without characters."""
    return character_errors(pairs).agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum("errors") / F.nullif(F.sum("length"), F.lit(0)), 6).alias("cer"))


def scaled_up(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Pictures at another size, each pixel the one of the source that its middle falls in; a source pixel is sent to all of its own."""
    def spread(df, at, n, to):
        first = F.ceil(F.col(at) * to / n - 0.5)
        last = F.ceil((F.col(at) + 1) * to / n - 0.5) - 1
        df = df.where(first <= last).withColumn("t", F.explode(F.sequence(first, last)))
        return df.withColumn(at, F.col("t").cast("int")).drop("t")

    return spread(spread(px, "x", width, to_width), "y", height, to_height)


def ring_measures(rings: DataFrame) -> DataFrame:
    """(ring_id, area, length): signed shoelace area and length of closed rings. rings (ring_id, pts array of struct<x, y>)."""
    following = F.concat(F.slice("pts", F.lit(2), F.size("pts") - 1), F.slice("pts", 1, 1))
    add = lambda f: F.aggregate(F.zip_with("pts", following, f), F.lit(0.0), lambda s, v: s + v)
    area = add(lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")) / 2
    length = add(lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))
    return rings.select("ring_id", F.round(area, 6).alias("area"), F.round(length, 6).alias("length"))


def scaled_points(rings: DataFrame, sx: float, sy: float) -> DataFrame:
    """Rings at another size; pixel middles stay middles."""
    return rings.withColumn("pts", F.transform("pts", lambda p: F.struct(((p["x"] + 0.5) * sx - 0.5).alias("x"), ((p["y"] + 0.5) * sy - 0.5).alias("y"))))


def pixels_along(segments: DataFrame) -> DataFrame:
    """(segment_id, x, y): pixels along a segment, taken every half pixel. segments (segment_id, x0, y0, x1, y1)."""
    steps = F.greatest(F.lit(1), F.ceil(2 * F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)).cast("int"))
    each = segments.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("steps")).cast("int")
    return each.select("segment_id", at("x0", "x1").alias("x"), at("y0", "y1").alias("y")).distinct()


def near_share(pixels: DataFrame, targets: DataFrame, reach: int) -> DataFrame:
    """(image_id, pixels, near, share): pixels with a target within a distance. Targets send themselves to every pixel in reach."""
    disk = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach])
    sent = targets.withColumn("d", F.explode(disk)).select("image_id", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")).distinct()
    met = pixels.join(sent.withColumn("hit", F.lit(1)), ["image_id", "x", "y"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.count("hit").alias("near"))
    return met.withColumn("share", F.round(F.col("near") / F.col("pixels"), 6))


def boundary_f1(first: DataFrame, second: DataFrame, reach: int = 2) -> DataFrame:
    """(image_id, precision, recall, f1) of two sets of boundary pixels within a tolerance."""
    p, r = near_share(first, second, reach), near_share(second, first, reach)
    both = p.select("image_id", F.col("share").alias("precision")).join(r.select("image_id", F.col("share").alias("recall")), "image_id")
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 5))


def page_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, share): share of pixels that differ; a pixel that one page lacks differs."""
    one = first.select("image_id", "x", "y", F.struct("b", "g", "r").alias("p"))
    both = one.join(second.select("image_id", "x", "y", F.struct("b", "g", "r").alias("q")), ["image_id", "x", "y"], "full")
    return both.groupBy("image_id").agg(F.round(F.avg((~F.col("p").eqNullSafe(F.col("q"))).cast("double")), 6).alias("share"))


def shrunk(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """(image_id, x, y, b, g, r): the picture at a smaller size, every new pixel the mean of the area it covers."""
    def spread(df, at, n, to):
        size = n / to
        first, last = F.floor(F.col(at) / size), F.floor((F.col(at) + 1) / size - 1e-9)
        df = df.withColumn("t", F.explode(F.sequence(first, last)))
        share = F.least(F.col(at) + 1, (F.col("t") + 1) * size) - F.greatest(F.col(at), F.col("t") * size)
        return df.withColumn("w", F.col("w") * share).withColumn(at, F.col("t").cast("int")).drop("t")

    out = spread(spread(px.withColumn("w", F.lit(1.0)), "x", width, to_width), "y", height, to_height)
    mean = lambda c: F.rint(F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 6)).cast("int").alias(c)
    return out.groupBy("image_id", "x", "y").agg(mean("b"), mean("g"), mean("r"))
