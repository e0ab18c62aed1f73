"""Box, point and polygon operators. Range joins are dealt by tiles: both sides list the tiles they touch, equal tiles meet,
and the exact test follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 16


def _tiles(x0, y0, x1, y1):
    """The tiles that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / TILE).cast("int"), F.floor(hi / TILE).cast("int"))
    return F.flatten(F.transform(span(x0, x1), lambda tx: F.transform(span(y0, y1), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def _tiled(boxes: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return boxes.withColumn("tile", F.explode(_tiles(x, y, x + F.col("w"), y + F.col("h"))))


def pixels_in_boxes(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, x, y, box_id): pixels whose middle lies in a box (x, y, w, h), once for each box."""
    dealt = px.select("image_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("tile", F.struct(F.floor(F.col("px") / TILE).cast("int").alias("tx"), F.floor(F.col("py") / TILE).cast("int").alias("ty")))
    cx, cy = F.col("px") + 0.5, F.col("py") + 0.5
    inside = (F.col("x") <= cx) & (cx < F.col("x") + F.col("w")) & (F.col("y") <= cy) & (cy < F.col("y") + F.col("h"))
    return dealt.join(_tiled(boxes), ["image_id", "tile"]).where(inside).select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), "box_id")


def box_mask(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, x, y): pixels whose middle lies in any box."""
    return pixels_in_boxes(px, boxes).select("image_id", "x", "y").distinct()


def overlaps(boxes: DataFrame) -> DataFrame:
    """(image_id, a, b, area): every two boxes that overlap, and by how much."""
    one = _tiled(boxes)
    two = one.select("image_id", "tile", *[F.col(c).alias(f"o{c}") for c in ("box_id", "x", "y", "w", "h")])
    wide = F.least(F.col("x") + F.col("w"), F.col("ox") + F.col("ow")) - F.greatest("x", "ox")
    high = F.least(F.col("y") + F.col("h"), F.col("oy") + F.col("oh")) - F.greatest("y", "oy")
    both = one.join(two, ["image_id", "tile"]).where((F.col("box_id") < F.col("obox_id")) & (wide > 0) & (high > 0))
    return both.select("image_id", F.col("box_id").alias("a"), F.col("obox_id").alias("b"), (wide * high).alias("area")).distinct()


def labels_on_boxes(labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, labels, on_boxes): numbers' boxes (x, y, w, h), and those that overlap any of some other boxes; touching is none."""
    one = _tiled(labels)
    two = _tiled(boxes).select("image_id", "tile", *[F.col(c).alias(f"o{c}") for c in ("x", "y", "w", "h")])
    wide = F.least(F.col("x") + F.col("w"), F.col("ox") + F.col("ow")) - F.greatest("x", "ox")
    high = F.least(F.col("y") + F.col("h"), F.col("oy") + F.col("oh")) - F.greatest("y", "oy")
    hit = one.join(two, ["image_id", "tile"]).where((wide > 0) & (high > 0)).select("image_id", "box_id").distinct().withColumn("hit", F.lit(1))
    return labels.join(hit, ["image_id", "box_id"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("labels"), F.count("hit").alias("on_boxes"))


def _met(found: DataFrame, annotated: DataFrame) -> DataFrame:
    """Every annotated box with each found one that overlaps it: the shares of either in it, and intersection over union."""
    one = _tiled(annotated)
    two = _tiled(found).select("image_id", "tile", *[F.col(c).alias(f"o{c}") for c in ("box_id", "x", "y", "w", "h")])
    wide = F.greatest(F.lit(0), F.least(F.col("x") + F.col("w"), F.col("ox") + F.col("ow")) - F.greatest("x", "ox"))
    high = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), F.col("oy") + F.col("oh")) - F.greatest("y", "oy"))
    met, own, other = wide * high, F.col("w") * F.col("h"), F.col("ow") * F.col("oh")
    pairs = one.join(two, ["image_id", "tile"]).where(met > 0)
    return pairs.select("image_id", "box_id", "obox_id", F.round(met / own, 9).alias("cover"), F.round(met / other, 9).alias("share"), F.round(met / (own + other - met), 9).alias("iou")).distinct()


def best_matches(found: DataFrame, annotated: DataFrame, cover: float = 0.9, share: float = 1 / 3) -> DataFrame:
    """(image_id, box_id, match, cover, share, iou, found): for each annotated box its best found one: one that covers `cover` of it
    and is `share` its own, then the largest intersection over union, then the lowest id."""
    pairs = _met(found, annotated).withColumn("found", (F.col("cover") >= cover) & (F.col("share") >= round(share, 9)))
    best = pairs.groupBy("image_id", "box_id").agg(F.max(F.struct("found", "iou", (-F.col("obox_id")).alias("o"), "cover", "share")).alias("best"))
    out = annotated.select("image_id", "box_id").join(best, ["image_id", "box_id"], "left")
    zero = lambda c: F.coalesce(f"best.{c}", F.lit(0.0)).alias(c)
    return out.select("image_id", "box_id", (-F.col("best.o")).alias("match"), zero("cover"), zero("share"), zero("iou"), F.coalesce("best.found", F.lit(False)).alias("found"))


def found_recall(found: DataFrame, annotated: DataFrame, cover: float = 0.9, share: float = 1 / 3) -> DataFrame:
    """(image_id, annotated, recall, stray): the share of annotated boxes that are found, and found boxes that are on none."""
    matched = best_matches(found, annotated, cover, share).groupBy("image_id").agg(F.count(F.lit(1)).alias("annotated"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"))
    on = _met(found, annotated).where(F.col("share") >= round(share, 9)).select("image_id", F.col("obox_id").alias("box_id")).distinct()
    stray = found.join(on, ["image_id", "box_id"], "left_anti").groupBy("image_id").agg(F.count(F.lit(1)).alias("stray"))
    return matched.join(stray, "image_id", "full").select("image_id", F.coalesce("annotated", F.lit(0)).alias("annotated"), "recall", F.coalesce("stray", F.lit(0)).alias("stray"))


def overlapping(boxes: DataFrame) -> DataFrame:
    """(image_id, boxes, overlapping): boxes that overlap another."""
    pairs = overlaps(boxes)
    met = pairs.select("image_id", F.col("a").alias("box_id")).union(pairs.select("image_id", "b")).distinct().withColumn("hit", F.lit(1))
    return boxes.join(met, ["image_id", "box_id"], "left").groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"), F.count("hit").alias("overlapping"))


def box_regions(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, region_id, area, covered, mostly): how much of each region any box covers, and whether it is over half."""
    marked = px.where("region_id >= 0").join(box_mask(px, boxes).withColumn("hit", F.lit(True)), ["image_id", "x", "y"], "left")
    sums = marked.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("area"), F.count("hit").alias("covered"))
    return sums.withColumn("mostly", F.col("covered") * 2 > F.col("area"))


def region_density(px: DataFrame, boxes: DataFrame, px_per_mm: float) -> DataFrame:
    """(image_id, mostly, per_dm2, background): regions mostly inside the boxes, as a number and for 100 square cm of them, and
    regions without a pixel in any."""
    found = box_regions(px, boxes).groupBy("image_id").agg(F.count_if("mostly").alias("mostly"), F.count_if(F.col("covered") == 0).alias("background"))
    area = box_mask(px, boxes).groupBy("image_id").agg(F.count(F.lit(1)).alias("inside"))
    per = F.round(F.col("mostly") / (F.col("inside") / (px_per_mm * px_per_mm * 10_000)), 6)
    return found.join(area, "image_id", "left").select("image_id", "mostly", per.alias("per_dm2"), "background")


def density_ratio(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, inside, outside, ratio): regions a pixel, inside and outside of the boxes; a region counts in parts by its pixels."""
    marked = px.where("region_id >= 0").join(box_mask(px, boxes).withColumn("hit", F.lit(True)), ["image_id", "x", "y"], "left")
    split = marked.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("area"), F.count("hit").alias("covered"))
    sums = split.groupBy("image_id").agg((F.sum(F.col("covered") / F.col("area")) / F.nullif(F.sum("covered"), F.lit(0))).alias("i"), (F.sum(1 - F.col("covered") / F.col("area")) / F.nullif(F.sum(F.col("area") - F.col("covered")), F.lit(0))).alias("o"))
    return sums.select("image_id", F.round("i", 9).alias("inside"), F.round("o", 9).alias("outside"), F.round(F.col("i") / F.nullif(F.col("o"), F.lit(0.0)), 6).alias("ratio"))


def scaled_boxes(boxes: DataFrame, sx: float, sy: float, width: int, height: int) -> DataFrame:
    """(image_id, box_id, x, y, w, h) at another size: rounded outwards with a slack of 1e-9, cut to the picture."""
    lo = lambda v, s: F.greatest(F.lit(0), F.floor(v * s + 1e-9))
    hi = lambda v, s, most: F.least(F.lit(most), F.ceil(v * s - 1e-9))
    x0, y0 = lo(F.col("x"), sx), lo(F.col("y"), sy)
    x1, y1 = hi(F.col("x") + F.col("w"), sx, width), hi(F.col("y") + F.col("h"), sy, height)
    return boxes.select("image_id", "box_id", x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h"))


def in_quads(points: DataFrame, quads: DataFrame) -> DataFrame:
    """(image_id, point_id, quad_id): points in a convex quad of their picture, its edges included; a quad without area holds nothing.

    points (image_id, point_id, x, y), quads (image_id, quad_id, quad array of four struct<x, y>)."""
    xs, ys = F.transform("quad", lambda p: p["x"]), F.transform("quad", lambda p: p["y"])
    dealt = quads.withColumn("tile", F.explode(_tiles(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))))
    at = points.withColumn("tile", F.struct(F.floor(F.col("x") / TILE).cast("int").alias("tx"), F.floor(F.col("y") / TILE).cast("int").alias("ty")))
    following = F.concat(F.slice("quad", 2, 3), F.slice("quad", 1, 1))
    side = F.zip_with("quad", following, lambda p, q: (q["x"] - p["x"]) * (F.col("y") - p["y"]) - (q["y"] - p["y"]) * (F.col("x") - p["x"]))
    area = F.aggregate(F.zip_with("quad", following, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = at.join(dealt, ["image_id", "tile"]).withColumns({"side": side, "area": area})
    inside = F.forall("side", lambda v: v >= 0) | F.forall("side", lambda v: v <= 0)
    return both.where(inside & (F.col("area") != 0)).select("image_id", "point_id", "quad_id")


def near_another(points: DataFrame, limit: float) -> DataFrame:
    """(image_id, point_id): points with another one of their picture nearer than a distance."""
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    own = points.withColumns({"cx": cell("x"), "cy": cell("y")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = own.withColumn("s", F.explode(steps)).select("image_id", F.col("point_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    close = own.join(sent, ["image_id", "cx", "cy"]).where((F.col("point_id") != F.col("other")) & (dx * dx + dy * dy < limit * limit))
    return close.select("image_id", "point_id").distinct()


def outline_pixels(outlines: DataFrame, width: int, height: int) -> DataFrame:
    """(outline_id, y, x0, x1): even-odd filled rows of polygons, half-open runs of pixels whose middles lie inside.

    outlines (outline_id, pts array of struct<x, y>). Edges take rows by their half-open span; crossings of a row are paired in order."""
    following = F.concat(F.slice("pts", F.lit(2), F.size("pts") - 1), F.slice("pts", 1, 1))
    edges = outlines.select("outline_id", F.explode(F.arrays_zip(F.col("pts").alias("p"), following.alias("q"))).alias("e")).select("outline_id", *[F.col(f"e.{a}.{b}").cast("double").alias(f"{b}{a}") for a in "pq" for b in "xy"])
    lo, hi = F.least("yp", "yq"), F.greatest("yp", "yq")
    first, last = F.greatest(F.ceil(lo - 0.5), F.lit(0)), F.least(F.ceil(hi - 0.5) - 1, F.lit(height - 1))
    rows = edges.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    crossed = rows.withColumn("at", F.col("xp") + (F.col("y") + 0.5 - F.col("yp")) * (F.col("xq") - F.col("xp")) / (F.col("yq") - F.col("yp")))
    listed = crossed.groupBy("outline_id", "y").agg(F.sort_array(F.collect_list("at")).alias("at"))  # as many as the outline has edges
    spans = listed.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("at") / 2) - 1)))
    edge = lambda i: F.least(F.greatest(F.ceil(F.element_at("at", (2 * F.col("k") + i).cast("int")) - 0.5), F.lit(0)), F.lit(width)).cast("int")
    return spans.select("outline_id", F.col("y").cast("int").alias("y"), edge(1).alias("x0"), edge(2).alias("x1")).where("x0 < x1")
