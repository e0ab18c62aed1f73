"""Relational operators over region maps: bounds, adjacency, contacts, runs, walls, cracks.

A map is a relation (image_id, x, y, region_id, ..); region_id -1 is no region. Neighbours come from windows over rows,
columns and diagonals of one picture, so no operator joins the pixels with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The four directions of a contact: along a row, along a column, and the two diagonals (step of x, step of y).
SIDES, CORNERS = ((1, 0), (0, 1)), ((1, 1), (-1, 1))


def neighbor(dx: int, dy: int, value: str):
    """The value of the pixel at (x + dx, y + dy); null where there is none."""
    if dy == 0:
        line, at = ["image_id", "y"], F.col("x")
    elif dx == 0:
        line, at = ["image_id", "x"], F.col("y")
    else:
        line, at = ["image_id", (F.col("x") - F.col("y") if dx == dy else F.col("x") + F.col("y"))], F.col("y")
    step = dx if dy == 0 else dy
    order = Window.partitionBy(*line).orderBy(at)
    there, where = (F.lead, step) if step > 0 else (F.lag, -step)
    return F.when(there(at, where).over(order) == at + step, there(value, where).over(order))


def pairs(px: DataFrame, value: str = "region_id", corners: bool = True) -> DataFrame:
    """(image_id, x, y, a, b, dx, dy): every two touching pixels once, with their values."""
    found = [(dx, dy) for dx, dy in (SIDES + CORNERS if corners else SIDES)]
    wide = px.select("image_id", "x", "y", F.col(value).alias("a"))
    for i, (dx, dy) in enumerate(found):
        wide = wide.withColumn(f"n{i}", neighbor(dx, dy, "a"))
    each = F.array(*[F.struct(F.col(f"n{i}").alias("b"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(found)])
    return wide.select("image_id", "x", "y", "a", F.explode(each).alias("t")).select("image_id", "x", "y", "a", "t.b", "t.dx", "t.dy").where("b is not null")


def region_bounds(px: DataFrame, inside: str = "false") -> DataFrame:
    """(image_id, region_id, x0, y0, x1, y1, area, inside): inclusive box, pixels, and pixels where `inside` holds."""
    return px.where("region_id >= 0").groupBy("image_id", "region_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"), F.count_if(F.expr(inside)).alias("inside")
    )


def region_census(px: DataFrame, printed: str) -> DataFrame:
    """(image_id, region_id, area, unprinted, touched): touched if another region lies beside one of its pixels."""
    ids = px.where("region_id >= 0")
    sizes = ids.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("area"), F.count_if(~F.expr(printed)).alias("unprinted"))
    beside = contacts(px, True).where("a >= 0")
    met = beside.select("image_id", F.col("a").alias("region_id")).union(beside.select("image_id", "b")).distinct().withColumn("touched", F.lit(True))
    return sizes.join(met, ["image_id", "region_id"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))


def contacts(px: DataFrame, corners: bool = True) -> DataFrame:
    """(image_id, a, b): the pairs of different values that touch, the smaller first; -1 counts as a value."""
    found = pairs(px, corners=corners).where("a <> b")
    return found.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def strays(px: DataFrame, allowed: DataFrame, corners: bool = True) -> DataFrame:
    """(image_id, x, y): pixels that take part in a contact that is not allowed."""
    found = pairs(px, corners=corners).where("a <> b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    wrong = found.join(allowed.select("image_id", F.col("a").alias("lo"), F.col("b").alias("hi")), ["image_id", "lo", "hi"], "left_anti")
    return wrong.select("image_id", "x", "y").union(wrong.select("image_id", F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))).distinct()


def most_touched(px: DataFrame, corners: bool = True) -> DataFrame:
    """(image_id, region_id, neighbor, shared): the region that shares most pixel pairs with each region, the lowest of equals."""
    found = pairs(px, corners=corners).where("a <> b and a >= 0 and b >= 0")
    each = found.select("image_id", F.col("a").alias("region_id"), F.col("b").alias("neighbor")).union(found.select("image_id", "b", "a"))
    shared = each.groupBy("image_id", "region_id", "neighbor").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("image_id", "region_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "neighbor")).alias("best"))
    return best.select("image_id", "region_id", F.col("best.neighbor").alias("neighbor"), (-F.col("best.s")).alias("shared"))


def ring_owners(px: DataFrame) -> DataFrame:
    """(image_id, region_id, owner, pixels): different pixels around each region, by whose they are."""
    found = pairs(px).where("a <> b")
    there = found.select("image_id", F.col("a").alias("region_id"), F.col("b").alias("owner"), (F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py"))
    back = found.select("image_id", F.col("b"), F.col("a"), F.col("x"), F.col("y"))
    return there.union(back).where("region_id >= 0").distinct().groupBy("image_id", "region_id", "owner").agg(F.count(F.lit(1)).alias("pixels"))


def ink_is_main_neighbor(px: DataFrame) -> DataFrame:
    """(image_id, region_id, ink, most, main): whether ink (-1) owns at least as many of the pixels around a region as any region."""
    owned = ring_owners(px).groupBy("image_id", "region_id").agg(F.coalesce(F.sum(F.when(F.col("owner") < 0, F.col("pixels"))), F.lit(0)).alias("ink"), F.coalesce(F.max(F.when(F.col("owner") >= 0, F.col("pixels"))), F.lit(0)).alias("most"))
    return owned.withColumn("main", (F.col("ink") > 0) & (F.col("ink") >= F.col("most")))


def row_runs(px: DataFrame, value: str = "label") -> DataFrame:
    """(image_id, y, x0, x1, value): runs of equal pixels in a row, half-open."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    fresh = F.coalesce((F.lag(value).over(row) != F.col(value)) | (F.lag("x").over(row) != F.col("x") - 1), F.lit(True))
    marked = px.select("image_id", "y", "x", F.col(value).alias("value"), fresh.cast("int").alias("fresh"))
    numbered = marked.withColumn("run", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.first("value").alias("value")).drop("run")


def cracks(px: DataFrame, value: str = "region_id") -> DataFrame:
    """(image_id, i, j, degree): corners of the pixel grid with the number of cracks that meet there. A crack parts two
    pixels of different values, or a pixel from the outside; corner (i, j) is the point (j - 0.5, i - 0.5)."""
    wide = px.select("image_id", "x", "y", F.col(value).alias("v"))
    wide = wide.withColumns({"right": neighbor(1, 0, "v"), "left": neighbor(-1, 0, "v"), "down": neighbor(0, 1, "v"), "up": neighbor(0, -1, "v")})
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    ends = lambda i1, j1, i2, j2: F.array(F.struct(i1.alias("i"), j1.alias("j")), F.struct(i2.alias("i"), j2.alias("j")))
    none = F.array().cast("array<struct<i:int,j:int>>")
    sides = [
        F.when(F.col("right").isNull() | (F.col("right") != v), ends(y, x + 1, y + 1, x + 1)).otherwise(none),
        F.when(F.col("left").isNull(), ends(y, x, y + 1, x)).otherwise(none),
        F.when(F.col("down").isNull() | (F.col("down") != v), ends(y + 1, x, y + 1, x + 1)).otherwise(none),
        F.when(F.col("up").isNull(), ends(y, x, y, x + 1)).otherwise(none),
    ]
    corner = wide.select("image_id", F.explode(F.concat(*sides)).alias("c")).select("image_id", "c.i", "c.j")
    return corner.groupBy("image_id", "i", "j").agg(F.count(F.lit(1)).alias("degree"))


def boundary_pixels(px: DataFrame, value: str = "region_id") -> DataFrame:
    """(image_id, x, y): pixels that differ from their left or upper neighbour."""
    wide = px.select("image_id", "x", "y", F.col(value).alias("v")).withColumns({"left": neighbor(-1, 0, "v"), "up": neighbor(0, -1, "v")})
    return wide.where("left <> v or up <> v").select("image_id", "x", "y")


def same_color_boundary(px: DataFrame) -> DataFrame:
    """(image_id, share): share of the boundary between regions that parts regions of one colour; null without a boundary.
    A diagonal contact counts 1 / sqrt 2 of a straight one."""
    both = pairs(px.withColumn("both", F.struct("region_id", "label")), "both")
    weight = F.when(F.col("dx") * F.col("dy") == 0, 1.0).otherwise(0.5**0.5)
    cut = both.where("a.region_id <> b.region_id and a.region_id >= 0 and b.region_id >= 0").withColumn("w", weight)
    return cut.groupBy("image_id").agg(F.round(F.sum(F.when(F.col("a.label") == F.col("b.label"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("share"))


def compactness(px: DataFrame) -> DataFrame:
    """(image_id, region_id, area, compactness): 4 pi area over the square of the perimeter, at most 1. The perimeter is
    Cauchy's and Crofton's from the crossings of lines in four directions."""
    everything = F.lit(0.0)
    wide = px.select("image_id", "x", "y", "region_id")
    for dx, dy in SIDES + CORNERS:
        spacing = 1.0 if dx * dy == 0 else 0.5**0.5
        for s in (1, -1):
            there = neighbor(s * dx, s * dy, "region_id")
            everything = everything + F.when(F.coalesce(there, F.lit(-2)) != F.col("region_id"), spacing).otherwise(0.0)
    crossed = wide.withColumn("crossed", everything).where("region_id >= 0")
    sums = crossed.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("area"), F.sum("crossed").alias("crossed"))
    perimeter = F.lit(3.141592653589793 / 8) * F.col("crossed")
    return sums.select("image_id", "region_id", "area", F.round(F.least(F.lit(1.0), 4 * 3.141592653589793 * F.col("area") / (perimeter * perimeter)), 6).alias("compactness"))


def thin_pixels(px: DataFrame, ink: str) -> DataFrame:
    """(image_id, x, y, ink): pixels of one pixel's thickness in some of four directions: both neighbours are of the other kind."""
    wide = px.withColumn("ink", F.expr(ink)).select("image_id", "x", "y", "ink")
    test = F.lit(False)
    for dx, dy in SIDES + CORNERS:
        test = test | ((neighbor(dx, dy, "ink") != F.col("ink")) & (neighbor(-dx, -dy, "ink") != F.col("ink")))
    return wide.withColumn("thin", F.coalesce(test, F.lit(False))).where("thin").drop("thin")


def claim_walls(px: DataFrame, ink: str) -> DataFrame:
    """(image_id, x, y): of two touching pixels with different claims one is a wall: the inked one, else the higher claim."""
    both = pairs(px.withColumn("both", F.struct("region_id", F.expr(ink).alias("ink"))), "both").where("a.region_id <> b.region_id and a.region_id >= 0 and b.region_id >= 0")
    first = F.when(F.col("a.ink") != F.col("b.ink"), F.col("a.ink")).otherwise(F.col("a.region_id") > F.col("b.region_id"))
    return both.select("image_id", F.when(first, F.col("x")).otherwise(F.col("x") + F.col("dx")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("y") + F.col("dy")).alias("y")).distinct()


def settle_gaps(px: DataFrame, piece: str, claim: str, paintable: str = "false") -> DataFrame:
    """(image_id, piece, claim, pixels): each piece that is not paintable goes to the claim (0 and up) most of its claimed pixels have,
    the lowest of equals. Pixels without a claim have no vote and stay without one."""
    votes = px.where(f"not ({paintable}) and ({claim}) >= 0 and ({piece}) >= 0").groupBy("image_id", F.expr(piece).alias("piece"), F.expr(claim).alias("claim")).agg(F.count(F.lit(1)).alias("pixels"))
    best = votes.groupBy("image_id", "piece").agg(F.min(F.struct((-F.col("pixels")).alias("p"), "claim")).alias("best"))
    return best.select("image_id", "piece", F.col("best.claim").alias("claim"), (-F.col("best.p")).alias("pixels"))


def pocket_contacts(px: DataFrame, pocket: str, wall: str) -> DataFrame:
    """(image_id, pocket, contacts, walls): ordered contacts of a pocket's pixels with what is not in it, and how many of those
    are walls. The outside of the picture counts as a contact but not as a wall."""
    wide = px.select("image_id", "x", "y", F.expr(pocket).alias("pocket"), F.expr(wall).alias("wall"))
    count, walls = F.lit(0), F.lit(0)
    for dx, dy in SIDES + CORNERS:
        for s in (1, -1):
            other = F.coalesce(neighbor(s * dx, s * dy, "pocket"), F.lit(-2)) != F.col("pocket")
            count = count + other.cast("int")
            walls = walls + (other & F.coalesce(neighbor(s * dx, s * dy, "wall"), F.lit(False))).cast("int")
    found = wide.withColumns({"c": count, "w": walls}).where("pocket >= 0")
    return found.groupBy("image_id", "pocket").agg(F.sum("c").alias("contacts"), F.sum("w").alias("walls"))


def regions_joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, region_id, parts): regions of the new map that hold pixels of two regions of the old one or more."""
    both = old.select("image_id", "x", "y", F.col("region_id").alias("before")).join(new.select("image_id", "x", "y", "region_id"), ["image_id", "x", "y"])
    held = both.where("before >= 0 and region_id >= 0").groupBy("image_id", "region_id").agg(F.count_distinct("before").alias("parts"))
    return held.where("parts > 1")


def same_partition(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, identical): whether two maps cut a picture the same way, whatever their numbers."""
    both = first.select("image_id", "x", "y", F.col("region_id").alias("a")).join(second.select("image_id", "x", "y", F.col("region_id").alias("b")), ["image_id", "x", "y"])
    kinds = both.groupBy("image_id").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.count_distinct("a", "b").alias("nab"))
    return kinds.select("image_id", ((F.col("na") == F.col("nab")) & (F.col("nb") == F.col("nab"))).alias("identical"))


def undersized(px: DataFrame, least: int) -> DataFrame:
    """(image_id, undersized): regions below an area that have a neighbour to join."""
    found = region_census(px, "false")
    return found.groupBy("image_id").agg(F.count_if((F.col("area") < least) & F.col("touched")).alias("undersized"))


def paint_gaps(px: DataFrame, white: str) -> DataFrame:
    """(image_id, x, y): the first of two pixels side by side that are both white and in different regions: where paint would run
    together."""
    both = pairs(px.withColumn("both", F.struct("region_id", F.expr(white).alias("white"))), "both", corners=False)
    return both.where("a.white and b.white and a.region_id <> b.region_id").select("image_id", "x", "y").distinct()


def slivers(px: DataFrame, radius: float) -> DataFrame:
    """(image_id, x, y, sliver): pixels of regions, and whether no brush of that radius inside their region reaches them. A picture to
    a task."""
    import numpy as np
    import pandas as pd

    from .brush import slivers as kernel
    from .pictures import _grid, _kind

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = _grid(rows, "region_id", -1)
        y, x = np.nonzero(ids >= 0)
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "x": x.astype(np.int32), "y": y.astype(np.int32), "sliver": kernel(ids, radius)[y, x]})

    return px.select("image_id", "x", "y", "region_id").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, sliver boolean")


def compactness_stats(px: DataFrame) -> DataFrame:
    """(image_id, median, p10) of the regions' compactness."""
    return compactness(px).groupBy("image_id").agg(F.round(F.percentile("compactness", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("compactness", F.lit(0.1)), 6).alias("p10"))


def paper_rings(px: DataFrame, paper: str, piece: str) -> DataFrame:
    """(image_id, piece, least, most): smallest and largest region around each piece of paper."""
    both = pairs(px.withColumn("both", F.struct("region_id", F.expr(piece).alias("piece"), F.expr(paper).alias("paper"))), "both")
    out = both.where("a.paper and not b.paper").select("image_id", F.col("a.piece").alias("piece"), F.col("b.region_id").alias("region_id"))
    back = both.where("b.paper and not a.paper").select("image_id", F.col("b.piece").alias("piece"), F.col("a.region_id").alias("region_id"))
    return out.union(back).groupBy("image_id", "piece").agg(F.min("region_id").alias("least"), F.max("region_id").alias("most"))


def closed_breaks(px: DataFrame, mask: str, gap: int) -> DataFrame:
    """(image_id, x, y): pixels of a mask after breaks of up to `gap` pixels are closed along rows, columns and diagonals (there
    up to gap / sqrt 2 pixels, at least one)."""
    wide = px.select("image_id", "x", "y", F.expr(mask).alias("m"))
    lines = [(["image_id", "y"], "x", max(1, gap)), (["image_id", "x"], "y", max(1, gap))]
    lines += [(["image_id", F.col("x") - F.col("y")], "y", max(1, int(gap / 2**0.5))), (["image_id", F.col("x") + F.col("y")], "y", max(1, int(gap / 2**0.5)))]
    filled = F.col("m")
    for line, at, most in lines:
        along = Window.partitionBy(*line).orderBy(at)
        before = F.max(F.when(F.col("m"), F.col(at))).over(along.rowsBetween(Window.unboundedPreceding, 0))
        after = F.min(F.when(F.col("m"), F.col(at))).over(along.rowsBetween(0, Window.unboundedFollowing))
        filled = filled | F.coalesce(after - before - 1 <= most, F.lit(False))
    return wide.withColumn("filled", filled).where("filled").select("image_id", "x", "y")
