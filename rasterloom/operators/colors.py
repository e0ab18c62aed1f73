"""Colour operators over pixel and palette relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import color as C

#: A palette has 64 colours at most, so it may be broadcast.
PALETTE_ROWS = 64


def with_colors(palette: DataFrame) -> DataFrame:
    """The palette with its Lab values, made safe to broadcast: more rows than a palette can have are an error."""
    if palette.limit(PALETTE_ROWS + 1).count() > PALETTE_ROWS:
        raise ValueError(f"a palette has {PALETTE_ROWS} colours at most")
    return C.with_lab(palette)


def _palette_rows(palette: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(colors, Lab rows) of a palette, in the order of its colours; its size is checked."""
    rows = palette.select("color", "b", "g", "r").orderBy("color").limit(PALETTE_ROWS + 1).collect()
    if len(rows) > PALETTE_ROWS:
        raise ValueError(f"a palette has {PALETTE_ROWS} colours at most")
    return np.array([r["color"] for r in rows], np.int64), C.lab_array(np.array([[r["b"], r["g"], r["r"]] for r in rows]).reshape(-1, 3))


def nearest_color(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(b, g, r, n, color, de00): every different pixel colour, how many pixels have it, and the palette colour closest by
    CIEDE2000, the first of equals. Distances are worked out once for each colour, not for each pixel, in one pass over the
    different colours with the palette at hand: a second aggregation would sort all pairs."""
    colors, labs = _palette_rows(palette)
    few = pixels.groupBy("b", "g", "r").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            bgr = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            row, far = C.nearest_array(C.lab_array(bgr), labs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(colors[row].astype(np.int32)), pa.array(far)], ["b", "g", "r", "n", "color", "de00"])

    return few.mapInArrow(run, StructType([*few.schema, StructField("color", IntegerType()), StructField("de00", DoubleType())])) if len(colors) else few.selectExpr("*", "cast(null as int) as color", "cast(null as double) as de00")


def legend(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(number, color, b, g, r, pixels, share, mean_de00): the used colours, numbered from dark to light."""
    used = nearest_color(pixels, palette).groupBy("color").agg(F.sum("n").alias("pixels"), (F.sum(F.col("de00") * F.col("n")) / F.sum("n")).alias("mean_de00"))
    total = Window.partitionBy()  # over the rows of a palette
    out = used.join(F.broadcast(with_colors(palette)), "color")
    return out.select(
        F.row_number().over(Window.orderBy(F.round("lab.L", 9), "color")).alias("number"), "color", "b", "g", "r", "pixels",
        F.round(F.col("pixels") / F.sum("pixels").over(total), 9).alias("share"), F.round("mean_de00", 6).alias("mean_de00"),
    )


def pairwise_de00(palette: DataFrame) -> DataFrame:
    """(first, second, de00) of every two colours of a palette."""
    pal = with_colors(palette)
    one, two = pal.select(F.col("color").alias("first"), F.col("lab").alias("one")), pal.select(F.col("color").alias("second"), F.col("lab").alias("two"))
    return C.de00(one.join(F.broadcast(two), F.col("first") < F.col("second")), "one", "two").select("first", "second", F.round("de00", 6).alias("de00"))


def palette_separation(palette: DataFrame, least: float = 10.0) -> DataFrame:
    """(min_de00, close_pairs): the closest two colours of a palette and how many are closer than a margin."""
    return pairwise_de00(palette).agg(F.min("de00").alias("min_de00"), F.count_if(F.col("de00") < least).alias("close_pairs"))


def color_histogram(pixels: DataFrame, step: float = 4.0) -> DataFrame:
    """(l, a, b, n, L_mean): pixels by cubes of Lab."""
    few = C.with_lab(pixels.groupBy("b", "g", "r").agg(F.count(F.lit(1)).alias("n")))
    cell = lambda c: F.floor(F.round(F.col(f"lab.{c}"), 9) / step).cast("int")
    cells = few.select(cell("L").alias("l"), cell("a").alias("a"), cell("b").alias("b"), "n", (F.col("lab.L") * F.col("n")).alias("sum"))
    return cells.groupBy("l", "a", "b").agg(F.sum("n").alias("n"), F.round(F.sum("sum") / F.sum("n"), 6).alias("L_mean"))


def neighborhood(histogram: DataFrame) -> DataFrame:
    """(l, a, b, n, near): pixels in a cube and in the 27 around it; a cube sends its count to its neighbours, and the sums meet."""
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    out = histogram.select("l", "a", "b", "n")
    for axis in ("l", "a", "b"):
        out = out.withColumn(f"d{axis}", F.explode(around))
    sent = out.select(*[(F.col(x) + F.col(f"d{x}")).alias(x) for x in ("l", "a", "b")], F.col("n").alias("part"), (F.abs("dl") + F.abs("da") + F.abs("db") == 0).alias("own"))
    summed = sent.groupBy("l", "a", "b").agg(F.sum(F.when(F.col("own"), F.col("part"))).alias("n"), F.sum("part").alias("near"))
    return summed.where("n is not null")


def ink_mixes(palette: DataFrame, steps: int = 8) -> DataFrame:
    """(first, second, step, b, g, r): mixes of every two colours in equal steps."""
    one = palette.select(F.col("color").alias("first"), *[F.col(c).alias(f"{c}1") for c in "bgr"])
    two = palette.select(F.col("color").alias("second"), *[F.col(c).alias(f"{c}2") for c in "bgr"])
    pairs = one.join(F.broadcast(two), F.col("first") < F.col("second")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    mix = lambda c: (F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("step") / steps).alias(c)
    return pairs.select("first", "second", "step", mix("b"), mix("g"), mix("r"))


def region_colors(pixels: DataFrame, own: str) -> DataFrame:
    """(region_id, b, g, r, n): mean colour of each region's own pixels, or of all of them where it has none."""
    hit = F.expr(own)
    mean = lambda c: F.coalesce(F.avg(F.when(hit, F.col(c))), F.avg(c))
    return pixels.where("region_id >= 0").groupBy("image_id", "region_id").agg(*[F.round(mean(c), 6).alias(c) for c in "bgr"], F.count(F.lit(1)).alias("n"))


def mean_de00(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(image_id, pixels, de00_mean, de00_p95) of two pictures of the same size; each two colours are compared once, and the
    percentile is that of pairs of colours weighted by their pixels."""
    pairs = first.select(*keys, *[F.col(c).alias(f"{c}1") for c in "bgr"]).join(second.select(*keys, *[F.col(c).alias(f"{c}2") for c in "bgr"]), keys)
    few = pairs.groupBy(keys[0], *[f"{c}{i}" for i in (1, 2) for c in "bgr"]).agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            one, two = (np.stack([batch.column(f"{c}{i}").to_numpy(zero_copy_only=False) for c in "bgr"], axis=1) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n"), pa.array(C.de00_array(C.lab_array(one), C.lab_array(two)))], [keys[0], "n", "de00"])

    far = few.mapInArrow(run, few.select(keys[0], "n").schema.add("de00", "double"))
    return far.groupBy(keys[0]).agg(F.sum("n").alias("pixels"), F.round(F.sum(F.col("de00") * F.col("n")) / F.sum("n"), 6).alias("de00_mean"), F.round(F.percentile("de00", F.lit(0.95), F.col("n")), 6).alias("de00_p95"))


def flat_color_match(flats: DataFrame, palette: DataFrame) -> DataFrame:
    """(flats, de00_mean, de00_max): how far the different flat colours (b, g, r) of a picture are from the closest colours of its legend."""
    nearest = nearest_color(flats, palette)
    return nearest.agg(F.count(F.lit(1)).alias("flats"), F.round(F.avg("de00"), 6).alias("de00_mean"), F.round(F.max("de00"), 6).alias("de00_max"))


def swatches(palette: DataFrame, per_row: int = 5, swatch_mm: float = 12.0, gap_mm: float = 3.0) -> DataFrame:
    """(number, row, col, x_mm, y_mm, b, g, r, tint_b, tint_g, tint_r, text_gray): the legend as a grid of swatches."""
    at = F.row_number().over(Window.orderBy("color")) - 1  # a palette's rows
    step = swatch_mm + gap_mm
    out = palette.withColumn("at", at).withColumns({"row": F.floor(F.col("at") / per_row).cast("int"), "col": (F.col("at") % per_row).cast("int")})
    return out.select(
        (F.col("at") + 1).alias("number"), "row", "col", (gap_mm + F.col("col") * step).alias("x_mm"), (gap_mm + F.col("row") * step).alias("y_mm"), "b", "g", "r",
        *[C.tint(F.col(c)).alias(f"tint_{c}") for c in "bgr"], C.number_fill(F.col("b"), F.col("g"), F.col("r")).alias("text_gray"),
    )


def ink_gray(pixels: DataFrame, where: str) -> DataFrame:
    """(image_id, gray): median luma of the pixels of a mask, cut to a whole number; 0 where it has none."""
    value = F.percentile(F.when(F.expr(where), F.floor(C.luma(F.col("b"), F.col("g"), F.col("r")) + 0.5)), F.lit(0.5))
    return pixels.groupBy("image_id").agg(F.coalesce(F.floor(value), F.lit(0)).cast("int").alias("gray"))
