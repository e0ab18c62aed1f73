"""Print geometry and settings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An A4 sheet and its margin in mm, the print resolution, the preview's long edge.
SHEET, MARGIN, DPI, PREVIEW = (210.0, 297.0), 10.0, 300.0, 1100
MM_PER_INCH, PT_PER_INCH = 25.4, 72.0

# Name, least, most, whole, unit.
SETTINGS = (
    ("num_colors", 2.0, 64.0, True, ""), ("palette_margin_de00", 0.0, 20.0, False, "dE"), ("min_region_area_mm2", 2.0, 500.0, False, "mm2"), ("min_width_mm", 0.5, 6.0, False, "mm"), ("brush_px", 2.0, 8.0, False, "px"),
    ("sharpest_corner_deg", 5.0, 180.0, False, "deg"), ("corner_contrast_de00", 0.0, 60.0, False, "dE"), ("blur_sigma", 0.0, 12.0, False, ""), ("edge_settling", 0.0, 3.0, False, ""), ("edge_color_step_de00", 1.0, 40.0, False, "dE"),
    ("detail_weight", 1.0, 4.0, True, ""), ("mark_contrast", 2.0, 50.0, False, "L"), ("mark_length_mm", 0.5, 10.0, False, "mm"), ("face_tone_step_de00", 0.0, 5.0, False, "dE"), ("line_width_mm", 0.1, 1.0, False, "mm"),
    ("line_smoothing_mm", 0.0, 2.0, False, "mm"), ("min_label_pt", 3.0, 12.0, False, "pt"), ("leader_reach_mm", 1.0, 20.0, False, "mm"), ("text_gap_mm", 0.0, 3.0, False, "mm"), ("thin_ink_mm", 0.0, 5.0, False, "mm"),
    ("ink_gap_mm", 0.0, 3.0, False, "mm"), ("text_max_height_mm", 5.0, 60.0, False, "mm"),
)


def px_per_mm(width: Column, height: Column) -> Column:
    """Scale at which a picture fits the printable area, turned if it is wider than high."""
    short, long = SHEET[0] - 2 * MARGIN, SHEET[1] - 2 * MARGIN
    wide = width > height
    across, down = F.when(wide, F.lit(long)).otherwise(F.lit(short)), F.when(wide, F.lit(short)).otherwise(F.lit(long))
    return 1 / F.least(across / width, down / height)


def print_scale(pictures: DataFrame, brush_mm: float = 0.7, area_mm2: float = 6.0, brush_px: float = 4.0) -> DataFrame:
    """`pictures` (width, height) with what the print size asks for: landscape, px_per_mm, dpi, the printed size, the long edges of
    an export and of the working page, the smallest region and the brush in pixels, and the smallest font that is 3 pt."""
    w, h = F.col("width"), F.col("height")
    df = pictures.withColumns({"landscape": w > h, "px_per_mm": px_per_mm(w, h)})
    scale = F.col("px_per_mm")
    df = df.withColumns({"printed_w_mm": w / scale, "printed_h_mm": h / scale, "dpi": scale * MM_PER_INCH})
    longest = F.greatest("printed_w_mm", "printed_h_mm")
    at_dpi = lambda dpi: F.rint(longest * dpi / MM_PER_INCH).cast("int")
    df = df.withColumn("export_edge", F.least(F.greatest(w, h).cast("int"), at_dpi(DPI)))
    footprint = math.pi * (brush_mm / 2) ** 2
    return df.withColumns({
        "working_edge": F.least("export_edge", F.greatest(F.lit(PREVIEW), at_dpi(brush_px / brush_mm * MM_PER_INCH))),
        "min_area_px": F.greatest(F.lit(4), F.rint(max(area_mm2, footprint) * scale * scale).cast("int")), "brush_px": brush_mm * scale,
        "font_px": F.greatest(F.lit(10), F.ceil(3.0 * scale * MM_PER_INCH / PT_PER_INCH - 1e-9).cast("int")),
    })


def clamped(values: DataFrame, settings: DataFrame) -> DataFrame:
    """values (name, value) with the value its setting allows, whole where it has to be, and its text with the unit."""
    held = F.least(F.greatest("value", "least"), "most")
    held = F.when(F.col("whole"), F.rint(held)).otherwise(held)
    out = values.join(F.broadcast(settings), "name").withColumn("held", held)
    text = F.when(F.col("whole"), F.col("held").cast("long").cast("string")).otherwise(F.format_string("%.2f", "held"))  # two places, as the finest step has
    return out.withColumn("text", F.when(F.col("unit") == "", text).otherwise(F.concat_ws(" ", text, "unit")))


def settings(spark) -> DataFrame:
    """The settings' ranges; a fixed number of rows."""
    return spark.createDataFrame(SETTINGS, "name string, least double, most double, whole boolean, unit string")


def preferred_font(radius: Column, floor: Column) -> Column:
    """Font size of a number in a region of that radius (fixed values: 0.85 of it, 40 px at most), not below the floor."""
    return F.greatest(floor, F.least(F.lit(40), F.floor(radius * 0.85).cast("int")))


def _corner(degrees: Column, value: Column) -> Column:
    """0 from 180 degrees on; an angle of 0 or less is an error."""
    return F.when(degrees >= 180, 0.0).when(degrees > 0, value).otherwise(F.raise_error(F.lit("a corner has an angle above 0")))


def tip_length(degrees: Column) -> Column:
    """How far the point of a corner lies beyond the brush, in radii."""
    return _corner(degrees, 1 / F.sin(F.radians(degrees) / 2) - 1)


def tip_depth(degrees: Column) -> Column:
    """Area that the brush can't reach in a corner over the length of the arc where it stops, in radii."""
    angle = F.radians(degrees)
    return _corner(degrees, (1 / F.tan(angle / 2) - (math.pi - angle) / 2) / (math.pi - angle))


# The levels of difficulty, and what they share; the finest page that pages are compared at.
LEVELS = (("Beginner", 16, 10.0, 1.0, 1.2), ("Easy", 20, 8.0, 0.8, 1.0), ("Medium", 24, 6.0, 0.7, 0.9), ("Hard", 28, 4.0, 0.6, 0.8), ("Realistic", 32, 2.0, 0.5, 0.7))
SHARED = (("palette_margin_de00", 4.0), ("edge_settling", 3.0), ("edge_color_step_de00", 1.0), ("detail_weight", 4.0), ("sharpest_corner_deg", 180.0), ("corner_contrast_de00", 0.0))
FINEST = (("num_colors", 40.0), ("min_region_area_mm2", 30.0), ("min_width_mm", 3.0), ("blur_sigma", 0.0), ("palette_margin_de00", 10.0), ("edge_settling", 1.0), ("edge_color_step_de00", 10.0), ("detail_weight", 2.0), ("sharpest_corner_deg", 180.0), ("corner_contrast_de00", 20.0))
LEVEL_SETTINGS = ("num_colors", "min_region_area_mm2", "min_width_mm", "blur_sigma")


def presets(spark) -> DataFrame:
    """(preset, name, value): every setting of every level of difficulty, and of the finest page; a fixed number of rows."""
    rows = [(level, n, float(v)) for level, *own in LEVELS for n, v in (*zip(LEVEL_SETTINGS, own, strict=True), *SHARED)]
    return spark.createDataFrame(rows + [("Finest", n, v) for n, v in FINEST], "preset string, name string, value double")


def params(chosen: DataFrame, presets: DataFrame, settings: DataFrame) -> DataFrame:
    """(id, name, value): the settings of each choice: those of its preset, with what it chose itself, held within range, in their
    place. chosen (id, preset, name, value); name is null where a choice is a preset alone. An unknown preset or name is an error."""
    known = presets.select("preset").distinct().withColumn("ok", F.lit(True))
    checked = chosen.join(F.broadcast(known), "preset", "left").withColumn("preset", F.when(F.col("ok"), F.col("preset")).otherwise(F.raise_error(F.concat(F.lit("no such preset: "), F.col("preset")))))
    base = checked.select("id", "preset").distinct().join(F.broadcast(presets), "preset")
    own = checked.where("name is not null").select("id", "name", "value").join(F.broadcast(settings), "name", "left")
    held = F.least(F.greatest("value", "least"), "most")
    held = F.when(F.col("least").isNull(), F.raise_error(F.concat(F.lit("no such setting: "), F.col("name")))).when(F.col("whole"), F.rint(held)).otherwise(held)
    both = base.select("id", "name", "value").join(own.select("id", "name", held.alias("own")), ["id", "name"], "full")
    return both.select("id", "name", F.coalesce("own", "value").alias("value"))


def described(params: DataFrame) -> DataFrame:
    """(id, text): the settings of each choice in words."""
    wide = params.groupBy("id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in (*LEVEL_SETTINGS, "palette_margin_de00", "detail_weight", "sharpest_corner_deg")])
    short = lambda c: F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")
    detail = F.when(F.col("detail_weight") == 1, "as much").when(F.col("detail_weight") == 2, "half that").otherwise(F.format_string("1/%d of that", F.col("detail_weight").cast("int")))
    corners = F.when(F.col("sharpest_corner_deg") < 180, F.concat(F.lit("corners down to "), short("sharpest_corner_deg"), F.lit(" degrees kept sharp"))).otherwise("corners rounded to the brush")
    return wide.select("id", F.concat(
        F.format_string("Up to %d colors, at least ", F.col("num_colors").cast("int")), short("palette_margin_de00"), F.format_string(" dE apart. Regions of at least %d mm2 (", F.rint("min_region_area_mm2").cast("int")),
        detail, F.lit(" on faces and the subject) and "), short("min_width_mm"), F.lit(" mm wide on paper, "), corners, F.lit("."),
    ).alias("text"))
