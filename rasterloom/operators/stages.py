"""Single stages of page making over many pictures: each kernel grouped by picture, spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import brush as B
from . import lineart as A
from . import numbers as N
from . import rings as R
from . import settle
from .pictures import _grid, _kind, _pixels, planes


def brush_regions(px: DataFrame, colors: int, least: int, width: float) -> DataFrame:
    """(image_id, x, y, region_id, color): regions of the label map of each picture (image_id, x, y, label) that a brush of a width can
    paint."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, color = B.build_regions(_grid(rows, "label", colors), colors, least, width)
        return _pixels(rows["image_id"].iloc[0], ids, region_id=ids, color=np.append(color, -1)[ids])

    return px.select("image_id", "x", "y", "label").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, region_id int, color int")


def corner_tips(px: DataFrame, radius: float, sharpest: float) -> DataFrame:
    """(image_id, x, y, tip): pixels of corners' tips that a brush does not reach, by regions (image_id, x, y, region_id)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tips = B.corner_tips(_grid(rows, "region_id", -1), radius, sharpest)
        return _pixels(rows["image_id"].iloc[0], tips, tip=tips)

    return px.select("image_id", "x", "y", "region_id").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, tip int")


def line_art(px: DataFrame, colors: int, least: int, width: float, thin: float) -> DataFrame:
    """(image_id, x, y, region_id, printed): areas of line art (image_id, x, y, label, b, g, r), whose ink is label `colors`; a palette
    colour is the mean of its pixels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bgr, labels = planes(rows), _grid(rows, "label", colors)
        palette = np.array([[np.rint(bgr[labels == k].mean(axis=0)) if (labels == k).any() else [0, 0, 0]][0] for k in range(colors)]).astype(np.uint8)
        ids, _, printed = A.line_art_regions(bgr, labels, palette, least, width, thin)
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "x": x, "y": y, "region_id": ids[y, x].astype(np.int32), "printed": printed[y, x]})

    return px.select("image_id", "x", "y", "label", "b", "g", "r").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, region_id int, printed boolean")


def numbers(px: DataFrame, spacing: N.Spacing = N.Spacing(least=5, gap=1.0, reach=20.0)) -> DataFrame:
    """(image_id, region_id, size, x0, y0, x1, y1, leader, cramped): a number for each region (image_id, x, y, region_id, label)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, labels = _grid(rows, "region_id", -1), _grid(rows, "label", 0)
        colors = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
        colors[ids[ids >= 0]] = labels[ids >= 0]
        free = np.ones(ids.shape, bool)
        for one, two, _, _ in B.G.touching(ids, False):
            free[two] &= ids[one] == ids[two]
        out = [(rows["image_id"].iloc[0], x.region, x.size, *x.box, x.leader is not None, x.cramped) for x in N.place(ids, colors, free, spacing)]
        return pd.DataFrame(out, columns=["image_id", "region_id", "size", "x0", "y0", "x1", "y1", "leader", "cramped"])

    return px.select("image_id", "x", "y", "region_id", "label").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, region_id int, size int, x0 int, y0 int, x1 int, y1 int, leader boolean, cramped boolean")


def scaled_regions(px: DataFrame, factor: float, length: float = R.LEAST_PX) -> DataFrame:
    """(image_id, x, y, region_id): region maps drawn larger inside their smoothed outlines."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = _grid(rows, "region_id", -1)
        out = R.scaled_regions(ids, tuple(round(n * factor) for n in ids.shape), length)
        return _pixels(rows["image_id"].iloc[0], out, region_id=out)

    return px.select("image_id", "x", "y", "region_id").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, region_id int")


def settled_tones(px: DataFrame, palette: list[tuple[int, int, int]], where: str, step: float) -> DataFrame:
    """(image_id, x, y, region_id, color): regions (image_id, x, y, region_id, color, b, g, r) with the tones of those mostly in a mask
    settled."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, color = _grid(rows, "region_id", -1), _grid(rows, "color", 0)
        colors = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
        colors[ids[ids >= 0]] = color[ids >= 0]
        ids, colors = settle.settled_tones(planes(rows), _grid(rows, "inside", 0) > 0, ids, colors, np.array(palette), step)
        return _pixels(rows["image_id"].iloc[0], ids, region_id=ids, color=np.append(colors, -1)[ids])

    some = px.select("image_id", "x", "y", "region_id", "color", "b", "g", "r", F.expr(where).cast("int").alias("inside"))
    return some.groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, region_id int, color int")
