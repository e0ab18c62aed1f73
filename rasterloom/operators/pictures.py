"""The per-picture kernels over many pictures: grouped by image_id, spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


def _grid(rows: pd.DataFrame, value: str, fill: int) -> np.ndarray:
    out = np.full((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), fill, np.int64)
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[value].to_numpy()
    return out


def planes(rows: pd.DataFrame) -> np.ndarray:
    """A picture as height x width x 3, blue first; pixels it lacks are white."""
    return np.stack([_grid(rows, c, 255) for c in "bgr"], axis=2).astype(np.uint8)


def _pixels(image, ids: np.ndarray, **values) -> pd.DataFrame:
    y, x = np.nonzero(ids >= 0)
    return pd.DataFrame({"image_id": image, "x": x.astype(np.int32), "y": y.astype(np.int32)} | {k: v[y, x] for k, v in values.items()})


def build_regions(px: DataFrame, colors: int, least: int) -> DataFrame:
    """(image_id, x, y, region_id, color): regions of the label map of each picture (image_id, x, y, label). Labels from `colors` on
    are ink and have none; pixels that a picture lacks have none either."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, color = K.build_regions(_grid(rows, "label", colors), colors, least)
        return _pixels(rows["image_id"].iloc[0], ids, region_id=ids, color=color[ids] if len(color) else ids)

    return px.select("image_id", "x", "y", "label").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, x int, y int, region_id int, color int")


def region_middles(px: DataFrame) -> DataFrame:
    """(image_id, region_id, x, y, radius, area): where a number goes in each region."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = K.middles(_grid(rows, "region_id", -1))
        return pd.DataFrame([(rows["image_id"].iloc[0], *x) for x in found], columns=["image_id", "region_id", "x", "y", "radius", "area"])

    return px.select("image_id", "x", "y", "region_id").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, region_id int, x int, y int, radius double, area int")


def sliver_share(px: DataFrame, radius: float) -> DataFrame:
    """(image_id, pixels, slivers, share): pixels of regions that a brush of that radius does not reach."""

    from .brush import slivers

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = _grid(rows, "region_id", -1)
        n, thin = int((ids >= 0).sum()), int(slivers(ids, radius).sum())
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "pixels": [n], "slivers": [thin], "share": [thin / n if n else None]})

    return px.select("image_id", "x", "y", "region_id").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, pixels long, slivers long, share double")


def painted(regions: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, x, y, b, g, r): every region in its colour; the palette has a bounded number of rows."""
    return regions.join(F.broadcast(palette.select("color", "b", "g", "r")), "color").select("image_id", "x", "y", "b", "g", "r")


def png_files(px: DataFrame) -> DataFrame:
    """(image_id, width, height, png binary): pictures as PNG files; pixels they lack are white."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bgr = planes(rows)
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "width": [bgr.shape[1]], "height": [bgr.shape[0]], "png": [K.png(bgr)]})

    return px.select("image_id", "x", "y", "b", "g", "r").groupBy("image_id").applyInPandas(run, f"image_id {_kind(px)}, width int, height int, png binary")


def _kind(px: DataFrame) -> str:
    return px.schema["image_id"].dataType.simpleString()
