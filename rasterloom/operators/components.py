"""Connected components of a label map, by runs: rows are cut into runs, touching runs of two rows are linked, and the smallest
run number spreads with pointer jumping. Works for pictures that no single task could hold."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regions import row_runs

ROUNDS = 64


def _settled(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names; a session in one process that names none (local tests) gets
    one of its own, on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="rasterloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def _jumped(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Labels after each root of `hooks` (image_id, root, least) went to the least one that hooks reach from it."""
    for _ in range(ROUNDS):
        step = hooks.select("image_id", F.col("root").alias("least"), F.col("least").alias("further"))
        moved = _settled(hooks.join(step, ["image_id", "least"], "left").select("image_id", "root", F.coalesce("further", "least").alias("least"), F.col("further").isNotNull().alias("moved")))
        hooks = moved.select("image_id", "root", "least")
        if moved.where("moved").isEmpty():
            return _settled(labels.join(hooks, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("least", "root").alias("root")))
    raise RuntimeError(f"roots did not settle in {ROUNDS} rounds")


def label_components(px: DataFrame, value: str = "label", corners: bool = False) -> DataFrame:
    """(image_id, x, y, value, component): 4-connected pieces of equal pixels, or 8-connected with corners. A component's number
    is y * 2^20 + x of its first run in raster order."""
    runs = _settled(row_runs(px, value).withColumn("node", F.col("y").cast("long") * (1 << 20) + F.col("x0")))
    reach = 1 if corners else 0
    # runs of two rows meet by their blocks of columns, so the range condition has an equality to be dealt by
    block = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 32), F.floor(hi / 32)))
    low = runs.withColumn("block", block(F.col("x0") - reach, F.col("x1") - 1 + reach))
    high = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("value"), F.col("node").alias("up")).withColumn("block", block(F.col("u0"), F.col("u1") - 1))
    links = low.join(high, ["image_id", "y", "value", "block"]).where((F.col("u0") < F.col("x1") + reach) & (F.col("x0") < F.col("u1") + reach)).select("image_id", "node", "up").distinct()
    both = _settled(links.union(links.select("image_id", "up", "node")))
    labels = _settled(runs.select("image_id", "node", F.col("node").alias("root")))
    for _ in range(ROUNDS):
        # each root takes the least root that its members see, then all runs jump to the root of their root
        near = both.join(labels.select("image_id", F.col("node").alias("up"), F.col("root").alias("seen")), ["image_id", "up"]).groupBy("image_id", "node").agg(F.min("seen").alias("seen"))
        hooks = labels.join(near, ["image_id", "node"]).groupBy("image_id", "root").agg(F.min("seen").alias("least")).where("least < root")
        hooks = _settled(hooks)
        if hooks.isEmpty():
            break
        labels = _jumped(labels, hooks)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    out = runs.join(labels, ["image_id", "node"]).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    return out.select("image_id", "x", "y", "value", F.col("root").alias("component"))


def component_sizes(px: DataFrame, value: str = "label", corners: bool = False) -> DataFrame:
    """(image_id, component, value, area) of every component."""
    return label_components(px, value, corners).groupBy("image_id", "component", "value").agg(F.count(F.lit(1)).alias("area"))


def numbered_regions(px: DataFrame, colors: int, value: str = "label") -> DataFrame:
    """(image_id, x, y, region_id): 8-connected regions, numbered by colour and then by the first block of 2 x 2 pixels, in raster
    order of blocks, that they touch; labels from `colors` on are ink, -1."""
    found = label_components(px, value, True)
    widths = found.groupBy("image_id").agg(F.floor((F.max("x") + 2) / 2).alias("width"))
    first = found.join(widths, "image_id").withColumn("block", F.floor(F.col("y") / 2) * F.col("width") + F.floor(F.col("x") / 2))
    order = first.where(F.col("value") < colors).groupBy("image_id", "component", "value").agg(F.min("block").alias("block"))
    ranked = order.withColumn("region_id", F.row_number().over(Window.partitionBy("image_id").orderBy("value", "block", "component")) - 1)
    return found.join(ranked.select("image_id", "component", "region_id"), ["image_id", "component"], "left").select("image_id", "x", "y", F.coalesce("region_id", F.lit(-1)).alias("region_id"))
