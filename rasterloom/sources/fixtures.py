"""Rasters and relations derived from the driver's tables, each once as a DataFrame and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Tiles in a row of the mosaic, pixels in a row of a supplier's picture.
TILES, WIDTH = 25, 24


def mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """pixel(image_id, x, y, b, g, r): every embedding is a tile of 8 x 8 pixels."""
    v = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 256))).cast("int")).alias("c"))
    k = F.col("k")
    return v.select("vec_id", "c", F.posexplode("c").alias("k", "b")).select(
        F.lit(0).alias("image_id"),
        (F.col("vec_id") % TILES * 8 + k % 8).cast("int").alias("x"),
        (F.floor(F.col("vec_id") / TILES) * 8 + F.floor(k / 8)).cast("int").alias("y"),
        "b", F.element_at("c", ((k + 21) % 64 + 1).cast("int")).alias("g"), F.element_at("c", ((k + 42) % 64 + 1).cast("int")).alias("r"),
    )


def album(spark: SparkSession, folder: str) -> DataFrame:
    """pixel(image_id, x, y, b, g, r): pictures of 40 x 40 pixels, each of 25 embeddings as tiles; the number of pictures grows with
    the table, not their size."""
    px = mosaic(spark, folder)
    tile = F.floor(F.col("y") / 8) * TILES + F.floor(F.col("x") / 8)
    inner = tile % TILES
    return px.select(
        F.floor(tile / TILES).cast("int").alias("image_id"), (inner % 5 * 8 + F.col("x") % 8).cast("int").alias("x"), (F.floor(inner / 5) * 8 + F.col("y") % 8).cast("int").alias("y"), "b", "g", "r"
    )


def album_regions(spark: SparkSession, folder: str) -> DataFrame:
    """region_px(image_id, x, y, region_id, label, b, g, r): blocks of 10 x 10 pixels cut by label; label 3 is ink, without a region."""
    px = album(spark, folder).withColumn("label", level(F.col("b")))
    block = (F.floor(F.col("y") / 10) * 4 + F.floor(F.col("x") / 10)).cast("int")
    return px.withColumn("region_id", F.when(F.col("label") == 3, -1).otherwise(block * 4 + F.col("label")).cast("int"))


def level(b):
    """Label of a blue value."""
    return F.when(b < 112, 0).when(b < 128, 1).when(b < 144, 2).otherwise(3)


def mosaic_regions(spark: SparkSession, folder: str) -> DataFrame:
    """region_px(image_id, x, y, region_id, label, b, g, r): blocks of 16 x 16 pixels cut by label; label 3 is ink, without a region."""
    px = mosaic(spark, folder).withColumn("label", level(F.col("b")))
    block = (F.floor(F.col("y") / 16) * 13 + F.floor(F.col("x") / 16)).cast("int")
    return px.withColumn("region_id", F.when(F.col("label") == 3, -1).otherwise(block * 4 + F.col("label")).cast("int"))


def tile_map(spark: SparkSession, folder: str) -> DataFrame:
    """label(image_id, x, y, label): one pixel for each embedding."""
    return table(spark, folder, "embeddings").select(F.lit(0).alias("image_id"), (F.col("vec_id") % TILES).cast("int").alias("x"), F.floor(F.col("vec_id") / TILES).cast("int").alias("y"), F.col("label").cast("int").alias("label"))


def supplier_raster(spark: SparkSession, folder: str) -> DataFrame:
    """pixel(image_id, x, y, b, g, r): one picture for each supplier, its line items in order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, folder, "lineitem").withColumn("pos", F.row_number().over(order) - 1)
    return rows.select(
        F.col("l_suppkey").alias("image_id"), (F.col("pos") % WIDTH).cast("int").alias("x"), F.floor(F.col("pos") / WIDTH).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") * 5).alias("b"), (F.rint(F.col("l_discount") * 100).cast("int") * 25).alias("g"), (F.rint(F.col("l_tax") * 100).cast("int") * 31).alias("r"),
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """box(image_id, box_id, x, y, w, h) from the parts, 250 for each picture of the album."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        F.floor(key / 250).cast("int").alias("image_id"), key.alias("box_id"), (key * 37 % 36).cast("int").alias("x"), (key * 53 % 34).cast("int").alias("y"), (1 + size % 10).cast("int").alias("w"), (1 + F.floor(size / 5)).cast("int").alias("h")
    )


def palette16(spark: SparkSession) -> DataFrame:
    """palette(color, b, g, r): four hues of four levels."""
    values = [(4 * hue + i, *((v, v, v), (v, v // 2, v // 2), (v // 2, v, v // 2), (v // 2, v // 2, v))[hue]) for hue in range(4) for i, v in enumerate((32, 96, 160, 224))]
    return spark.createDataFrame(values, "color int, b int, g int, r int")


def case_quality(spark: SparkSession, folder: str) -> DataFrame:
    """case(result_set, case_id, image, preset, de00_mean, ssim, regions, median_total_s): benchmark cases from line items."""
    rows = table(spark, folder, "lineitem").groupBy("l_linestatus", "l_suppkey", "l_returnflag").agg(
        (F.avg("l_discount") * 100).alias("de00_mean"), (1 - F.avg("l_tax")).alias("ssim"), F.count(F.lit(1)).cast("double").alias("regions"), (F.avg("l_quantity") / 10).alias("median_total_s")
    )
    rows = rows.where(~((F.col("l_linestatus") != "F") & (F.col("l_suppkey") % 17 == 0)))
    return rows.select(
        F.when(F.col("l_linestatus") == "F", "base").otherwise("cand").alias("result_set"), F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("case_id"), F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("preset"),
        "de00_mean", F.when(F.col("l_suppkey") % 13 != 0, F.col("ssim")).alias("ssim"), "regions", "median_total_s",
    )


# ---- the same as SQL; each is a common table expression --------------------------------------------------------------

MOSAIC = """mosaic AS (
  SELECT 0 AS image_id, CAST(vec_id % 25 * 8 + k % 8 AS INTEGER) AS x, CAST(vec_id // 25 * 8 + k // 8 AS INTEGER) AS y,
    c[k + 1] AS b, c[(k + 21) % 64 + 1] AS g, c[(k + 42) % 64 + 1] AS r
  FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 256))) AS INTEGER)) AS c FROM embeddings),
    range(64) AS t(k))"""
REGIONS = (
    MOSAIC
    + """, px AS (
  SELECT *, CASE WHEN label = 3 THEN -1 ELSE (y // 16 * 13 + x // 16) * 4 + label END AS region_id
  FROM (SELECT *, CASE WHEN b < 112 THEN 0 WHEN b < 128 THEN 1 WHEN b < 144 THEN 2 ELSE 3 END AS label FROM mosaic))"""
)
ALBUM = (
    MOSAIC
    + """, album AS (
  SELECT CAST(t // 25 AS INTEGER) AS image_id, CAST(t % 25 % 5 * 8 + x % 8 AS INTEGER) AS x, CAST(t % 25 // 5 * 8 + y % 8 AS INTEGER) AS y, b, g, r FROM (SELECT *, y // 8 * 25 + x // 8 AS t FROM mosaic))"""
)
ALBUM_REGIONS = (
    ALBUM
    + """, px AS (
  SELECT *, CASE WHEN label = 3 THEN -1 ELSE (y // 10 * 4 + x // 10) * 4 + label END AS region_id
  FROM (SELECT *, CASE WHEN b < 112 THEN 0 WHEN b < 128 THEN 1 WHEN b < 144 THEN 2 ELSE 3 END AS label FROM album))"""
)
#: Pixels that a disk of radius 1.5 inside their region does not reach, of a relation px.
SLIVERS = """fit AS (SELECT p.image_id, p.x, p.y FROM px p JOIN px q ON q.image_id = p.image_id AND q.region_id = p.region_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1
    WHERE p.region_id >= 0 GROUP BY 1, 2, 3 HAVING count(*) = 9),
  reach AS (SELECT DISTINCT image_id, CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM fit, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy)),
  sliver AS (SELECT p.*, reach.x IS NULL AS sliver FROM px p LEFT JOIN reach USING (image_id, x, y) WHERE region_id >= 0)"""
TILEMAP = "tile AS (SELECT 0 AS image_id, CAST(vec_id % 25 AS INTEGER) AS x, CAST(vec_id // 25 AS INTEGER) AS y, label FROM embeddings)"
SUPPLIERS = """supp AS (
  SELECT l_suppkey AS image_id, CAST(pos % 24 AS INTEGER) AS x, CAST(pos // 24 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) * 5 AS b,
    CAST(round_even(l_discount * 100, 0) AS INTEGER) * 25 AS g, CAST(round_even(l_tax * 100, 0) AS INTEGER) * 31 AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem))"""
BOXES = """box AS (
  SELECT CAST(p_partkey // 250 AS INTEGER) AS image_id, p_partkey AS box_id, CAST(p_partkey * 37 % 36 AS INTEGER) AS x, CAST(p_partkey * 53 % 34 AS INTEGER) AS y,
    CAST(1 + p_size % 10 AS INTEGER) AS w, CAST(1 + p_size // 5 AS INTEGER) AS h FROM part)"""
PALETTE = """pal AS (
  SELECT CAST(4 * hue + i AS INTEGER) AS color, CASE WHEN hue < 2 THEN v ELSE v // 2 END AS b,
    CASE WHEN hue IN (0, 2) THEN v ELSE v // 2 END AS g, CASE WHEN hue IN (0, 3) THEN v ELSE v // 2 END AS r
  FROM range(4) AS h(hue), (VALUES (0, 32), (1, 96), (2, 160), (3, 224)) AS l(i, v))"""
CASES = """cases AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'cand' END AS result_set, concat(l_suppkey, '_', l_returnflag) AS case_id, l_suppkey AS image, l_returnflag AS preset,
    avg(l_discount) * 100 AS de00_mean, CASE WHEN l_suppkey % 13 <> 0 THEN 1 - avg(l_tax) END AS ssim, CAST(count(*) AS DOUBLE) AS regions, avg(l_quantity) / 10 AS median_total_s
  FROM lineitem WHERE NOT (l_linestatus <> 'F' AND l_suppkey % 17 = 0) GROUP BY l_linestatus, l_suppkey, l_returnflag)"""


# ---- benchmark quality, long ----------------------------------------------------------------------------------------

#: Metric and its value from the averages of a case: d (discount), t (tax), q (quantity), n (line items).
_METRICS = (
    ("de00_mean", "d * 100"), ("regions", "n"), ("sliver_area_fraction", "t / 4"), ("jaggedness", "0.98 + t"), ("lines_per_boundary_clear", "0.92 + d * 2"),
    ("palette_min_de00", "q / 2"), ("palette_margin_de00", "10 + d * 40"), ("ink_print_precision", "0.99 - t"), ("ink_reference_exact", "case when q > 25 then 1.0 else 0.0 end"),
)


def case_stats(spark: SparkSession, folder: str) -> DataFrame:
    """case(result_set, case_id, image, preset, size, d, t, q, n)."""
    rows = table(spark, folder, "lineitem").groupBy("l_linestatus", "l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = rows.where(~((F.col("l_linestatus") != "F") & (F.col("l_suppkey") % 17 == 0)))
    return rows.select(
        F.when(F.col("l_linestatus") == "F", "base").otherwise("cand").alias("result_set"), F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("case_id"), F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("preset"),
        F.when(F.col("l_suppkey") % 3 == 0, "export").otherwise("preview").alias("size"), "d", "t", "q", "n",
    )


def quality(spark: SparkSession, folder: str) -> DataFrame:
    """quality(result_set, case_id, image, preset, size, metric, value); ssim is null for every 13th image."""
    cases = case_stats(spark, folder)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("value")) for m, e in _METRICS], F.struct(F.lit("ssim").alias("metric"), F.expr("case when image % 13 <> 0 then 1 - t end").alias("value")))
    return cases.select("result_set", "case_id", "image", "preset", "size", F.explode(each).alias("m")).select("result_set", "case_id", "image", "preset", "size", "m.metric", "m.value")


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """category(case_id, category): one or two for each case."""
    cases = case_stats(spark, folder).select("case_id", "image").distinct()
    of = F.array_distinct(F.array(F.element_at(F.array(F.lit("photo"), F.lit("cartoon"), F.lit("flat")), (F.col("image") % 3 + 1).cast("int")), F.element_at(F.array(F.lit("photo"), F.lit("face")), (F.col("image") % 2 + 1).cast("int"))))
    return cases.select("case_id", F.explode(of).alias("category"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """edge(result_set, case_id, edge): the long edge of a case's page."""
    return case_stats(spark, folder).select("result_set", "case_id", F.when(F.col("result_set") == "base", F.lit(1100)).otherwise(1100 + F.col("image") % 15).cast("long").alias("edge"))


_D = "::DOUBLE"
STATS = """stats AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'cand' END AS result_set, concat(l_suppkey, '_', l_returnflag) AS case_id, l_suppkey AS image, l_returnflag AS preset,
    CASE WHEN l_suppkey % 3 = 0 THEN 'export' ELSE 'preview' END AS size, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem WHERE NOT (l_linestatus <> 'F' AND l_suppkey % 17 = 0) GROUP BY l_linestatus, l_suppkey, l_returnflag)"""
QUALITY = (
    STATS
    + ", quality AS ("
    + " UNION ALL ".join(
        f"SELECT result_set, case_id, image, preset, size, '{m}' AS metric, CAST({e.replace('0.98', '0.98' + _D).replace('0.92', '0.92' + _D).replace('0.99', '0.99' + _D)} AS DOUBLE) AS value FROM stats"
        for m, e in (*_METRICS, ("ssim", "case when image % 13 <> 0 then 1 - t end"))
    )
    + """), cat AS (SELECT DISTINCT case_id, unnest([['photo', 'cartoon', 'flat'][image % 3 + 1], ['photo', 'face'][image % 2 + 1]]) AS category FROM stats),
  edge AS (SELECT result_set, case_id, CASE WHEN result_set = 'base' THEN 1100 ELSE 1100 + image % 15 END AS edge FROM stats)"""
)
