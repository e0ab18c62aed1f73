"""Picture files and manifests: what is read from and written to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("photo", "cartoon", "flat", "face", "text", "gradient", "texture")

_BOX = T.ArrayType(T.IntegerType())
_ENTRY = T.StructType([
    T.StructField("size", _BOX), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType()),
    T.StructField("faces", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("box", _BOX), T.StructField("features", T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("box", _BOX)])))]))),
    T.StructField("text", T.ArrayType(T.StructType([T.StructField("box", _BOX), T.StructField("string", T.StringType()), T.StructField("rotation", T.IntegerType())]))),
    T.StructField("flat_colors", T.ArrayType(T.StringType())), T.StructField("ink_colors", T.ArrayType(T.StringType())), T.StructField("exact_colors", T.BooleanType()),
    T.StructField("areas", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("box", _BOX)]))),
    T.StructField("subjects", T.ArrayType(T.StructType([T.StructField("outline", T.ArrayType(_BOX))]))),
])
MANIFEST = T.StructType([T.StructField("schema", T.IntegerType()), T.StructField("images", T.MapType(T.StringType(), _ENTRY))])


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """pixel(image_id, x, y, b, g, r) of the picture files below a path; gray pictures have three equal channels, alpha is left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    at = F.col("at")
    channel = lambda k: F.conv(F.hex(F.substring(F.col("data"), (F.col("p") * F.col("nChannels") + 1 + F.least(F.lit(k), F.col("nChannels") - 1)).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = image.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))).withColumn("p", at)
    return px.select(F.col("origin").alias("image_id"), (at % F.col("width")).cast("int").alias("x"), F.floor(at / F.col("width")).cast("int").alias("y"), channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image(name, source, ..): the entries of manifest files, each a JSON document. A file that does not fit the schema, or has another
    version of it, is an error."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("source", F.col("_metadata.file_path"))
    version = F.when(F.col("schema") == 1, F.col("images")).otherwise(F.raise_error(F.concat(F.lit("manifest schema must be 1 in "), F.col("source"))))
    return read.select("source", F.explode(version).alias("name", "entry")).select("name", "source", "entry.*")


def overlaid(manifests: DataFrame, order: list[str]) -> DataFrame:
    """One entry for each name: of several files the last in `order` (file names) wins."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.element_at(F.split("source", "/"), -1)), F.lit(0))
    best = Window.partitionBy("name").orderBy(F.desc(rank), F.desc("source"))
    return manifests.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def problems(manifests: DataFrame) -> DataFrame:
    """(name, problem): what is wrong or missing in an entry."""
    width, height = F.element_at("size", 1), F.element_at("size", 2)
    boxes = F.concat(*[F.coalesce(F.transform(c, lambda e: e["box"]), F.array().cast("array<array<int>>")) for c in ("faces", "text", "areas")])
    outside = F.exists(boxes, lambda b: (F.size(b) != 4) | (b[0] < 0) | (b[1] < 0) | (b[2] <= 0) | (b[3] <= 0) | (b[0] + b[2] > width) | (b[1] + b[3] > height))
    lacks = lambda category, column: F.array_contains("categories", category) & (F.coalesce(F.size(column), F.lit(0)) <= 0)
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.size("size"), F.lit(0)) != 2, "size"), F.when(F.size(F.array_except("categories", F.array(*map(F.lit, CATEGORIES)))) > 0, "unknown category"), F.when(outside, "box outside"),
        F.when(lacks("face", "faces"), "no faces"), F.when(lacks("text", "text"), "no text"), F.when(lacks("flat", "flat_colors"), "no flat colours"),
        F.when(F.exists(F.coalesce("flat_colors", F.array().cast("array<string>")), lambda c: ~c.rlike("^#[0-9a-f]{6}$")), "bad colour"),
        F.when(F.exists(F.coalesce(F.transform("text", lambda t: t["rotation"]), F.array().cast("array<int>")), lambda r: ~r.isin(0, 90, 180, 270)), "bad rotation"),
    ))
    return manifests.select("name", F.explode(found).alias("problem"))


def chosen(manifests: DataFrame, categories: list[str]) -> DataFrame:
    """Entries that have any of some categories."""
    return manifests.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def write_params(params: DataFrame, path: str) -> None:
    """Writes settings (id, name, value) as JSON, a document for each id."""
    params.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("settings")).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, settings: DataFrame) -> DataFrame:
    """(id, name, value): settings as they were written, held within their ranges; one that is not known is an error."""
    read = spark.read.schema("id long, settings map<string, double>").option("mode", "FAILFAST").json(path).select("id", F.explode("settings").alias("name", "value"))
    both = read.join(F.broadcast(settings), "name", "left")
    held = F.least(F.greatest("value", "least"), "most")
    held = F.when(F.col("least").isNull(), F.raise_error(F.concat(F.lit("no such setting: "), F.col("name")))).when(F.col("whole"), F.rint(held)).otherwise(held)
    return both.select("id", "name", held.alias("value"))
