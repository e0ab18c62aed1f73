"""What the operators share: reading tables, cutting lineage in the shared folder, and packing helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, read by Spark (so any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session that runs in one
    process (local tests) gets one of its own, which goes when Python ends; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one has used."""
    return f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors, and tells the planner the size.
    Small tables of many tasks do better with snappy, whose writers hold less memory outside the heap."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a frame that `cut` returned, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/rasterloom/" in path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def field(name: str, df: DataFrame) -> str:
    """A column name that `df` does not have, for helper columns beside the caller's own."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
