"""Tables in the folder that the driver and all executors share; they cut lineages and survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves if Spark runs in one
    process (tests); on a cluster that is an error, since executors would write
    to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "statuta-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared folder, deleted with all below it when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)  # has no effect on a path that is not there yet
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It is deleted by free(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        system.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._materialised = path
    return table


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files and folders with all below them; those that are not there are passed over."""
    for path in paths:
        system, place = _file_system(spark, path)
        system.delete(place, True)


def free(*tables: DataFrame) -> None:
    """Delete materialised tables, once all that read them is written."""
    for t in tables:
        delete(t.sparkSession, t._materialised)
