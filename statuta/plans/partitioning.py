"""How a table is dealt to tasks before Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that one task takes to Python, about.
TASK_BYTES = 16 << 20


def dealt_parts(size: int) -> int:
    """Partitions of a table of so many bytes that is dealt by a key: of 1 MB at least, for a small one to reach all cores, of TASK_BYTES for a large one."""
    return max(min(32, 1 + (size >> 20)), size // TASK_BYTES)


def _coarse(table: DataFrame, size: int, cores: int) -> bool:
    """Whether fewer splits than cores have rows, or one has those of more than two tasks, as of files with few or large row groups. Reads no column."""
    held = table.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    splits, most, total = held.agg(F.count("n"), F.max("n"), F.sum("n")).first()
    return bool(total) and (splits < cores or most * size > 2 * TASK_BYTES * total)


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{name}.parquet")
    return files.agg(F.sum("length")).first()[0] or 0


def read_spread(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A Parquet table over all cores, in tasks of about TASK_BYTES.

    A split is read by one task, but only as finely as its files have row
    groups. Where these are too few or too large, rows are dealt anew by a hash
    of their plain columns, to as many tasks as there are cores or bytes for; a
    table of fine splits is read as it is, and none of its rows move.
    With a key, a table of any size is dealt by it to a number of partitions that
    its bytes alone decide, and sorted in each, so the order of rows depends on
    the table alone, and neither on the cores nor on the settings of the reader.
    """
    path = f"{sf_dir}/{name}.parquet"
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = table_bytes(spark, sf_dir, name)
    if key is not None:
        return table.repartition(dealt_parts(size), key).sortWithinPartitions(*table.columns)
    if not _coarse(table, size, cores):
        return table
    plain = [f.name for f in table.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return table.repartition(max(cores, -(-size // TASK_BYTES)), *[F.col("`" + c.replace("`", "``") + "`") for c in plain])
