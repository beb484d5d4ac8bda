"""Draws with replacement that depend on the rows and a seed only, not on how the rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, which one task sorts, about.
BUCKET_ROWS = 500_000


def _number(md5: Column, digits: int) -> Column:
    """The first hex digits of an MD5 as a whole number."""
    return F.conv(F.substring(md5, 1, digits), 16, 10).cast("long")


def draws(rows: DataFrame, keys: list[str], n: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows that n draws with replacement hit, each once, with times: how often. Each row is as likely as any other in each draw.

    Rows are ordered by the MD5 of their keys and the seed; draw i takes the row
    at the place that the MD5 of i and the seed names. The order is cut into
    buckets of about bucket_rows rows by the hash, whose counts (a number for
    each bucket) go to the driver, so places are found within buckets and there
    is no sort of all rows. Keys must tell rows apart: rows of equal keys fall
    into one bucket and are in any order there. Null keys are left out of what
    is hashed. No rows or no draws: no row. A column called times is replaced.
    """
    spark = rows.sparkSession
    text = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys], F.lit(str(seed)))
    names = [c for c in rows.columns if c.lower() != "times"]
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    step = -(-(1 << 52) // buckets)
    told = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.md5(text).alias("h"))
    told = told.withColumn("bucket", F.floor(_number(F.col("h"), 13) / F.lit(step)).cast("int"))
    before, at = [], 0
    for bucket, size in sorted(tuple(r) for r in told.groupBy("bucket").count().collect()):
        before.append((bucket, at))
        at += size
    first = F.broadcast(spark.createDataFrame(before, "bucket int, first long"))  # a number for each bucket
    order = Window.partitionBy("bucket").orderBy("h", *[F.col("row").getField(k) for k in keys])
    placed = told.join(first, "bucket").withColumn("at", F.col("first") + F.row_number().over(order) - 1)
    drawn = F.md5(F.concat_ws("|", F.lit("draw"), F.col("id").cast("string"), F.lit(str(seed))))
    hits = spark.range(n).select(F.pmod(_number(drawn, 15), F.lit(max(total, 1))).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("times"))
    return placed.join(hits, "at").select(*[F.col("row").getField(c).alias(c) for c in names], "times")
