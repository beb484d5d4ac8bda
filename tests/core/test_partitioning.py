from pyspark.sql import functions as F

from statuta.plans import partitioning as pt


def test_dealt_partitions_are_neither_tiny_nor_large():
    assert [pt.dealt_parts(mb << 20) for mb in (0, 1, 10, 500, 30 << 10)] == [1, 2, 11, 32, 1920]
    assert all((gb << 30) / pt.dealt_parts(gb << 30) <= 2 * pt.TASK_BYTES for gb in (1, 3, 30, 300))


def test_a_table_of_one_row_group_is_dealt_and_one_of_many_is_not(spark, tmp_path, monkeypatch):
    """Splits by bytes hide that one of them has all the rows."""
    monkeypatch.setattr(pt, "TASK_BYTES", 4096)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    rows.repartition(400).write.parquet(str(tmp_path / "many.parquet"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "4k")
        one, many = (pt.read_spread(spark, str(tmp_path), n) for n in ("one", "many"))
        held = [r["n"] for r in one.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(held) == 20_000 and len(held) > 100 and max(held) < 20_000 // 50
        assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, rows.collect()))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
