"""Writers: snapshots of tables, name lists, relation sections and annotations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import strip, word_line

LAWS = "id STRING, title STRING, content STRING, parent_id STRING, so_hieu STRING"
LAW_REFS = "so_hieu STRING, title STRING, content STRING"


def create_tables(spark: SparkSession) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS laws ({LAWS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS law_refs ({LAW_REFS}) USING parquet")


def clear_tables(spark: SparkSession) -> None:
    for name in ("laws", "law_refs"):
        spark.sql(f"TRUNCATE TABLE {name}")


def write_snapshot(df: DataFrame, folder: str) -> str:
    """df in a new folder below the given one, which is returned: a table being read is never overwritten."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Node and edge support tables without rows."""
    return spark.createDataFrame([], "name string, document_id string, document_number string"), spark.createDataFrame([], "c1 string, r string, c2 string, document_id string")


def write_names(names: DataFrame, path: str) -> None:
    """name, stripped and distinct, one to a line and sorted over all files: range-partitioned, so no task holds them all."""
    rows = names.select(strip(F.col("name")).alias("value")).distinct()
    rows.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def relation_sections(triplets: DataFrame) -> DataFrame:
    """relation, value: `=== Relation: X ===`, tab-separated rows, a blank line, for each relation in order."""
    head = triplets.select("relation").distinct().select("relation", F.lit(0).alias("part"), F.lit("").alias("s"), F.lit("").alias("o"), F.concat(F.lit("=== Relation: "), F.col("relation"), F.lit(" ===")).alias("value"))
    rows = triplets.select("relation", F.lit(1), "subject", "object", F.concat_ws("\t", "subject", "relation", "object"))
    tail = triplets.select("relation").distinct().select("relation", F.lit(2), F.lit(""), F.lit(""), F.lit(""))
    return head.union(rows).union(tail)


def write_relation_sections(triplets: DataFrame, path: str) -> None:
    ordered = relation_sections(triplets).repartitionByRange("relation", "part", "s", "o").sortWithinPartitions("relation", "part", "s", "o")
    ordered.select("value").write.mode("overwrite").text(path)


def annotation_text(tokens: DataFrame, blank_between: bool = True) -> DataFrame:
    """doc_id, sent_id, value: a sentence's words, one to a line; with a blank line behind each sentence."""
    line = word_line(*[F.col(c) for c in ("id", "word", "pos", "ner", "head", "deprel")])
    grouped = tokens.select("doc_id", "sent_id", F.struct("id", line.alias("line")).alias("x")).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["line"]), "\n")
    return grouped.select("doc_id", "sent_id", (F.concat(text, F.lit("\n")) if blank_between else text).alias("value"))


def write_annotations(tokens: DataFrame, path: str, blank_between: bool = True) -> None:
    """annotation_text() as text files, in order of document and sentence over all files."""
    rows = annotation_text(tokens, blank_between)
    rows.repartitionByRange("doc_id", "sent_id").sortWithinPartitions("doc_id", "sent_id").select("value").write.mode("overwrite").text(path)
