"""Exact dedup: groups by a 128-bit content hash, byte comparison inside the groups, smallest id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import free, materialise, quoted, text_or_empty


def normalise_space(c: Column) -> Column:
    """Each run of ASCII white space becomes one space; single spaces need no replacement."""
    return F.regexp_replace(c, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Hashes come first: rows are counted by MD5. Only texts whose MD5 occurs
    again are grouped by their bytes, so a hash collision splits into its true
    groups; that aggregation combines on the map side, so a text shared by a
    third of all rows shrinks to a row for each task. Those rows find their
    group by MD5 and SHA-256 together; the join's hot keys are split by AQE,
    since the other side has one row for each group. A text whose MD5 occurs
    once never moves.

    Null text counts as empty; texts are read whole; an empty table gives no
    row. Rows that repeat an id count each and share keep_id. A null id never
    wins over another id; a group of null ids only has a null keep_id and keeps
    its rows. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), normalise_space(text_or_empty(text_col)).alias("body"))
    h128 = F.unhex(F.md5("body")).alias("h128")
    hashed = materialise(base.select("doc_id", h128, F.sha2("body", 256).alias("text_sha256")), "hashes")
    again = hashed.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h128")
    again = materialise(again, "repeated")  # its size is then known: a small one is broadcast
    groups = (
        base.select("doc_id", "body", h128)
        .join(again, "h128", "left_semi")
        .groupBy("h128", "body")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
        .select("h128", F.sha2("body", 256).alias("text_sha256"), "least", "size")
    )
    groups = materialise(groups, "groups")
    free(again)
    found = hashed.join(groups, ["h128", "text_sha256"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
