"""Synonym tables: words in many spellings to one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import after_first, before_first, move_tone_marks, strip, synonym_form

#: Bytes of a synonym table, by its texts and 64 a row, up to which it is sent to all tasks; how a larger one is joined is left to Spark.
SENT = 8 << 20


def parse_synonyms(lines: DataFrame, number: str = "line_no", value: str = "value", tone_marks: bool = False) -> DataFrame:
    """term, key from lines `KEY#word,word`; later lines and words override earlier ones. Lines that are blank or have no # are skipped."""
    kept = lines.where(F.col(value).contains("#")).select(F.col(number).alias("line_no"), strip(F.col(value)).alias("v"))
    words = kept.select("line_no", strip(before_first(F.col("v"), "#")).alias("key"), F.posexplode(F.split(after_first(F.col("v"), "#"), ",")).alias("word_no", "word"))
    term = synonym_form(F.col("word"))
    named = words.select("line_no", "word_no", "key", (move_tone_marks(term) if tone_marks else term).alias("term")).where("term <> ''")
    return named.groupBy("term").agg(F.max_by("key", F.struct("line_no", "word_no")).alias("key"))


def canonical(rows: DataFrame, columns: str | list[str], synonyms: DataFrame) -> DataFrame:
    """rows with the columns replaced by their synonyms' keys, or left as they are.

    The table is measured first and broadcast if it is small. Spark takes a
    table made in memory for a huge one until it has been computed, and by then
    it has shuffled the rows, once for each column.
    """
    size = synonyms.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("key"), F.lit(0)) + 64)).first()[0] or 0
    table = synonyms.select(F.col("term").alias("_term"), F.col("key").alias("_key"))
    for column in [columns] if isinstance(columns, str) else columns:
        joined = rows.join(F.broadcast(table) if size <= SENT else table, rows[column] == table["_term"], "left")
        rows = joined.withColumn(column, F.coalesce("_key", column)).drop("_term", "_key")
    return rows
