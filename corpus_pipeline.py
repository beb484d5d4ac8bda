"""From documents to packed training sequences, in stages.

run() applies STAGES to the table documents. Each stage takes the session, its
predecessor's documents and the folder of the tables; what it returns is
written as Parquet in the shared folder and read again as the next one's input.
All but the last return the columns of documents: every column of the input,
whatever its name, in order and type, with text and n_chars (if there is one)
as the stage leaves them. No stage fails on null ids or texts, empty or very
long texts, repeated rows or an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import line_dedup, packing, simhash, substring_dedup
from statuta.llm import toxicity as toxic
from statuta.llm.common import materialise, read_table, with_text


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    The chain is fitted on labelled rows of docs (each id once). Null and empty
    texts have no words and stay; equal texts share a verdict; without labels
    nothing goes.
    """
    return toxic.without_toxic(docs, toxic.fit_labels(docs, read_table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in the one of the largest id.

    Null and empty texts are one empty line and become empty. Rows that repeat
    an id count as one document, each cut by its own text.
    """
    return with_text(line_dedup.judged(docs), F.col("kept_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingle similarity of 0.8 or more, one row stays: of the smallest id, or without one if all are.

    All texts without a word (null, empty, blank) are one group. Rows that
    repeat an id, or a whole row, are rows of their own, of which one stays if
    they are linked.
    """
    return simhash.one_of_each(docs)


def drop_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of 35 that stand elsewhere too go; a text that loses none stays as it is.

    Null and short texts have no window and stay. Rows that repeat an id are cut
    each; equal rows repeat one another.
    """
    made = substring_dedup.judged(docs)
    return with_text(made, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row").getField("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, piece by piece, with ids_crc32; see packing.pack()."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_shared_passages),
    ("packing", pack_sequences),
]

#: No SQL: the first stage is a fitted model, the third a transitive closure, the last a tokenizer. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
