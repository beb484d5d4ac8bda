"""Triplets that arrive as a stream: batches go into the graph's support tables, each exactly once in effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.graph import build_triplets, edge_support, node_support
from statuta.operators.support_store import SupportStore


def write_batch(folder: str, synonyms: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch's node and edge support below folder, in a place of its own.

    A batch that is run again overwrites what it wrote, and readers take the
    distinct rows over all batches, so repeats change nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        made = build_triplets(batch, synonyms)
        node_support(made).write.mode("overwrite").parquet(f"{folder}/nodes/batch={number}")
        edge_support(made).write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")

    return run


def read_support(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All batches' support rows of a kind (nodes, edges), each once."""
    return spark.read.parquet(f"{folder}/{kind}").drop("batch").distinct()


def ingest(triplets: DataFrame, folder: str, checkpoint: str, synonyms: DataFrame | None = None):
    """Start the stream of triplets (document_id, document_number, c1, r, c2) into folder, until the input is used up."""
    return triplets.writeStream.foreachBatch(write_batch(folder, synonyms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(nodes: SupportStore, edges: SupportStore, synonyms: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into the stores of node and edge support.

    Either store keeps the number of its last batch, so a batch that is run
    again, also after a failure between the two, goes into each of them once.
    """

    def run(batch: DataFrame, number: int) -> None:
        made = build_triplets(batch, synonyms)
        nodes.merge(node_support(made), number)
        edges.merge(edge_support(made), number)

    return run


def ingest_stores(triplets: DataFrame, nodes: SupportStore, edges: SupportStore, checkpoint: str, synonyms: DataFrame | None = None):
    """Start the stream of triplets into the stores, until the input is used up. Memory and bytes follow a batch's keys, not the graph."""
    return triplets.writeStream.foreachBatch(merge_batch(nodes, edges, synonyms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(triplets: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, r, n: triplets by relation and window of time, open to rows that are late by no more than given."""
    return triplets.withWatermark(at, late).groupBy(F.window(at, width), "r").agg(F.count(F.lit(1)).alias("n")).select("window.start", "r", "n")
