"""Properties of nodes and edges that arrive as a stream of events, in any order, late and repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from statuta.operators.support_store import SupportStore

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for an unknown time, which is before all others.
_NEVER = -(1 << 63)


def told_properties(events: DataFrame, keys: list[str], properties: str = "properties", at: str = "at") -> DataFrame:
    """keys (as strings), property, at, value: one row for each entry of the events' maps. Events without entries say nothing."""
    return events.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(at).cast("timestamp").alias("at"), F.explode(F.col(properties).cast("map<string,string>")).alias("property", "value")).select(*keys, "property", "at", "value")


def latest(told: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows as of told_properties(), the last in event time by keys and property; of equal times the greatest value.

    Unknown times are the earliest and unknown values the least, so the result
    is the same in any order and on any repeat.
    """
    best = F.max(F.struct("at", "value")).alias("x")
    return told.groupBy(*keys, "property").agg(best).select(*keys, "property", "x.at", "x.value")


def property_maps(told: DataFrame, keys: list[str]) -> DataFrame:
    """keys, properties: the latest() rows as one map by keys, whose size is the number of different properties."""
    entries = F.array_sort(F.collect_list(F.struct("property", "value")))
    return latest(told, keys).groupBy(*keys).agg(F.map_from_entries(entries).alias("properties"))


def _newest(batch: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    ranked = batch.assign(_known=batch["value"].notna(), _text=batch["value"].fillna("")).sort_values(["at", "_known", "_text"])
    return ranked[~ranked.duplicated(by, keep="last")][batch.columns]


class _Merge(StatefulProcessor):
    """State by keys and property: the last event's time and value. Rows come out where it changes."""

    def __init__(self, keys: list[str], ttl_ms: int | None):
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle) -> None:
        kind = StructType([StructField("at", LongType()), StructField("value", StringType())])
        self.last = handle.getValueState("last", kind, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rank = lambda x: (x[0], x[1] is not None, x[1] or "")
        before = tuple(self.last.get()) if self.last.exists() else None
        best = before
        for batch in rows:
            for at, value in zip(batch["at"], batch["value"], strict=True):
                now = (int(at), None if pd.isna(value) else value)
                if best is None or rank(now) > rank(best):
                    best = now
        if best != before:
            self.last.update(best)
            yield pd.DataFrame([(*key, *best)], columns=[*self.keys, "property", "at", "value"]).astype({"at": "int64"})

    def close(self) -> None:
        pass


def changes(told: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """A stream of the last events of properties, of rows as of told_properties(): late and repeated ones never come out.

    Rows are reduced by keys and property before the shuffle, so a hot key moves
    little, and different properties of a key have states of their own. The
    state is a streaming aggregate in the JVM; of a property that a batch names
    the last event comes out, also if it is the one that was known before, so a
    batch's rows are those of a store or repeat them.
    With ttl_ms only what changes a property comes out, and a state that long
    unchanged is forgotten; this needs a Python call for each key of a batch.
    Late rows may come out then, which latest() over the output sets right.
    """
    by = [*keys, "property"]
    kind = ", ".join([*[f"`{c}` string" for c in by], "at long", "value string"])
    coded = told.select(*by, F.coalesce(F.unix_micros("at"), F.lit(_NEVER)).alias("at"), "value")
    if ttl_ms is None:
        best = coded.groupBy(*by).agg(F.max(F.struct("at", "value")).alias("x")).select(*by, "x.at", "x.value")
        return best.select(*by, F.when(F.col("at") != _NEVER, F.timestamp_micros("at")).alias("at"), "value")

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _newest(batch, by)

    made = coded.mapInPandas(reduced, kind).groupBy(*by).transformWithStateInPandas(_Merge(keys, ttl_ms), kind, "Update", "processingTime")
    return made.select(*by, F.when(F.col("at") != _NEVER, F.timestamp_micros("at")).alias("at"), "value")


def create_property_store(spark, folder: str, keys: list[str], buckets: int = 1024) -> SupportStore:
    """An empty store for property rows in buckets by keys, for ingest_properties()."""
    fields = ", ".join([*[f"`{c}` string" for c in [*keys, "property"]], "at timestamp", "value string"])
    return SupportStore.create(spark.createDataFrame([], fields), folder, keys, buckets)


def ingest_properties(events: DataFrame, store: SupportStore, checkpoint: str, keys: list[str], ttl_ms: int | None = None, properties: str = "properties", at: str = "at"):
    """Start the stream of events into the store; latest(store.rows()) is the table of properties.

    It ends when the input is used up. With ttl_ms it runs until it is stopped,
    as states are forgotten by the clock and there is always a batch to come.
    The store takes each batch once, also if it is run again, and of its rows
    those that it does not have. State lies in RocksDB, beside the checkpoint;
    the session's state store is set to it. A checkpoint belongs to one kind of
    state: it cannot go on with ttl_ms if it began without, or the other way
    round, nor if it is of a version that kept both as one kind.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    stream = changes(told_properties(events, keys, properties, at), keys, ttl_ms)
    write = stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: store.merge(batch, number) and None)
    write = write.option("checkpointLocation", checkpoint)
    return (write.trigger(processingTime="1 second") if ttl_ms else write.trigger(availableNow=True)).start()
