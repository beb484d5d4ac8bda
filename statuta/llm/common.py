"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.sources.memory import KEEP, give_back, resident, small_batches
from statuta.sources.shared import free, materialise, shared_dir

__all__ = ["claim", "free", "lower_ascii", "mapped", "materialise", "mix", "packed", "parts", "quoted", "read_table", "shared_dir", "text_or_empty", "tidy", "unpacked", "with_text"]

#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(quoted(text)), F.lit(""))


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of an operator's own can meet a user's column."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def unpacked(made: DataFrame, *added: str, row: str = "row") -> list[Column]:
    """The fields of the struct, but for those that an added column replaces, then the added columns."""
    taken = {a.lower() for a in added}
    return [F.col(row).getField(f.name).alias(f.name) for f in made.schema[row].dataType.fields if f.name.lower() not in taken] + [F.col(a) for a in added]


def with_text(made: DataFrame, text: Column, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The fields of the struct `row`, in order and type, with another text and, if there is such a field, its length."""
    kinds = made.schema["row"].dataType.fields
    new = {text_col: text, size_col: F.length(text)}
    return made.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name) for f in kinds])


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and no other letter: lower() is quick and right unless another cased letter occurs."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(c, capitals, capitals.lower())).otherwise(F.lower(c))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that few texts are Python strings at a time."""
    return (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over the batches of a task, which gives back freed memory at the end, and between batches once the worker holds KEEP bytes and an eighth more than the last time.

    Python workers live on for the tasks of later stages, and what their
    allocators hold counts against the executor: after 8,000 texts 200 to 320 MB
    a worker, of which half is free.
    """

    def each(batches: Iterator) -> Iterator:
        most = KEEP
        for batch in batches:
            yield batch
            del batch
            if resident() > most:
                give_back()
                most = max(KEEP, resident() * 9 // 8)

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return task


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow(run) with tidy(), for rows with texts: a batch holds BATCH rows at most.

    Batches stand in the JVM, between the processes and in the worker, so they
    bound what a task holds. Spark knows the number as a setting of the session
    only, which is lowered here and never raised.
    """
    small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(run), schema)


#: Stores that the last operator to run in this worker has filled.
_FILLED: list = []


def claim(*stores) -> None:
    """stores (with clear()) are of the operator that runs now; those of another one, which ran here before, are emptied."""
    if not _FILLED or any(all(s is not f for f in _FILLED) for s in stores):
        for f in _FILLED:
            f.clear()
        _FILLED[:] = stores


def mix(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    """Order-sensitive combination of two arrays of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(odd) + b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x
