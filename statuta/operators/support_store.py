"""A graph's support rows as a table in buckets: a batch reads and writes only the buckets that its keys fall into."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from statuta.sources.shared import delete, free, materialise

#: Buckets of a new store. A batch of d keys touches d buckets at most, so there should be many more buckets than keys in a usual batch.
BUCKETS = 1024
#: Rows of one file at most; a bucket with more, as that of a hot key, is dealt to slices of about as many, which different tasks can write.
FILE_ROWS = 1_000_000

_STATE = "buckets int, keys array<string>, fields string, last long, pieces array<struct<bucket:int,generation:string,n:long>>"


class Piece(NamedTuple):
    """The files that one merge or compaction gave a bucket."""

    bucket: int
    generation: str
    n: int


class State(NamedTuple):
    version: int
    buckets: int
    keys: list[str]
    fields: str
    last: int | None
    pieces: list[Piece]

    def kind(self) -> StructType:
        return StructType.fromJson(json.loads(self.fields))

    def place(self) -> str:
        """The name of buckets in paths, which no column has."""
        name, taken = "bucket", {c.lower() for c in self.kind().names}
        while name in taken:
            name += "_"
        return name


class SupportStore:
    """Distinct rows below a folder that all machines share, in buckets by the hash of some key columns.

    A merge adds to each bucket that it touches a piece with the rows that are
    new there; compact() makes one piece of a bucket's many. Which pieces are
    the table is said by the newest version below `versions`, one row in one
    file: it appears whole or not at all, so a merge that fails leaves the table
    as it was, and a reader keeps what it began to read until vacuum(). There is
    one writer at a time. The number of pieces, which the driver holds, is
    bounded by the buckets times the pieces of a bucket between compactions.

    Null keys and values are values like any other; rows are equal if they are
    equal in every column. Columns may have any name, and any type but maps.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, like: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS) -> SupportStore:
        """An empty store for rows like those of a DataFrame. A folder that has a store already is an error."""
        store = cls(like.sparkSession, folder)
        row = (buckets, list(keys), like.schema.json(), None, [])
        store._versions(0, row).write.mode("error").parquet(f"{store.folder}/versions/version=0")
        return store

    def _versions(self, version: int, row: tuple) -> DataFrame:
        return self.spark.createDataFrame([row], _STATE).coalesce(1)

    def state(self) -> State:
        """What the newest version says."""
        version = self.spark.read.schema(f"{_STATE}, version long").parquet(f"{self.folder}/versions").agg(F.max("version")).first()[0]
        found = self.spark.read.schema(_STATE).parquet(f"{self.folder}/versions/version={version}").first()
        return State(version, found["buckets"], found["keys"], found["fields"], found["last"], [Piece(*p) for p in found["pieces"]])

    def _commit(self, before: State, last: int | None, pieces: list[Piece]) -> None:
        row = (before.buckets, before.keys, before.fields, last, sorted(pieces))
        version = before.version + 1
        self._versions(version, row).write.mode("overwrite").parquet(f"{self.folder}/versions/version={version}")

    def _path(self, state: State, piece: Piece) -> str:
        return f"{self.folder}/pieces/{piece.generation}/{state.place()}={piece.bucket}"

    def _read(self, state: State, pieces: list[Piece]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], state.kind())
        return self.spark.read.schema(state.kind()).parquet(*[self._path(state, p) for p in pieces])

    @staticmethod
    def _bucket(state: State, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(state.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All rows, each once."""
        state = self.state()
        return self._read(state, state.pieces)

    def near(self, names: DataFrame) -> DataFrame:
        """The rows of the buckets that names (the key columns) fall into, those of other keys too. No row moves, and only the columns that are used are read."""
        state = self.state()
        touched = set()
        if state.pieces:
            buckets = names.select(self._bucket(state, [F.col(_quoted(k)) for k in state.keys]))
            touched = {r[0] for r in buckets.distinct().collect()}  # at most as many as there are buckets
        return self._read(state, [p for p in state.pieces if p.bucket in touched])

    def of(self, names: DataFrame) -> DataFrame:
        """The rows whose keys are among names (the key columns); only the buckets of these names are read."""
        state = self.state()
        asked = names.select(*[F.col(_quoted(k)) for k in state.keys]).distinct()
        rows = self.near(asked).alias("x")
        same = [F.col(f"x.{_quoted(k)}").eqNullSafe(F.col(f"y.{_quoted(k)}")) for k in state.keys]
        return rows.join(asked.alias("y"), same, "left_semi")

    def merge(self, delta: DataFrame, number: int | None = None) -> int:
        """Add the rows of delta that are not there yet; how many there were.

        Only pieces of the buckets that delta's keys fall into are read, and only
        new rows are written. With a number, as a stream gives its batches in
        rising order, a batch no higher than the last one is a repeat and does
        nothing.
        """
        state = self.state()
        if number is not None and state.last is not None and number <= state.last:
            return 0
        row = F.struct(*[F.col(_quoted(c)).cast(f.dataType).alias(c) for c, f in zip(state.kind().names, state.kind().fields, strict=True)])
        keys = [F.col("row").getField(k) for k in state.keys]
        told = delta.select(row.alias("row")).distinct().select("row", self._bucket(state, keys).alias("bucket"))
        told = materialise(told, "delta")
        touched = {r[0] for r in told.select("bucket").distinct().collect()}  # at most as many as there are buckets
        old = self._read(state, [p for p in state.pieces if p.bucket in touched]).select(row.alias("row"))
        # Rows meet by the hash of the whole row, so a key that many rows have is spread.
        met = told.withColumn("h", F.xxhash64("row")).alias("x").join(old.withColumn("h", F.xxhash64("row")).alias("y"), F.expr("x.h = y.h AND x.row <=> y.row"), "left_anti")
        new = materialise(met.select("row", "bucket"), "new")
        pieces = self._write(state, new)
        self._commit(state, state.last if number is None else number, [*state.pieces, *pieces])
        free(told, new)
        return sum(p.n for p in pieces)

    def _write(self, state: State, rows: DataFrame) -> list[Piece]:
        """Rows (row, bucket) as the generation of the next version: one piece for each bucket. What a writer that failed left there is overwritten."""
        generation, place = f"{state.version + 1:010d}", state.place()
        sizes = [tuple(r) for r in rows.groupBy("bucket").count().collect()]  # at most as many as there are buckets
        if not sizes:
            return []
        slices = F.broadcast(self.spark.createDataFrame([(b, -(-n // FILE_ROWS)) for b, n in sizes], "bucket int, slices long"))
        dealt = rows.join(slices, "bucket").withColumn("slice", F.pmod(F.xxhash64("row"), "slices"))
        dealt = dealt.repartition("bucket", "slice").sortWithinPartitions("bucket", "row")
        fields = [F.col("row").getField(f.name).alias(f.name) for f in rows.schema["row"].dataType.fields]
        dealt.select(*fields, F.col("bucket").alias(place)).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy(place).parquet(f"{self.folder}/pieces/{generation}")
        return [Piece(b, generation, n) for b, n in sizes]

    def add(self, rows: DataFrame) -> int:
        """Add rows that are distinct and not there yet, for which the caller vouches, so that none is compared; how many there were. They are read twice."""
        state = self.state()
        row = F.struct(*[F.col(_quoted(c)) for c in state.kind().names])
        told = rows.select(row.alias("row")).select("row", self._bucket(state, [F.col("row").getField(k) for k in state.keys]).alias("bucket"))
        pieces = self._write(state, told)
        self._commit(state, state.last, [*state.pieces, *pieces])
        return sum(p.n for p in pieces)

    def fill(self, names: DataFrame, rows: DataFrame, make: Callable[[DataFrame], DataFrame], keep: str, tasks: int) -> DataFrame:
        """Add what make() makes of rows, written by the tasks that make it; returned are the rows made of which `keep` (SQL) is not true, which are not added, as a table to be freed.

        rows move once, to the buckets of their keys in about as many tasks, each
        with about as many rows. names are the key columns of rows, and tell how
        they are dealt. make() works row by row and leaves the key columns as they
        are; the caller vouches that what it adds is distinct and not there yet.
        """
        state = self.state()
        generation, place = f"{state.version + 1:010d}", state.place()
        path = f"{self.folder}/pieces/{generation}"
        sizes = sorted(tuple(r) for r in names.groupBy(self._bucket(state, [F.col(_quoted(k)) for k in state.keys]).alias("bucket")).count().collect())  # at most as many as there are buckets
        total = sum(n for _, n in sizes)
        dealt, before = [], 0
        for b, n in sizes:
            dealt.append((b, n, -(-n * tasks // total), before))
            before += n
        plan = F.broadcast(self.spark.createDataFrame(dealt, "bucket int, n long, slices long, before long"))
        keys = [F.col("row").getField(k) for k in state.keys]
        told = rows.select(F.struct(*[F.col(_quoted(c)) for c in rows.columns]).alias("row")).withColumn("bucket", self._bucket(state, keys)).join(plan, "bucket")
        slice_ = F.pmod(F.xxhash64(F.lit("slice"), *keys), "slices")  # by another hash than the bucket's
        task = F.floor((F.col("before") + slice_ * F.col("n") / F.col("slices")) * tasks / max(1, total)).cast("int")
        made = make(told.select("row", task.alias("task")).repartitionById(tasks, F.col("task")).select("row.*"))
        own = F.when(F.expr(keep), self._bucket(state, [F.col(_quoted(k)) for k in state.keys])).otherwise(F.lit(-1))
        fields = [F.col(_quoted(f.name)).cast(f.dataType).alias(f.name) for f in state.kind().fields]
        made.select(*fields, own.alias(place)).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy(place).parquet(path)
        written = self.spark.read.schema(StructType([*state.kind().fields, StructField(place, IntegerType())])).parquet(path)
        found = dict(tuple(r) for r in written.groupBy(_quoted(place)).count().collect())
        other = self.spark.read.schema(state.kind()).parquet(f"{path}/{place}=-1") if found.pop(-1, 0) else self.spark.createDataFrame([], state.kind())
        other = materialise(other, "other")
        delete(self.spark, f"{path}/{place}=-1")
        self._commit(state, state.last, [*state.pieces, *[Piece(b, generation, n) for b, n in found.items()]])
        return other

    def compact(self, most: int = 8) -> list[int]:
        """Make one piece of those of each bucket that has more than `most`; which buckets. No other bucket is read or written."""
        state = self.state()
        count: dict[int, int] = {}
        for p in state.pieces:
            count[p.bucket] = count.get(p.bucket, 0) + 1
        full = {b for b, n in count.items() if n > most}
        if not full:
            return []
        read = self._read(state, [p for p in state.pieces if p.bucket in full])
        row = F.struct(*[F.col(_quoted(c)) for c in read.columns])
        keys = [F.col("row").getField(k) for k in state.keys]
        pieces = self._write(state, read.select(row.alias("row")).select("row", self._bucket(state, keys).alias("bucket")))
        self._commit(state, state.last, [*[p for p in state.pieces if p.bucket not in full], *pieces])
        return sorted(full)

    def vacuum(self) -> int:
        """Delete the pieces of earlier versions that the newest one does not name, and those versions; how many pieces. Readers of earlier versions must have ended."""
        state = self.state()
        old = self.spark.read.schema(f"{_STATE}, version long").parquet(f"{self.folder}/versions").where(F.col("version") < state.version).collect()
        gone = {Piece(*p) for r in old for p in r["pieces"]} - set(state.pieces)
        delete(self.spark, *[self._path(state, p) for p in sorted(gone)])
        delete(self.spark, *[f"{self.folder}/versions/version={r['version']}" for r in old])
        return len(gone)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
