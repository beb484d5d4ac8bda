"""SQLite files as a Spark data source: whole tables in ranges of rowid, filters pushed down, list of tables."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringContains


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    d = (declared or "").upper()
    return T.LongType() if "INT" in d else T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else T.BinaryType() if "BLOB" in d else T.StringType()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int):
        self.path, self.table, self.schema, self.parts, self.where, self.args = path, table, schema, parts, [], []

    def pushFilters(self, filters):
        for f in filters:
            names = f.attribute
            if len(names) == 1 and isinstance(f, EqualTo):
                self.where.append(f"{_quoted(names[0])} = ?")
                self.args.append(f.value)
            elif len(names) == 1 and isinstance(f, StringContains):
                self.where.append(f"instr({_quoted(names[0])}, ?) > 0")
                self.args.append(f.value)
            else:
                yield f

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table WITHOUT ROWID or a view is read in one part
                return [_Range(None, None)]
        if low is None:
            return [_Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        ranged = partition.low is not None
        where = " AND ".join([*(["rowid BETWEEN ? AND ?"] if ranged else ["1"]), *self.where])
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {where}", [*([partition.low, partition.high] if ranged else []), *self.args])


class SqliteDataSource(DataSource):
    """Options: path (a file that all executors can open), dbtable, numPartitions."""

    @classmethod
    def name(cls):
        return "statuta_sqlite"

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['dbtable']}")
        asked = json.loads(self.options.get("columns", "null"))
        return T.StructType([T.StructField(r[1], _kind(r[2])) for r in rows if asked is None or r[1] in asked])

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("numpartitions", self.options.get("numPartitions", 8))))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8, columns: list[str] | None = None) -> DataFrame:
    """A table, or the given columns of it: the others are then not read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteDataSource)
    return spark.read.format("statuta_sqlite").option("dbtable", table).option("numPartitions", parts).option("path", path).option("columns", json.dumps(columns)).load()


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
