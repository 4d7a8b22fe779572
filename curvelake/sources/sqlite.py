"""SQLite tables as a Spark data source: format 'sqlite' with options path, table and partitions.

Each partition reads a range of rowids, and equality and IN filters are pushed into the query of every partition.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def tables(path: str) -> list[str]:
    with _open(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, declared type) of a table's columns."""
    with _open(path) as con:
        return [(r[1], r[2] or "") for r in con.execute(f"PRAGMA table_info({quoted(table)})")]


def _type(declared: str):
    d = declared.upper()
    return LongType() if "INT" in d or "BOOL" in d else BinaryType() if "BLOB" in d else DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", 8))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.where.append((f"{quoted(f.attribute[0])} = ?", [f.value]))
            elif isinstance(f, In) and len(f.attribute) == 1 and len(f.value) <= 500 and all(isinstance(v, (str, int, float)) for v in f.value):
                self.where.append((f"{quoted(f.attribute[0])} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            yield f  # Spark checks every row again, as SQLite columns hold values of any type

    def partitions(self) -> Sequence[InputPartition]:
        try:
            with _open(self.path) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.Error:  # a view or a table without rowid
            return [_Range(None, None)]
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        where, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.low is not None:
            where, values = ["rowid >= ? AND rowid < ?", *where], [partition.low, partition.high, *values]
        sql = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        casts = [_cast(f.dataType) for f in self.schema.fields]
        with _open(self.path) as con:
            for row in con.execute(sql, values):
                yield tuple(None if v is None else c(v) for c, v in zip(casts, row))


def _cast(kind):
    def number(make):
        def cast(v):
            try:
                return make(v)
            except (TypeError, ValueError):
                return None

        return cast

    return number(int) if isinstance(kind, LongType) else number(float) if isinstance(kind, DoubleType) else (lambda v: v if isinstance(v, bytes) else str(v).encode()) if isinstance(kind, BinaryType) else str


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        found = columns(self.options["path"], self.options["table"])
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(n, _type(t)) for n, t in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame | None:
    """A table of a database every executor can reach; None where there is no such table."""
    if table not in tables(path):
        return None
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def first_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame | None:
    """The first of the tables that exists and has rows."""
    for name in names:
        df = read(spark, path, name)
        if df is not None and not df.isEmpty():
            return df
    return None


def features(spark: SparkSession, path: str, stats: Sequence[str] = ("mean", "std", "median")) -> DataFrame | None:
    """The feature table: features_core, features or features_all, else the pivot of summary (variant, metric and
    statistics); joined with the sequence descriptors where there are any."""
    from curvelake.operators.tables import annotate, pivot_stats

    df = first_table(spark, path, ("features_core", "features", "features_all"))
    if df is None:
        long = read(spark, path, "summary")
        if long is None:
            return None
        names = [r["metric"] for r in long.where("metric IS NOT NULL").select("metric").distinct().orderBy("metric").collect()]  # they become columns
        df = pivot_stats(long, "variant", "metric", [s for s in stats if s in long.columns], names)
    described = first_table(spark, path, ("sequence_features", "features_sequence"))
    return annotate(df, described, "variant")[0] if described is not None else df
