"""Tables of SQLite files as a Python data source: ranges of row ids are partitions, filters go into the SQL, and only the
columns of the schema that is asked for are read."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

_TYPES = {"INT": "long", "REAL": "double", "FLOA": "double", "DOUB": "double"}
_COMPARED = {ds.EqualTo: "=", ds.EqualNullSafe: "IS", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Rows(ds.InputPartition):
    """Row ids from first to last, the latter exclusive."""

    first: int
    last: int

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType):
        self.path, self.table, self.parts, self.schema = path, table, parts, schema
        self.conditions: list[str] = []
        self.values: list = []

    def _condition(self, f: ds.Filter) -> tuple[str, list] | None:
        """SQL of a filter and its values, None where SQLite might see it otherwise than Spark."""
        if isinstance(f, ds.Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.schema.names:
            return None
        column, kind = _quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType.typeName()
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            return f"{column} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []
        fits = {"string": str, "long": int, "integer": int, "double": float}.get(kind)
        plain = lambda v: fits is not None and isinstance(v, fits) and not isinstance(v, bool) and v == v
        if isinstance(f, ds.In):
            return (f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)) if f.value and all(map(plain, f.value)) else None
        if type(f) in _COMPARED and plain(f.value):
            return f"{column} {_COMPARED[type(f)]} ?", [f.value]
        return None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if (found := self._condition(f)) is None:
                yield f
            else:
                self.conditions.append(found[0])
                self.values += found[1]

    def sql(self) -> str:
        """The statement of a partition; its first values are the range of row ids."""
        columns = ", ".join(map(_quoted, self.schema.names)) or "1"
        return f"SELECT {columns} FROM {_quoted(self.table)} WHERE " + " AND ".join(["rowid >= ?", "rowid < ?", *(f"({c})" for c in self.conditions)])

    def partitions(self) -> list[Rows]:
        with _opened(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        casts = [{"string": str, "double": float, "long": int, "integer": int}.get(f.dataType.typeName(), lambda v: v) for f in self.schema]
        with _opened(self.path) as con:
            for row in con.execute(self.sql(), [partition.first, partition.last, *self.values]):
                yield tuple(None if v is None else c(v) for v, c in zip(row, casts, strict=False))


class SqliteTable(ds.DataSource):
    """Options: path, table and parts. The schema is the table's, or the part of it that is asked for."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with _opened(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{name}` {_TYPES.get((kind or '').upper()[:4], _TYPES.get((kind or '').upper()[:3], 'string'))}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("parts", 8)), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that every worker can open; schema names the columns to read, all by default. Filters of
    single columns are handed to SQLite, which needs Spark's setting for filters of Python sources; it is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("table", table).option("parts", parts).option("path", path)
    return (reader.schema(schema) if schema else reader).load()
