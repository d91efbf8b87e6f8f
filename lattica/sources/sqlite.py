"""SQLite tables as a Python data source: ranges of row ids of each database are partitions; the wanted columns and a condition go into SQLite's own query.

SQLite opens files only, so databases must lie in a folder that is mounted on the driver and all executors. The condition is given
when the table is opened: Spark 4.1 keeps filters that a Python source took over for later queries of the same DataFrame.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lattica.sources.arrays import store

NAME = "sqlite_table"
#: Column affinities by what a declared type holds, first match first, with Spark's type; others hold text.
AFFINITIES = [("INT", "bigint"), ("CHAR|CLOB|TEXT", "string"), ("BLOB", "binary"), ("REAL|FLOA|DOUB|NUM|DEC", "double")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def databases(path: str, suffix: str = ".db") -> list[str]:
    """The database at a path, or all of a folder in order of their names."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        raise ValueError(f"SQLite opens mounted files only, not {path}")
    _, root = store(path)
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(root, f) for f in os.listdir(root) if f.endswith(suffix) and not f.startswith((".", "_")))


def opened(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True))


@dataclass
class Range(InputPartition):
    """Row ids from ``low`` to ``high`` of a database, or all of a table without row ids."""

    path: str
    low: int | None = None
    high: int | None = None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Range]:
        parts, rows, table = [], int(self.options.get("rows", "100000")), quoted(self.options["table"])
        for path in databases(self.options["path"]):
            with opened(path) as db:
                try:
                    n, low, high = db.execute(f"SELECT count(*), min(rowid), max(rowid) FROM {table}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    parts.append(Range(path))
                    continue
            if n:
                width = -(-(high - low + 1) // -(-n // rows))  # ids may have gaps, so ranges are as many as the rows need
                parts += [Range(path, i, min(high, i + width - 1)) for i in range(low, high + 1, width)]
        return parts or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema, where, values = to_arrow_schema(self.schema), [], []
        if "where" in self.options:
            where.append(f"({self.options['where']})")
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values = [partition.low, partition.high]
        text = f"SELECT {', '.join(map(quoted, schema.names)) or '1'} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with opened(partition.path) as db:
            found = db.execute(text, values)
            while rows := found.fetchmany(8192):
                columns = zip(*rows, strict=True) if schema.names else []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str


class SqliteWriter(DataSourceArrowWriter):
    """Each task fills a hidden database of its own; all get their names when the job commits, and vanish when it fails."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        _, root = store(self.options["path"])
        os.makedirs(root, exist_ok=True)
        path, table = os.path.join(root, f".{uuid.uuid4().hex}.db"), quoted(self.options["table"])
        kinds = {"long": "INTEGER", "integer": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
        columns = [f"{quoted(f.name)} {kinds[f.dataType.typeName()]}" for f in self.schema.fields]
        with closing(sqlite3.connect(path)) as db:
            db.execute(f"CREATE TABLE {table} ({', '.join(columns)})")
            for b in iterator:
                db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
            db.commit()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        for n, m in enumerate(m for m in messages if m):
            os.replace(m.path, os.path.join(os.path.dirname(m.path), f"part-{n:05d}-{os.path.basename(m.path)[1:]}"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.unlink(m.path)


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        """From the declared types of the first database."""
        with opened(databases(self.options["path"])[0]) as db:
            declared = db.execute("SELECT name, upper(type) FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not declared:
            raise ValueError(f"no table {self.options['table']}")
        spark_type = lambda kind: next((t for pattern, t in AFFINITIES if re.search(pattern, kind)), "string")
        return ", ".join(f"`{name}` {spark_type(kind)}" for name, kind in declared)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, fields: str | None = None, where: str | None = None, rows: int = 100_000) -> DataFrame:
    """A table of the database at ``path``, or of all databases of a folder.

    ``fields``: the schema of the wanted columns, by default all; ``where``: a condition in SQLite's SQL; ``rows``: the rows for which a partition is made.
    """
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format(NAME).options(path=path, table=table, rows=rows, **({"where": where} if where else {}))
    return (reader.schema(fields) if fields else reader).load()


def write_table(rows: DataFrame, path: str, table: str) -> None:
    """The rows as databases in a folder, one for each task, that show together when the job commits."""
    rows.sparkSession.dataSource.register(SqliteTable)
    rows.write.format(NAME).mode("append").options(path=path, table=table).save()
