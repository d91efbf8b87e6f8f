"""Sorted Parquet files with one manifest, written so that nothing shows before all of it is there: ``format("manifested")``.

Each task writes a file of its own name below ``_pending`` and reports what is in it; the commit, on the
driver, gets these short reports, moves the files and writes the manifest last. Readers go by the manifest, so files of
a stopped or repeated task are never read, and an aborted write leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lattica.sources.arrays import store

NAME, MANIFEST = "manifested", "manifest.json"
#: Ids of rejected rows that the manifest names, the smallest.
NAMED = 50


@dataclass
class Report(WriterCommitMessage):
    """What a task wrote: the file, its rows, the range of the sort key, how many rejects, and the smallest of their ids."""

    file: str = ""
    rows: int = 0
    first: object = None
    last: object = None
    rejects: int = 0
    ids: list = field(default_factory=list)


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.key = options["path"], options["key"]
        self.id, self.reject = options.get("id", self.key), options.get("reject")
        self.fields, self.attempt = schema.fieldNames(), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Report:
        system, root = store(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.parquet"
        report, out = Report(), None
        system.create_dir(f"{root}/_pending-{self.attempt}")
        for b in iterator:
            if not b.num_rows:
                continue
            bad = pc.fill_null(b.column(self.reject), False) if self.reject else None
            if bad is not None:
                ids = b.column(self.id).filter(bad)
                report.rejects += len(ids)
                report.ids = sorted([*report.ids, *ids.drop_null().to_pylist()])[:NAMED]
                b = b.filter(pc.invert(bad)).drop_columns([self.reject])
            if not b.num_rows:
                continue
            out = out or pq.ParquetWriter(system.open_output_stream(f"{root}/_pending-{self.attempt}/{name}"), b.schema, compression="snappy")
            out.write_batch(b)
            low, high = pc.min_max(b.column(self.key)).as_py().values()
            report.rows += b.num_rows
            report.first = low if report.first is None else min(report.first, low)
            report.last = high if report.last is None else max(report.last, high)
        if out:
            out.close()
            out.file_handle and out.file_handle.close()
            report.file = name
        return report

    def commit(self, messages: list[Report | None]) -> None:
        system, root = store(self.path)
        known = sorted((m for m in messages if m and m.file), key=lambda m: (m.first, m.file))
        for m in known:
            system.move(f"{root}/_pending-{self.attempt}/{m.file}", f"{root}/{m.file}")
        about = {
            "rows": sum(m.rows for m in known), "first": known[0].first if known else None, "last": max((m.last for m in known), default=None),
            "rejects": sum(m.rejects for m in messages if m), "reject_ids": sorted(i for m in messages if m for i in m.ids)[:NAMED],
            "files": [{"name": m.file, "rows": m.rows, "first": m.first, "last": m.last} for m in known],
        }
        with system.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(about).encode())
        system.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        self._clear(system, root)

    def abort(self, messages: list[Report | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_pending-{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_pending-{self.attempt}")


class Manifested(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(schema, dict(self.options))


def write_sorted(rows: DataFrame, path: str, key: str, reject: Column | None = None, id: str | None = None, first: list[Column] = ()) -> None:
    """Files sorted by ``first`` and ``key`` over ranges, one for each task, with a manifest: rows, first and last key, rejects and the smallest of their ids.

    Rows that ``reject`` marks are counted and left out. The key is a number or a string that is never null in rows that stay.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Manifested)
    marked = rows.withColumn("_reject", F.coalesce(reject, F.lit(False)) if reject is not None else F.lit(False))
    ordered = marked.repartitionByRange(*first, key).sortWithinPartitions(*first, key)
    ordered.write.format(NAME).mode("append").options(path=path, key=key, id=id or key, reject="_reject").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as a row, with its files as an array."""
    return spark.read.schema("rows long, first long, last long, rejects long, reject_ids array<long>, files array<struct<name:string,rows:long,first:long,last:long>>").json(f"{path}/{MANIFEST}")


def read_sorted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the files that the manifest names; none before there is one."""
    system, root = store(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return spark.createDataFrame([], schema)
    with system.open_input_file(f"{root}/{MANIFEST}") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    return spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in names)) if names else spark.createDataFrame([], schema)
