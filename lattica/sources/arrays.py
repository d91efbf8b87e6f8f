"""Groups of gridded arrays as a Spark data source: ``spark.read.format("array_groups")``.

A folder of ``*.zarr`` groups, formats 2 and 3, is read with one input partition for each group (or for
each brick of a group); only the groups of ``ids``, if given, and the fields of the reader's schema are read: without ``density`` no chunk is opened. A patch or a brick opens just the chunks
that it touches. Writing puts one group for each row; a group's own metadata comes last, so a group is
either whole or invisible, and a task that runs again writes the same files.

Options: ``array`` (its name in the group), ``ids`` (a JSON list), ``depth`` (levels of folders searched), and for reading
``offset`` and ``size`` (``"5,9,44"`` and ``"14,14,14"``: a periodic patch of every group), ``brick`` (a side: bricks
of that many cells), or ``groups`` (so many small groups to a partition); for writing ``chunk``,
``version`` (2 or 3) and ``codec`` (zstd, gzip or none).
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "array_groups"
SCHEMA = "task_id string, nx int, ny int, nz int, x0 int, y0 int, z0 int, sx int, sy int, sz int, density array<double>, structure string, metadata string, chunks_read int, error string"
TOTAL = "charge_density_total"
GRID = {"nx", "ny", "nz", "x0", "y0", "z0", "sx", "sy", "sz", "density", "chunks_read"}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def as_object(value: object) -> object:
    """An attribute that is an object or, as some writers store it, the JSON text of one."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


@dataclass
class Array:
    """One array of a group: its layout, and reading of any box of it chunk by chunk."""

    group: Group
    name: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    kind: np.dtype
    codecs: list[str]
    fill: float
    order: str
    separator: str
    prefix: str

    def __post_init__(self):
        self.opened = 0
        self._held: dict[tuple[int, ...], np.ndarray | None] | None = None

    def _chunk(self, place: tuple[int, ...]) -> np.ndarray | None:
        if self._held is None:
            return self._decoded(place)
        if place not in self._held:
            self._held[place] = self._decoded(place)
        return self._held[place]

    def _decoded(self, place: tuple[int, ...]) -> np.ndarray | None:
        body = self.group.file(f"{self.name}/{self.prefix}{self.separator.join(map(str, place))}")
        if body is None:
            return None
        self.opened += 1
        for codec in reversed(self.codecs):
            if codec == "zstd":
                body = pa.decompress(body, int(np.prod(self.chunk)) * self.kind.itemsize, "zstd", asbytes=True)
            elif codec in ("gzip", "zlib"):
                body = zlib.decompress(body, 47)
            elif codec == "crc32c":
                body = body[:-4]
            else:
                raise ValueError(f"no decoder for {codec}")
        return np.frombuffer(body, self.kind).reshape(self.chunk, order=self.order)

    def box(self, low: tuple[int, ...], high: tuple[int, ...]) -> np.ndarray:
        """The cells from ``low`` up to ``high`` inside the array; chunks that are not there hold the fill value."""
        out = np.full([b - a for a, b in zip(low, high, strict=True)], self.fill, self.kind.newbyteorder("="))
        for place in itertools.product(*(range(a // c, -(-b // c)) for a, b, c in zip(low, high, self.chunk, strict=True))):
            if (held := self._chunk(place)) is not None:
                ends = [(max(a, p * c), min(b, (p + 1) * c), p * c, a) for a, b, p, c in zip(low, high, place, self.chunk, strict=True)]
                out[tuple(slice(s - a, e - a) for s, e, _, a in ends)] = held[tuple(slice(s - at, e - at) for s, e, at, _ in ends)]
        return out

    def patch(self, offset: tuple[int, ...], size: tuple[int, ...]) -> np.ndarray:
        """A box with periodic wrap on each axis. A chunk that it meets from both sides is opened once."""
        axes, self._held = [], {}
        for o, s, n in zip(offset, size, self.shape, strict=True):
            done, parts = 0, []
            while done < s:
                at = (o + done) % n
                step = min(s - done, n - at)
                parts.append((at, at + step, done))
                done += step
            axes.append(parts)
        out = np.empty(size, self.kind.newbyteorder("="))
        for parts in itertools.product(*axes):
            out[tuple(slice(d, d + b - a) for a, b, d in parts)] = self.box(tuple(p[0] for p in parts), tuple(p[1] for p in parts))
        self._held = None
        return out


@dataclass
class Group:
    """A ``*.zarr`` folder."""

    path: str

    @cached_property
    def _store(self) -> tuple[fs.FileSystem, str]:
        return store(self.path)

    def file(self, name: str) -> bytes | None:
        system, root = self._store
        try:
            with system.open_input_file(f"{root}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _json(self, name: str) -> dict | None:
        body = self.file(name)
        return None if body is None else json.loads(body)

    @cached_property
    def attributes(self) -> dict:
        """Of format 3 (``zarr.json``) or 2 (``.zattrs``)."""
        about = self._json("zarr.json")
        found = about.get("attributes", {}) if about is not None else self._json(".zattrs")
        if found is None:
            raise KeyError("neither zarr.json nor .zattrs")
        return found

    @property
    def task_id(self) -> str:
        about = as_object(self.attributes.get("metadata"))
        stem = self.path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".zarr")
        return str(about.get("task_id", stem)) if isinstance(about, dict) else stem

    def array(self, name: str) -> Array:
        if (m := self._json(f"{name}/zarr.json")) is not None:
            codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
            order = "<" if codecs.pop("bytes", {}).get("endian", "little") == "little" else ">"
            keys = m.get("chunk_key_encoding", {})
            separator = keys.get("configuration", {}).get("separator", "/" if keys.get("name", "default") == "default" else ".")
            prefix = f"c{separator}" if keys.get("name", "default") == "default" else ""
            return Array(self, name, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), np.dtype(m["data_type"]).newbyteorder(order), list(codecs), m.get("fill_value") or 0, "C", separator, prefix)
        if (m := self._json(f"{name}/.zarray")) is None:
            raise KeyError(f"no array {name}")
        squeezed = [m["compressor"]["id"]] if m.get("compressor") else []
        return Array(self, name, tuple(m["shape"]), tuple(m["chunks"]), np.dtype(m["dtype"]), [f["id"] for f in m.get("filters") or []] + squeezed, m.get("fill_value") or 0, m.get("order", "C"), m.get("dimension_separator", "."), "")


@dataclass
class Part(InputPartition):
    """Groups, and of each the box that is read: a periodic patch, a brick, or all."""

    paths: tuple[str, ...]
    offset: tuple[int, ...] | None = None
    size: tuple[int, ...] | None = None


def group_paths(path: str, depth: int = 3) -> list[str]:
    """All ``*.zarr`` folders at most ``depth`` levels down, by name; groups themselves are not searched."""
    system, root = store(path)
    found, level = [], [root]
    for _ in range(depth):
        inner = [f.path for at in level for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory]
        found += [f for f in inner if f.endswith(".zarr")]
        level = [f for f in inner if not f.endswith(".zarr")]
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    return [scheme + f for f in sorted(found)]


class GroupReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = schema.fieldNames(), options
        self.ids = set(json.loads(options["ids"])) if "ids" in options else None
        triple = lambda name: tuple(int(x) for x in options[name].split(",")) if name in options else None
        self.array, self.offset, self.size = options.get("array", TOTAL), triple("offset"), triple("size")
        self.schema = schema

    def partitions(self) -> list[Part]:
        paths, n = group_paths(self.options["path"], int(self.options.get("depth", "3"))), int(self.options.get("groups", "1"))
        if "brick" not in self.options:
            return [Part(tuple(paths[i : i + n]), self.offset, self.size) for i in range(0, len(paths), n)]
        side, parts = int(self.options["brick"]), []
        for path in paths:
            try:
                shape = Group(path).array(self.array).shape
            except (KeyError, ValueError, OSError):
                shape = (1,)  # read, it gives the row that names the error
            parts += [Part((path,), at, tuple(min(side, n - a) for a, n in zip(at, shape, strict=True))) for at in itertools.product(*(range(0, n, side) for n in shape))]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            group, row = Group(path), dict.fromkeys(self.fields)
            row["task_id"] = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".zarr")
            try:
                row["task_id"] = group.task_id
                if self.ids is not None and row["task_id"] not in self.ids:
                    continue
                for name in ("structure", "metadata"):
                    value = group.attributes.get(name)
                    row[name] = value if value is None or isinstance(value, str) else json.dumps(value)
                if GRID & set(self.fields):
                    grid = group.array(self.array)
                    at, size = partition.offset or (0,) * len(grid.shape), partition.size or grid.shape
                    row |= dict(zip(("nx", "ny", "nz", "x0", "y0", "z0", "sx", "sy", "sz"), (*grid.shape, *at, *size), strict=True))
                    if "density" in self.fields:
                        row["density"] = grid.patch(at, size).astype(float).ravel()
                    row["chunks_read"] = grid.opened
            except (KeyError, ValueError, OSError) as e:
                row["error"] = f"{type(e).__name__}: {e}"
                if self.ids is not None and row["task_id"] not in self.ids:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)


class GroupWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        n, (system, root) = 0, store(self.options["path"])
        version, codec = int(self.options.get("version", "3")), self.options.get("codec", "zstd")
        for row in iterator:
            shape = (row.nx, row.ny, row.nz)
            chunk = tuple(int(x) for x in self.options["chunk"].split(",")) if "chunk" in self.options else shape
            write_group(system, f"{root}/{row.task_id}.zarr", np.asarray(row.density, np.float32).reshape(shape), chunk, {"structure": row.structure, "metadata": row.metadata}, self.options.get("array", TOTAL), version, codec)
            n += 1
        return WriterCommitMessage()


def write_group(system: fs.FileSystem, path: str, grid: np.ndarray, chunk: tuple[int, ...], attributes: dict, array: str = TOTAL, version: int = 3, codec: str = "zstd") -> None:
    """One group: chunks, then the array's metadata, last the group's own. Chunks at the edge are padded with zeros."""

    def put(name: str, body: bytes) -> None:
        system.create_dir(f"{path}/{name}".rsplit("/", 1)[0])
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(body)

    squeeze = {"zstd": lambda b: pa.compress(b, "zstd", asbytes=True), "gzip": lambda b: zlib.compress(b, wbits=31), "none": lambda b: b}[codec]
    for place in np.ndindex(*(-(-n // c) for n, c in zip(grid.shape, chunk, strict=True))):
        part = grid[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunk, strict=True))]
        part = np.pad(part, [(0, c - n) for c, n in zip(chunk, part.shape, strict=True)])
        put(f"{array}/" + ("c/" + "/".join(map(str, place)) if version == 3 else ".".join(map(str, place))), squeeze(part.astype("<f4").tobytes()))
    if version == 3:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([] if codec == "none" else [{"name": codec, "configuration": {"level": 1}}])]
        about = {"zarr_format": 3, "node_type": "array", "shape": grid.shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0.0, "codecs": codecs, "attributes": {}}
        put(f"{array}/zarr.json", json.dumps(about).encode())
        put("zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}).encode())
    else:
        about = {"zarr_format": 2, "shape": grid.shape, "chunks": chunk, "dtype": "<f4", "compressor": None if codec == "none" else {"id": codec, "level": 1}, "fill_value": 0.0, "order": "C", "filters": None}
        put(f"{array}/.zarray", json.dumps(about).encode())
        put(".zgroup", json.dumps({"zarr_format": 2}).encode())
        put(".zattrs", json.dumps(attributes).encode())


class ArrayGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> GroupReader:
        return GroupReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> GroupWriter:
        return GroupWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(ArrayGroups)


def read_groups(spark: SparkSession, path: str, fields: str | None = None, ids: Iterable[str] | None = None, **options: object) -> DataFrame:
    """Groups below a path; ``fields`` is the schema of what is wanted, by default all. A group that cannot be read gives a row with ``error``.

    ``ids``: only these are read; of other groups no chunk is opened. They are given here, not as a filter:
    Spark 4.1 keeps a filter that a Python source took over for later queries of the same DataFrame.
    """
    register(spark)
    reader = spark.read.format(NAME).options(path=path, **options, **({} if ids is None else {"ids": json.dumps(sorted(ids))}))
    return (reader.schema(fields) if fields else reader).load()


def write_groups(grids: DataFrame, path: str, **options: object) -> None:
    """One group for each row (task_id, nx, ny, nz, density, structure, metadata); values in single precision."""
    register(grids.sparkSession)
    grids.select("task_id", "nx", "ny", "nz", "density", "structure", "metadata").write.format(NAME).mode("append").options(path=path, **options).save()


def density_view(groups: DataFrame) -> DataFrame:
    """What a loader of volumetric text files gives, of array groups: (task_id, grid, total, structure)."""
    from pyspark.sql import functions as F

    return groups.where("error is null").select("task_id", F.array("nx", "ny", "nz").alias("grid"), F.col("density").alias("total"), "structure")


def read_patches(requests: DataFrame, size: int, array: str = TOTAL) -> DataFrame:
    """(path, offset, patch, chunks_read) of periodic cubes: ``requests`` has a group's path and an offset array<int>; only the chunks of a patch are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            patches, opened = [], []
            for path, offset in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grid = Group(path).array(array)
                patches.append(grid.patch(tuple(offset), (size,) * 3).astype(float).ravel())
                opened.append(grid.opened)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(patches, pa.list_(pa.float64())), pa.array(opened, pa.int32())], names=["path", "offset", "patch", "chunks_read"])

    return requests.select("path", "offset").mapInArrow(run, "path string, offset array<int>, patch array<double>, chunks_read int")
