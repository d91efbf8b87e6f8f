"""Rows, or groups of rows from partitions sorted by their keys, handed to a function one after the other; arrays of numbers come as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Columns = dict[str, list]
#: Values of arrays that are put into one batch.
VALUES = 1 << 20


def _cuts(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows that differ in a key from the row before; the first is always one."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = b.column(k)
        new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _plain(column: pa.ChunkedArray) -> list:
    """Lists of numbers as arrays, all else as Python values."""
    if not pa.types.is_list(column.type) or pa.types.is_nested(column.type.value_type):
        return column.to_pylist()
    out = []
    for chunk in column.chunks:
        values, ends, valid = chunk.values.to_numpy(), chunk.offsets.to_numpy(), chunk.is_valid().to_numpy(zero_copy_only=False)
        out += [values[a:z] if ok else None for a, z, ok in zip(ends[:-1], ends[1:], valid, strict=True)]
    return out


def _batched(rows: Iterator[tuple], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some thousands, fewer where their arrays are long."""
    out, size = [], 0

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, np.ndarray))
        if size > VALUES or len(out) > 4096:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def each_row(rows: DataFrame, run: Callable[..., Iterator[tuple]], schema: StructType) -> DataFrame:
    """``run`` gets the values of each row and gives rows of ``schema``; no shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        given = (row for b in batches for row in zip(*(_plain(pa.chunked_array([c])) for c in b.columns), strict=True))
        yield from _batched((made for row in given for made in run(*row)), to_arrow_schema(schema))

    return rows.mapInArrow(task, schema)


def by_group(rows: DataFrame, keys: list[str], run: Callable[[Columns], Iterator[tuple]], schema: StructType) -> DataFrame:
    """``run`` gets the columns of each group and gives rows of ``schema``. A task sorts its rows, with spilling, and holds one group at a time; keys are not null."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        held: Columns | None = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = {name: _plain(pa.chunked_array([c])) for name, c in zip(b.schema.names, b.columns, strict=True)}
            cuts = _cuts(b, keys)
            goes_on = held is not None and all(held[k][-1] == columns[k][0] for k in keys)
            for first, last in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                part = {name: c[first:last] for name, c in columns.items()}
                if goes_on and first == 0:
                    for name, c in part.items():
                        held[name] += c
                    continue
                if held is not None:
                    yield held
                held = part
        if held is not None:
            yield held

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batched((row for g in groups(batches) for row in run(g)), to_arrow_schema(schema))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)
