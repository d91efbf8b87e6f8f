"""Grids larger than a row: bricks of side^3 cells, their halos, and the work on patches, tiles and blocks with one brick in hand.

A brick is a row (task_id, nx, ny, nz, side, bx, by, bz, brick array<double>): the cells from
``side * b`` up to ``side * (b + 1)`` or the grid's end on each axis, in x-major order. No step holds more
than a brick with its halo, whatever the grid's size; the grid wraps around on each axis.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators import patches as P
from lattica.operators.grouped import Columns, by_group, each_row

SIZES, PLACE = ["nx", "ny", "nz"], ["bx", "by", "bz"]
_PLACED = "nx int, ny int, nz int, side int, bx int, by int, bz int"
#: Patches that are cut from a brick at a time.
TOGETHER = 256


def _typed(rows: DataFrame, rest: str) -> StructType:
    return StructType([rows.schema["task_id"], *StructType.fromDDL(rest).fields])


def sides(n: tuple[int, ...], side: int, b: tuple[int, ...]) -> tuple[int, ...]:
    """The shape of brick b."""
    return tuple(min(side, size - side * i) for size, i in zip(n, b, strict=True))


def from_voxels(voxels: DataFrame, sizes: DataFrame, side: int) -> DataFrame:
    """Bricks of a voxel table (task_id, ix, iy, iz, rho); ``sizes``: (task_id, nx, ny, nz). A group is one brick."""
    keyed = voxels.join(sizes, "task_id").withColumns({f"b{a}": F.floor(F.col(f"i{a}") / side).cast("int") for a in "xyz"})
    rows = keyed.groupBy("task_id", *SIZES, *PLACE).agg(F.array_sort(F.collect_list(F.struct("ix", "iy", "iz", "rho"))).alias("v"))
    return rows.select("task_id", *(F.col(c).cast("int").alias(c) for c in SIZES), F.lit(side).alias("side"), *PLACE, F.transform("v", lambda v: v["rho"].cast("double")).alias("brick"))


def from_packed(grids: DataFrame, side: int) -> DataFrame:
    """Bricks of grids that still fit a row."""

    def run(task_id: object, nx: int, ny: int, nz: int, density: np.ndarray) -> Iterator[tuple]:
        n = (nx, ny, nz)
        grid = np.asarray(density, float).reshape(n)
        for b in itertools.product(*(range(-(-size // side)) for size in n)):
            yield task_id, *n, side, *b, grid[tuple(slice(side * i, side * (i + 1)) for i in b)].ravel()

    return each_row(grids.select("task_id", *SIZES, "density"), run, _typed(grids, f"{_PLACED}, brick array<double>"))


def from_groups(groups: DataFrame, side: int) -> DataFrame:
    """Bricks of array groups that were read with the option ``brick=side``: one input partition each, no shuffle."""
    return groups.where("error is null").select("task_id", *SIZES, F.lit(side).alias("side"), *((F.col(f"{a}0") / side).cast("int").alias(f"b{a}") for a in "xyz"), F.col("density").alias("brick"))


def to_packed(bricks: DataFrame) -> DataFrame:
    """(task_id, nx, ny, nz, density) for grids that fit a row."""

    def run(c: Columns) -> Iterator[tuple]:
        n = tuple(c[x][0] for x in SIZES)
        grid = np.zeros(n)
        for side, bx, by, bz, brick in zip(*(c[x] for x in ("side", *PLACE, "brick")), strict=True):
            b = (bx, by, bz)
            grid[tuple(slice(side * i, side * (i + 1)) for i in b)] = np.reshape(brick, sides(n, side, b))
        yield c["task_id"][0], *n, grid.ravel()

    return by_group(bricks.select("task_id", *SIZES, "side", *PLACE, "brick"), ["task_id"], run, _typed(bricks, "nx int, ny int, nz int, density array<double>"))


def shares(n: int, side: int, low: int, high: int, b: int) -> list[tuple[int, int, int, int]]:
    """What brick b of an axis gives to the bricks around it, itself among them: (their index, first cell and last cell + 1 in b, place of the first in their cells with halo)."""
    first, last, found = side * b, min(side * (b + 1), n), []
    for target in range(-(-n // side)):
        begin, end = side * target - low, min(side * (target + 1), n) + high
        for turn in range((begin - last) // n, (end - first) // n + 1):
            a, z = max(begin, first + turn * n), min(end, last + turn * n)
            if a < z:
                found.append((target, a - turn * n - first, z - turn * n - first, a - begin))
    return found


_PIECE = f"{_PLACED}, px int, py int, pz int, dx int, dy int, dz int, piece array<double>"
_AT, _LONG = ["px", "py", "pz"], ["dx", "dy", "dz"]


def _joined(pieces: DataFrame, low: int, high: int, name: str) -> DataFrame:
    """The pieces of each brick, with halos of that width, put together; cells that no piece gives are NaN. A group is one brick."""

    def run(c: Columns) -> Iterator[tuple]:
        n, side, b = tuple(c[x][0] for x in SIZES), c["side"][0], tuple(c[x][0] for x in PLACE)
        out = np.full(tuple(s + low + high for s in sides(n, side, b)), np.nan)
        for px, py, pz, dx, dy, dz, piece in zip(*(c[x] for x in (*_AT, *_LONG, "piece")), strict=True):
            out[px : px + dx, py : py + dy, pz : pz + dz] = np.reshape(piece, (dx, dy, dz))
        yield c["task_id"][0], *n, side, *b, out.ravel()

    return by_group(pieces, ["task_id", *PLACE], run, _typed(pieces, f"{_PLACED}, {name} array<double>"))


def with_halo(bricks: DataFrame, low: int, high: int) -> DataFrame:
    """Bricks with ``low`` more cells before and ``high`` after them on each axis (column ``halo``), by one exchange of borders."""

    def run(task_id: object, nx: int, ny: int, nz: int, side: int, bx: int, by: int, bz: int, brick: np.ndarray) -> Iterator[tuple]:
        n, b = (nx, ny, nz), (bx, by, bz)
        cells = np.reshape(brick, sides(n, side, b))
        for parts in itertools.product(*(shares(size, side, low, high, i) for size, i in zip(n, b, strict=True))):
            piece = cells[tuple(slice(a, z) for _, a, z, _ in parts)]
            yield task_id, *n, side, *(p[0] for p in parts), *(p[3] for p in parts), *piece.shape, piece.ravel()

    return _joined(each_row(bricks.select("task_id", *SIZES, "side", *PLACE, "brick"), run, _typed(bricks, _PIECE)), low, high, "halo")


def cut(bricks: DataFrame, corners: DataFrame, p: int) -> DataFrame:
    """Periodic p^3 patches at ``corners`` (task_id, ox, oy, oz and any other columns), cut from the brick that holds the corner and its halo.

    A brick's corners come to it in lists of some ``TOGETHER``, dealt by a hash, so very many in one brick are many rows.
    """
    names = [c for c in corners.columns if c != "task_id"]
    (side,) = bricks.select("side").first() or (1,)
    keyed = corners.withColumns({f"b{a}": F.floor(F.col(f"o{a}") / side).cast("int") for a in "xyz"})
    lists = keyed.groupBy("task_id", *PLACE).agg((F.floor(F.count("*") / TOGETHER) + 1).alias("lists"))
    dealt = keyed.join(lists, ["task_id", *PLACE]).withColumn("part", F.pmod(F.xxhash64(*names), "lists")).groupBy("task_id", *PLACE, "part").agg(F.collect_list(F.struct(*names)).alias("asked"))
    rows = with_halo(bricks, 0, p - 1).join(dealt, ["task_id", *PLACE]).select("task_id", *SIZES, "side", *PLACE, "halo", "asked")

    def run(task_id: object, nx: int, ny: int, nz: int, side: int, bx: int, by: int, bz: int, halo: np.ndarray, asked: list[dict]) -> Iterator[tuple]:
        cells = np.reshape(halo, tuple(s + p - 1 for s in sides((nx, ny, nz), side, (bx, by, bz))))
        for want in asked:
            at = [want[f"o{a}"] - side * b for a, b in zip("xyz", (bx, by, bz), strict=True)]
            yield task_id, nx, ny, nz, *(want[c] for c in names), cells[tuple(slice(x, x + p) for x in at)].ravel()

    schema = StructType([*_typed(bricks, "nx int, ny int, nz int").fields, *(corners.schema[c] for c in names), *StructType.fromDDL("patch array<double>").fields])
    return each_row(rows, run, schema)


def tiled(bricks: DataFrame, p: int) -> DataFrame:
    """Full coverage by patches (columns of ``patches.tiles``, and ``patch``)."""
    sizes = bricks.select("task_id", *SIZES).distinct()
    return cut(bricks, P.tiles(sizes, p).drop(*SIZES), p)


def stitched(tiles: DataFrame, p: int, side: int) -> DataFrame:
    """Bricks of the tiles' own cells (from sx, sy, sz on in each patch): a tile gives a piece to each brick that it meets."""

    def run(task_id: object, nx: int, ny: int, nz: int, ox: int, oy: int, oz: int, sx: int, sy: int, sz: int, patch: np.ndarray) -> Iterator[tuple]:
        o, s, cells = (ox, oy, oz), (sx, sy, sz), np.reshape(patch, (p, p, p))
        spans = [[(b, max(a + q, side * b), min(a + p, side * (b + 1))) for b in range((a + q) // side, (a + p - 1) // side + 1)] for a, q in zip(o, s, strict=True)]
        for parts in itertools.product(*spans):
            piece = cells[tuple(slice(a - at, z - at) for (_, a, z), at in zip(parts, o, strict=True))]
            yield task_id, nx, ny, nz, side, *(b for b, _, _ in parts), *(a - side * b for b, a, _ in parts), *piece.shape, piece.ravel()

    ordered = tiles.select("task_id", *SIZES, "ox", "oy", "oz", "sx", "sy", "sz", "patch")
    return _joined(each_row(ordered, run, _typed(tiles, _PIECE)), 0, 0, "brick")


def _rescaled(bricks: DataFrame, change: Callable[[np.ndarray, tuple[int, ...], int], np.ndarray], size: Callable[[int], int]) -> DataFrame:
    def run(task_id: object, nx: int, ny: int, nz: int, side: int, bx: int, by: int, bz: int, brick: np.ndarray) -> Iterator[tuple]:
        n, b = (nx, ny, nz), (bx, by, bz)
        yield task_id, *(size(x) for x in n), size(side), *b, change(np.reshape(brick, sides(n, side, b)), n, side).ravel()

    return each_row(bricks.select("task_id", *SIZES, "side", *PLACE, "brick"), run, _typed(bricks, f"{_PLACED}, brick array<double>"))


def pool(bricks: DataFrame, factor: int) -> DataFrame:
    """Means over blocks of factor^3, brick by brick, without a shuffle; the factor must divide the grid's sides and the bricks'."""

    def change(cells: np.ndarray, n: tuple[int, ...], side: int) -> np.ndarray:
        if any(x % factor for x in (*n, side)):
            raise ValueError("the factor must divide the sides of grid and bricks")
        x, y, z = (s // factor for s in cells.shape)
        return cells.reshape(x, factor, y, factor, z, factor).mean((1, 3, 5))

    return _rescaled(bricks, change, lambda s: s // factor)


def upsample(bricks: DataFrame, factor: int) -> DataFrame:
    """Every cell as factor^3 equal ones."""

    def change(cells: np.ndarray, n: tuple[int, ...], side: int) -> np.ndarray:
        for axis in range(3):
            cells = np.repeat(cells, factor, axis)
        return cells

    return _rescaled(bricks, change, lambda s: s * factor)


def relative_error(bricks: DataFrame, approx: DataFrame) -> DataFrame:
    """(task_id, nmae): the sum of differences over the sum of magnitudes, summed brick by brick before the shuffle."""
    other = approx.select("task_id", *PLACE, F.col("brick").alias("approx"))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + F.abs(x))
    sums = bricks.join(other, ["task_id", *PLACE]).select("task_id", total(F.zip_with("brick", "approx", lambda a, b: a - b)).alias("off"), total("brick").alias("mass"))
    return sums.groupBy("task_id").agg(F.try_divide(F.sum("off"), F.sum("mass")).alias("nmae"))
