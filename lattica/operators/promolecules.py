"""Sums of atomic densities on a grid, in cells of any shape.

An atom's density is a function of its distance and charge: a Column for voxel tables, an array
function for packed grids. The occupied shells of an element are a small table: the filling rule, and
the elements known to depart from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lattica.operators.grids import minimum_image

# The Bohr radius in angstrom, and Slater's effective principal quantum numbers.
BOHR = 0.5291772109
EFFECTIVE_N = {1: 1.0, 2: 2.0, 3: 3.0, 4: 3.7, 5: 4.0, 6: 4.2, 7: 4.3}
# Elements whose ground state departs from the filling rule, as (z, from shell, to shell, electrons).
MOVED = [
    (24, "4s", "3d", 1), (29, "4s", "3d", 1), (41, "5s", "4d", 1), (42, "5s", "4d", 1), (44, "5s", "4d", 1), (45, "5s", "4d", 1), (46, "5s", "4d", 2), (47, "5s", "4d", 1),
    (57, "4f", "5d", 1), (58, "4f", "5d", 1), (64, "4f", "5d", 1), (78, "6s", "5d", 1), (79, "6s", "5d", 1),
    (89, "5f", "6d", 1), (90, "5f", "6d", 2), (91, "5f", "6d", 1), (92, "5f", "6d", 1), (93, "5f", "6d", 1), (96, "5f", "6d", 1), (103, "6d", "7p", 1),
]


def shells(spark: SparkSession, heaviest: int = 118) -> DataFrame:
    """(z, n, l, electrons) of the occupied shells of each element: filled in order of n + l, then n, but for the elements in ``MOVED``; at most 19 rows an element."""
    order = sorted((n + l, n, l) for n in range(1, 9) for l in range(min(n, 4)))
    before, rows = 0, []
    for _, n, l in order:
        rows.append((n, l, 4 * l + 2, before))
        before += 4 * l + 2
    kinds = spark.createDataFrame(rows, "n int, l int, room int, before int")
    elements = spark.range(1, heaviest + 1).select(F.col("id").cast("int").alias("z"))
    both = elements.crossJoin(F.broadcast(kinds))  # broadcast: 26 kinds of shell
    ruled = both.select("z", "n", "l", F.least("room", F.col("z") - F.col("before")).alias("electrons")).where("electrons > 0")
    shell = lambda name: (int(name[0]), "spdf".index(name[1]))
    moves = [row for z, source, target, e in MOVED if z <= heaviest for row in ((z, *shell(source), -e), (z, *shell(target), e))]
    known = ruled.union(spark.createDataFrame(moves, "z int, n int, l int, electrons int")) if moves else ruled
    return known.groupBy("z", "n", "l").agg(F.sum("electrons").cast("int").alias("electrons")).where("electrons > 0")


def screened(table: DataFrame) -> DataFrame:
    """Add ``z_eff``, the charge that an electron of each shell sees by Slater's rules, and ``alpha`` = z_eff / (n* a0)."""
    other = table.select("z", F.col("n").alias("m"), F.col("l").alias("k"), F.col("electrons").alias("e"))
    n, l, m, k, e = (F.col(c) for c in ("n", "l", "m", "k", "e"))
    outer = l < 2
    group = (m == n) & F.when(outer, k < 2).otherwise(k == l)
    inside = F.when(n == 1, 0.30).otherwise(0.35) * (e - F.when(k == l, 1).otherwise(0))
    for_outer = F.when(m == n - 1, 0.85 * e).when(m < n, 1.0 * e).when((m == n) & (k > 1), 1.0 * e).otherwise(0.0)
    for_inner = F.when((m < n) | ((m == n) & (k < l)), 1.0 * e).otherwise(0.0)
    screen = F.when(m > n, 0.0).when(group, inside).when(outer, for_outer).otherwise(for_inner)
    star = F.element_at(F.create_map(*[F.lit(x) for p in EFFECTIVE_N.items() for x in p]), n)
    sums = table.join(other, "z").groupBy("z", "n", "l", "electrons").agg(F.sum(screen).alias("_s"))
    return sums.withColumn("z_eff", F.col("z") - F.col("_s")).withColumn("alpha", F.col("z_eff") / (F.coalesce(star, F.col("n").cast("double")) * BOHR)).drop("_s")


#: Bytes of a batch of grids whose atoms and sums a task holds as Python objects at a time; a larger grid stands alone.
SLICE = 1 << 20


class Model(Protocol):
    """An atomic density: ``prepare`` may add columns (or rows) to the atoms, ``density`` is the value at distance r of an atom of these columns, ``sample`` the same for an array of distances."""

    def prepare(self, atoms: DataFrame) -> DataFrame: ...

    def density(self, r: Column) -> Column: ...

    def sample(self, r: np.ndarray, atom: Mapping[str, float]) -> np.ndarray: ...


@dataclass(frozen=True)
class Gaussian:
    """One Gaussian per atom, of the atom's charge."""

    sigma: float = 0.4

    def prepare(self, atoms: DataFrame) -> DataFrame:
        return atoms

    def density(self, r: Column) -> Column:
        return F.col("z") * (2 * math.pi * self.sigma**2) ** -1.5 * F.exp(-(r * r) / (2 * self.sigma**2))

    def sample(self, r: np.ndarray, atom: Mapping[str, float]) -> np.ndarray:
        return atom["z"] * (2 * math.pi * self.sigma**2) ** -1.5 * np.exp(-(r * r) / (2 * self.sigma**2))


@dataclass(frozen=True)
class Slater:
    """Up to two core electrons in an exponential, the others in a Gaussian."""

    sigma: float = 0.5

    def prepare(self, atoms: DataFrame) -> DataFrame:
        return atoms

    def density(self, r: Column) -> Column:
        z = F.col("z").cast("double")
        a = 2.0 * F.when(z == 1, 1.0).otherwise(z - 0.30) / BOHR
        core = F.least(z, F.lit(2.0)) * F.pow(a, F.lit(3)) / (8 * math.pi) * F.exp(-a * r)
        return core + F.greatest(z - 2, F.lit(0.0)) * (2 * math.pi * self.sigma**2) ** -1.5 * F.exp(-(r * r) / (2 * self.sigma**2))

    def sample(self, r: np.ndarray, atom: Mapping[str, float]) -> np.ndarray:
        z = float(atom["z"])
        a = 2.0 * (1.0 if z == 1 else z - 0.30) / BOHR
        core = min(z, 2.0) * a**3 / (8 * math.pi) * np.exp(-a * r)
        return core + max(z - 2, 0.0) * (2 * math.pi * self.sigma**2) ** -1.5 * np.exp(-(r * r) / (2 * self.sigma**2))


@dataclass(frozen=True)
class MultiShell:
    """Slater-type densities of all occupied shells, or with ``valence_only`` of those of the largest n."""

    valence_only: bool = True

    def prepare(self, atoms: DataFrame) -> DataFrame:
        table = screened(shells(atoms.sparkSession))
        if self.valence_only:
            table = table.withColumn("_top", F.max("n").over(Window.partitionBy("z"))).where("n = _top").drop("_top")
        return atoms.join(F.broadcast(table), "z")  # broadcast: some thousand rows, from a rule

    def density(self, r: Column) -> Column:
        n, a = F.col("n"), F.col("alpha")
        norm = F.col("electrons") * F.pow(2 * a, 2 * n + 1) / (F.factorial(2 * n) * 4 * math.pi)
        return norm * F.pow(r, 2 * n - 2) * F.exp(-2 * a * r)

    def sample(self, r: np.ndarray, atom: Mapping[str, float]) -> np.ndarray:
        n, a = int(atom["n"]), atom["alpha"]
        norm = atom["electrons"] * (2 * a) ** (2 * n + 1) / (math.factorial(2 * n) * 4 * math.pi)
        return norm * r ** (2 * n - 2) * np.exp(-2 * a * r)


def distance(frac: list[Column], at: list[Column], cell: Column) -> Column:
    """Distance to the nearest image of a point, by fractional differences brought to [-1/2, 1/2]; the rows of ``cell`` are the lattice vectors."""
    d = [minimum_image(f - a) for f, a in zip(frac, at, strict=True)]
    cart = [sum((d[i] * F.get(F.get(cell, F.lit(i)), F.lit(j)) for i in range(3)), F.lit(0.0)) for j in range(3)]
    return F.sqrt(sum((c * c for c in cart), F.lit(0.0)))


def baseline(voxels: DataFrame, atoms: DataFrame, cells: DataFrame, model: Model) -> DataFrame:
    """(task_id, flat, rho, baseline) at each voxel.

    ``atoms``: (task_id, z, fx, fy, fz); ``cells``: (task_id, nx, ny, nz, cell), cell an array of three
    lattice vectors. All joins are on the grid's id, and the sums form before the shuffle.
    """
    placed = model.prepare(atoms).join(cells, "task_id")
    both = voxels.join(placed, "task_id")
    frac = [F.col(f"i{a}") / F.col(f"n{a}") for a in "xyz"]
    r = distance(frac, [F.col(f"f{a}") for a in "xyz"], F.col("cell"))
    return both.withColumn("_r", r).groupBy("task_id", "flat", "rho").agg(F.sum(model.density(F.col("_r"))).alias("baseline"))


def packed_baseline(grids: DataFrame, atoms: DataFrame, model: Model) -> DataFrame:
    """Packed grids (task_id, nx, ny, nz, cell, …) with ``baseline``, an array in the grid's order, summed grid by grid in array functions.

    Only the atoms are shuffled; a grid's atoms are one list beside it, and grids are dealt anew by
    size, so that one small file is not one task. Grids without atoms have a baseline of zeros.
    """
    ready = model.prepare(atoms)
    own = [c for c in ready.columns if c != "task_id"]
    lists = ready.groupBy("task_id").agg(F.collect_list(F.struct(*own)).alias("_atoms"))
    rows = grids.join(lists, "task_id", "left").hint("rebalance")

    kept = grids.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = max(1, b.nbytes // max(1, b.num_rows))
            step = max(1, SLICE // wide)
            for i in range(0, b.num_rows, step):  # what becomes Python objects at a time
                part = b.slice(i, step)
                found = []
                for nx, ny, nz, cell, held in zip(*(part.column(c).to_pylist() for c in ("nx", "ny", "nz", "cell", "_atoms")), strict=True):
                    total, apart = np.zeros((nx, ny, nz)), {}
                    for atom in held or ():
                        at = (atom["fx"], atom["fy"], atom["fz"])
                        if at not in apart:  # the shells of an atom share their distances
                            apart = {at: distances((nx, ny, nz), at, np.array(cell))}
                        total += model.sample(apart[at], atom)
                    found.append(total.ravel())
                sums = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), sums], names=[*kept, "baseline"])

    return rows.mapInArrow(run, StructType([*grids.schema.fields, StructField("baseline", ArrayType(DoubleType()))]))


def distances(shape: tuple[int, int, int], at: tuple[float, float, float], cell: np.ndarray) -> np.ndarray:
    """Of every point of a grid to the nearest image of a point."""
    apart = [np.arange(n) / n - a for n, a in zip(shape, at, strict=True)]
    x, y, z = (d - np.rint(d) for d in apart)
    squares = sum((x[:, None, None] * cell[0, j] + y[:, None] * cell[1, j] + z * cell[2, j]) ** 2 for j in range(3))
    return np.sqrt(squares)


def cube(edge: float) -> Column:
    """A cubic cell."""
    return F.array(*[F.array(*[F.lit(edge if i == j else 0.0) for j in range(3)]) for i in range(3)])


def volume(cell: Column) -> Column:
    """Volume of a cell: the magnitude of its determinant."""
    at = lambda i, j: F.get(F.get(cell, F.lit(i)), F.lit(j))
    return F.abs(at(0, 0) * (at(1, 1) * at(2, 2) - at(1, 2) * at(2, 1)) - at(0, 1) * (at(1, 0) * at(2, 2) - at(1, 2) * at(2, 0)) + at(0, 2) * (at(1, 0) * at(2, 1) - at(1, 1) * at(2, 0)))
