"""Encodings of packed grids that compose: each takes (task_id, nx, ny, nz, density) and gives it back approximately.

``encode`` adds a column ``code`` and drops ``density``; ``decode`` turns ``code`` into ``density`` again.
Wrappers change the grid, hand it to the encoding inside, and undo the change.  There is no shuffle;
the Fourier transform and the decoding of a cutoff are array functions on batches of grids, all else is
expressions inside a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lattica.functions.quantize import LogCodec
from lattica.operators.grids import kept_count


#: Voxels that a decoding task puts into one batch, or one grid's if that has more.
VOXELS = 1 << 21


class Transform(Protocol):
    name: str

    def encode(self, grids: DataFrame) -> DataFrame: ...

    def decode(self, encoded: DataFrame) -> DataFrame: ...

    def tokens(self, encoded: DataFrame) -> Column: ...


def round_trip(transform: Transform, grids: DataFrame) -> DataFrame:
    """The grids with ``approx`` and ``tokens`` beside their own density."""
    own = grids.withColumn("original", F.col("density"))
    encoded = transform.encode(own)
    counted = encoded.withColumn("tokens", transform.tokens(encoded).cast("long"))
    return transform.decode(counted).withColumnRenamed("density", "approx").withColumnRenamed("original", "density")


def relative_error(grids: DataFrame) -> Column:
    """Sum of |density - approx| over the sum of |density|, inside the row."""
    off = F.aggregate(F.zip_with("density", "approx", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(off, F.aggregate("density", F.lit(0.0), lambda s, x: s + F.abs(x)))


def _size() -> Column:
    return F.col("nx") * F.col("ny") * F.col("nz")


@dataclass(frozen=True)
class Direct:
    """The grid itself, in single precision."""

    name: str = "direct"
    per_value: int = 3

    def encode(self, grids: DataFrame) -> DataFrame:
        return grids.withColumn("code", F.col("density").cast("array<float>")).drop("density")

    def decode(self, encoded: DataFrame) -> DataFrame:
        return encoded.withColumn("density", F.col("code").cast("array<double>")).drop("code")

    def tokens(self, encoded: DataFrame) -> Column:
        return _size() * self.per_value


@dataclass(frozen=True)
class Coded:
    """Every value as the chunks of a quantizer."""

    codec: LogCodec
    name: str = "direct-coded"

    def encode(self, grids: DataFrame) -> DataFrame:
        return grids.withColumn("code", F.transform("density", lambda x: F.array(*self.codec.encode(x)))).drop("density")

    def decode(self, encoded: DataFrame) -> DataFrame:
        chunks = lambda c: [F.get(c, F.lit(i)) for i in range(len(self.codec.bits))]
        return encoded.withColumn("density", F.transform("code", lambda c: self.codec.decode(chunks(c)))).drop("code")

    def tokens(self, encoded: DataFrame) -> Column:
        return _size() * len(self.codec.bits)


@dataclass(frozen=True)
class Cutoff:
    """The largest values of a grid, with their places; all others are zero."""

    fraction: float
    name: str = "cutoff-top"
    per_value: int = 3

    def encode(self, grids: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.transform("density", lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
        return grids.withColumn("code", F.slice(ranked, 1, kept_count(_size(), self.fraction).cast("int"))).drop("density")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """The kept values put in their places, one array operation a grid."""
        names = [*(c for c in encoded.columns if c != "code"), "density"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                sizes = np.prod([whole.column(f"n{a}").to_numpy().astype(np.int64) for a in "xyz"], axis=0)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // VOXELS, prepend=-1))  # slices of some VOXELS
                for first, last in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                    b, starts = whole.slice(first, last - first), np.cumsum([0, *sizes[first:last]])
                    code = b.column("code")
                    entries = code.flatten()
                    counts = pc.fill_null(pc.list_value_length(code), 0).to_numpy()
                    out = np.zeros(starts[-1])
                    out[entries.field("i").to_numpy() + np.repeat(starts[:-1], counts)] = -entries.field("v").to_numpy()
                    density = pa.ListArray.from_arrays(starts.astype(np.int32), out)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), density], names=names)

        fields = [encoded.schema[c] for c in names[:-1]]
        return encoded.mapInArrow(run, StructType([*fields, StructField("density", ArrayType(DoubleType()))]))

    def tokens(self, encoded: DataFrame) -> Column:
        return F.size("code") * (self.per_value + 3)


@dataclass(frozen=True)
class Fourier:
    """The coefficients of lowest frequency of the half spectrum, in single precision or as chunks of a quantizer."""

    fraction: float
    codec: LogCodec | None = None
    name: str = "fourier"
    per_value: int = 3

    def encode(self, grids: DataFrame) -> DataFrame:
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction must be in (0, 1]")
        fraction = self.fraction

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                code = []
                for nx, ny, nz, d in zip(f.nx, f.ny, f.nz, f.density, strict=True):
                    spectrum = np.fft.rfftn(np.asarray(d, float).reshape(nx, ny, nz)).astype(np.complex64).ravel()
                    kx, ky, kz = np.meshgrid(np.fft.fftfreq(nx, 1 / nx), np.fft.fftfreq(ny, 1 / ny), np.arange(nz // 2 + 1), indexing="ij")
                    order = np.argsort((kx**2 + ky**2 + kz**2).ravel(), kind="stable")
                    at = order[: max(1, min(len(order), round(len(order) * fraction)))]
                    code.append([{"at": int(i), "re": float(c.real), "im": float(c.imag)} for i, c in zip(at, spectrum[at], strict=True)])
                yield f.drop(columns="density").assign(code=code)

        rest = [f"`{n}` {t}" for n, t in grids.dtypes if n != "density"]
        out = grids.select(*[n for n, _ in grids.dtypes if n != "density"], "density").mapInPandas(run, ", ".join([*rest, "code array<struct<at:int,re:double,im:double>>"]))
        if self.codec is None:
            return out
        return out.withColumn("code", F.transform("code", lambda c: F.struct(c["at"].alias("at"), F.array(*self.codec.encode(c["re"])).alias("re"), F.array(*self.codec.encode(c["im"])).alias("im"))))

    def decode(self, encoded: DataFrame) -> DataFrame:
        if self.codec is not None:
            value = lambda c: self.codec.decode([F.get(c, F.lit(i)) for i in range(len(self.codec.bits))])
            encoded = encoded.withColumn("code", F.transform("code", lambda c: F.struct(c["at"].alias("at"), value(c["re"]).alias("re"), value(c["im"]).alias("im"))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for nx, ny, nz, code in zip(f.nx, f.ny, f.nz, f.code, strict=True):
                    flat = np.zeros(nx * ny * (nz // 2 + 1), complex)
                    for c in code:
                        flat[c["at"]] = complex(c["re"], c["im"])
                    out.append(np.fft.irfftn(flat.reshape(nx, ny, -1), s=(nx, ny, nz), axes=(0, 1, 2)).ravel())
                yield f.drop(columns="code").assign(density=out)

        rest = [f"`{n}` {t}" for n, t in encoded.dtypes if n != "code"]
        return encoded.select(*[n for n, _ in encoded.dtypes if n != "code"], "code").mapInPandas(run, ", ".join([*rest, "density array<double>"]))

    def tokens(self, encoded: DataFrame) -> Column:
        chunks = len(self.codec.bits) if self.codec else self.per_value
        return F.size("code") * (2 * chunks + 3)


@dataclass(frozen=True)
class Pooled:
    """Another encoding of the grid averaged over blocks of factor^3; sides that the factor does not divide are an error."""

    inner: Transform
    factor: int

    def __post_init__(self):
        if self.factor < 1:
            raise ValueError("factor must be positive")

    @property
    def name(self) -> str:
        return f"down{self.factor}-{self.inner.name}"

    def encode(self, grids: DataFrame) -> DataFrame:
        f = self.factor
        sides = [F.col(f"n{a}") for a in "xyz"]
        whole = (sides[0] % f == 0) & (sides[1] % f == 0) & (sides[2] % f == 0)
        cx, cy, cz = (F.floor(s / f).cast("int") for s in sides)
        cell = lambda c, dx, dy, dz: F.get("density", (((F.floor(c / (cy * cz)) * f + dx) * sides[1] + F.floor(c / cz) % cy * f + dy) * sides[2] + c % cz * f + dz).cast("int"))
        mean = lambda c: sum((cell(c, x, y, z) for x in range(f) for y in range(f) for z in range(f)), F.lit(0.0)) / f**3
        pooled = F.transform(F.sequence(F.lit(0), cx * cy * cz - 1), mean)
        coarse = grids.withColumn("density", F.when(whole, pooled).otherwise(F.raise_error(F.lit("a side is not divisible by the factor"))))
        coarse = coarse.withColumn("_full", F.struct(*[F.col(f"n{a}").alias(a) for a in "xyz"])).withColumns({"nx": cx, "ny": cy, "nz": cz})
        return self.inner.encode(coarse)

    def decode(self, encoded: DataFrame) -> DataFrame:
        f, back = self.factor, self.inner.decode(encoded)
        x, y, z = (F.col(f"_full.{a}") for a in "xyz")
        at = lambda i: ((F.floor(i / (y * z) / f) * F.col("ny") + F.floor(F.floor(i / z) % y / f)) * F.col("nz") + F.floor(i % z / f)).cast("int")
        fine = F.transform(F.sequence(F.lit(0), (x * y * z).cast("int") - 1), lambda i: F.get("density", at(i)))
        return back.withColumn("density", fine).withColumns({f"n{a}": F.col(f"_full.{a}") for a in "xyz"}).drop("_full")

    def tokens(self, encoded: DataFrame) -> Column:
        return self.inner.tokens(encoded)


@dataclass(frozen=True)
class Delta:
    """Another encoding of what is left of the grid after a baseline (column ``baseline``, an array as the density)."""

    inner: Transform
    atoms: int = 0

    @property
    def name(self) -> str:
        return f"delta-{self.inner.name}"

    def encode(self, grids: DataFrame) -> DataFrame:
        return self.inner.encode(grids.withColumn("density", F.zip_with("density", "baseline", lambda a, b: a - b)))

    def decode(self, encoded: DataFrame) -> DataFrame:
        return self.inner.decode(encoded).withColumn("density", F.zip_with("density", "baseline", lambda a, b: a + b))

    def tokens(self, encoded: DataFrame) -> Column:
        return self.inner.tokens(encoded) + 10 * self.atoms
