"""Grids: packed arrays and voxel tables, pooling, top-k cutoff, low-frequency transforms, error metrics.

A packed grid is a row (task_id, nx, ny, nz, density array<double>) in x-major order; a voxel table
has a row (task_id, flat, ix, iy, iz, rho) for each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpack(grids: DataFrame) -> DataFrame:
    """Packed grids to voxels, without a shuffle."""
    v = grids.select("task_id", "nx", "ny", "nz", F.posexplode("density").alias("flat", "rho"))
    flat = F.col("flat")
    return v.select("task_id", flat.cast("long").alias("flat"), F.floor(flat / (F.col("ny") * F.col("nz"))).alias("ix"), F.pmod(F.floor(flat / F.col("nz")), F.col("ny")).alias("iy"), F.pmod(flat, F.col("nz")).cast("long").alias("iz"), F.col("rho").cast("double").alias("rho"))


def pack(voxels: DataFrame) -> DataFrame:
    """Voxels to (task_id, density), ordered by flat index; one grid is one row of memory."""
    rows = voxels.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("flat", "rho"))).alias("v"))
    return rows.select("task_id", F.transform("v", lambda x: x["rho"]).alias("density"))


def stats(grids: DataFrame) -> DataFrame:
    """Smallest, largest, range, sum and sum of magnitudes of each grid, inside its row."""
    d = F.col("density")
    total = lambda f: F.aggregate(d, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return grids.select("task_id", F.size(d).cast("long").alias("n_voxels"), F.array_min(d).cast("double").alias("low"), F.array_max(d).cast("double").alias("high"), (F.array_max(d).cast("double") - F.array_min(d).cast("double")).alias("spread"), total(lambda x: x).alias("total"), total(F.abs).alias("mass"))


def avg_pool(voxels: DataFrame, factor: int) -> DataFrame:
    """Means over blocks of factor^3; the grid's sides must be divisible. Partial sums form before the shuffle."""
    if factor < 1:
        raise ValueError("factor must be positive")
    cell = [F.floor(F.col(c) / factor).alias(c) for c in ("ix", "iy", "iz")]
    return voxels.groupBy("task_id", *cell).agg(F.avg("rho").alias("rho"))


def upsample(pooled: DataFrame, voxels: DataFrame, factor: int) -> DataFrame:
    """Each voxel with its block's mean: (task_id, flat, rho, approx)."""
    keyed = voxels.withColumns({f"b{a}": F.floor(F.col(f"i{a}") / factor) for a in "xyz"})
    blocks = pooled.select("task_id", *[F.col(f"i{a}").alias(f"b{a}") for a in "xyz"], F.col("rho").alias("approx"))
    return keyed.join(blocks, ["task_id", "bx", "by", "bz"]).select("task_id", "flat", "rho", "approx")


def kept_count(n: Column | int, fraction: float) -> Column:
    """max(1, min(n, round-half-even(n * fraction)))."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.lit(1).cast("long"), F.least(n.cast("long"), F.rint(n * F.lit(fraction)).cast("long")))


def cutoff(voxels: DataFrame, *, k: int | None = None, fraction: float | None = None, threshold: float | None = None, by_abs: bool = False) -> DataFrame:
    """Mark the voxels that a cutoff keeps (``kept``) and give ``approx``, zero elsewhere.

    Exactly one of ``k``, ``fraction`` and ``threshold``. The largest signed values are kept, or the
    largest magnitudes with ``by_abs``; ties go to the smaller flat index.
    """
    if sum(x is not None for x in (k, fraction, threshold)) != 1:
        raise ValueError("give exactly one of k, fraction and threshold")
    if (k is not None and k < 1) or (fraction is not None and not 0 < fraction <= 1):
        raise ValueError("k must be positive, fraction in (0, 1]")
    rank_by = F.abs("rho") if by_abs else F.col("rho")
    if threshold is not None:
        kept = rank_by >= threshold
    else:
        grid = Window.partitionBy("task_id")
        most = F.lit(k) if k is not None else kept_count(F.count("*").over(grid), fraction)
        kept = F.row_number().over(grid.orderBy(rank_by.desc(), "flat")) <= most
    return voxels.withColumn("kept", kept).withColumn("approx", F.when(F.col("kept"), F.col("rho")).otherwise(0.0))


def mass_captured(marked: DataFrame) -> DataFrame:
    """Share of |rho| that the kept voxels hold, their number, and the smallest kept value."""
    kept = F.when(F.col("kept"), F.col("rho"))
    return marked.groupBy("task_id").agg(F.try_divide(F.sum(F.abs(kept)), F.sum(F.abs("rho"))).alias("mass_captured"), F.count(kept).alias("n_kept"), F.min(kept).alias("effective_threshold"))


def error_metrics(pairs: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """nmae, chi_sq, hellinger, weighted_mae and jsd of (rho, approx) by ``keys``.

    Two aggregations: sums and the maximum first, which then set the floor and the normalisation of the
    terms. nmae compares signed values, the others magnitudes. A grid without mass gives nulls (jsd 0),
    or an error with ``strict``.
    """
    p, q = F.abs("rho"), F.abs("approx")
    whole = pairs.groupBy(*keys).agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"), F.greatest(F.max(p) * 1e-8, F.lit(1e-12)).alias("_eps"))
    rows = pairs.join(whole, keys)
    if strict:
        rows = rows.withColumn("_p", F.when(F.col("_p") == 0, F.raise_error(F.lit("the reference grid sums to zero"))).otherwise(F.col("_p")))
    floor = F.greatest(p, F.col("_eps"))
    u, v = F.try_divide(p, "_p"), F.try_divide(q, "_q")
    mid = (u + v) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / mid)).otherwise(0.0)
    out = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.abs(F.col("rho") - F.col("approx"))), F.first("_p")).alias("nmae"),
        F.try_divide(F.sum(F.pow(p - q, F.lit(2)) / floor), F.first("_p")).alias("chi_sq"),
        F.try_divide(F.sqrt(F.sum(F.pow(F.sqrt(p) - F.sqrt(q), F.lit(2))) * 0.5), F.sqrt(F.first("_p"))).alias("hellinger"),
        F.avg(F.abs(p - q) / floor).alias("weighted_mae"),
        F.coalesce(F.greatest(F.lit(0.0), (F.sum(term(u)) + F.sum(term(v))) / 2), F.lit(0.0)).alias("jsd"),
    )
    return out


def packed_metrics(grids: DataFrame, density: str = "density", approx: str = "approx") -> DataFrame:
    """Add the metrics of ``error_metrics`` to packed grids, each inside its row: no shuffle. Null without mass (jsd 0)."""
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    pairs = lambda f: add(F.zip_with(density, approx, f))
    size = lambda c: F.transform(c, F.abs)
    rows = grids.withColumns({"_p": add(size(density)), "_q": add(size(approx)), "_eps": F.greatest(F.array_max(size(density)) * 1e-8, F.lit(1e-12))})
    over = lambda p: F.greatest(F.abs(p), F.col("_eps"))
    term = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    def divergence(p: Column, q: Column) -> Column:
        u, v = F.try_divide(F.abs(p), "_p"), F.try_divide(F.abs(q), "_q")
        return term(u, (u + v) / 2) + term(v, (u + v) / 2)

    metrics = {
        "nmae": F.try_divide(pairs(lambda p, q: F.abs(p - q)), "_p"),
        "chi_sq": F.try_divide(pairs(lambda p, q: F.pow(F.abs(p) - F.abs(q), F.lit(2)) / over(p)), "_p"),
        "hellinger": F.try_divide(F.sqrt(pairs(lambda p, q: F.pow(F.sqrt(F.abs(p)) - F.sqrt(F.abs(q)), F.lit(2))) * 0.5), F.sqrt("_p")),
        "weighted_mae": F.try_divide(pairs(lambda p, q: F.abs(F.abs(p) - F.abs(q)) / over(p)), F.size(density)),
        "jsd": F.coalesce(F.greatest(F.lit(0.0), pairs(divergence) / 2), F.lit(0.0)),
    }
    return rows.withColumns(metrics).drop("_p", "_q", "_eps")


def dft(voxels: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Discrete Fourier transform of small grids in DataFrame functions: (task_id, kx, ky, kz, g2, re, im).

    The half spectrum over the last axis, as of real input. One row for each voxel and frequency, summed
    before the shuffle; for large grids use ``fourier``.
    """
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = voxels.select("*", F.explode(axis(nx)).alias("kx")).select("*", F.explode(axis(ny)).alias("ky")).select("*", F.explode(axis(nz // 2 + 1)).alias("kz"))
    phase = 2 * math.pi * (F.col("kx") * F.col("ix") / nx + F.col("ky") * F.col("iy") / ny + F.col("kz") * F.col("iz") / nz)
    wrap = lambda c, n: F.when(F.col(c) > n // 2, F.col(c) - n).otherwise(F.col(c)) if n > 1 else F.lit(0)
    g2 = (F.pow(wrap("kx", nx), F.lit(2)) + F.pow(wrap("ky", ny), F.lit(2)) + F.pow(F.col("kz"), F.lit(2))).cast("long")
    return rows.groupBy("task_id", "kx", "ky", "kz").agg(F.sum(F.col("rho") * F.cos(phase)).alias("re"), (-F.sum(F.col("rho") * F.sin(phase))).alias("im")).withColumn("g2", g2)


def lowest_frequencies(spectrum: DataFrame, k: int) -> DataFrame:
    """The k coefficients of smallest |G|^2 of each grid; ties by frequency index."""
    order = Window.partitionBy("task_id").orderBy("g2", "kx", "ky", "kz")
    return spectrum.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fourier(grids: DataFrame, fraction: float) -> DataFrame:
    """Low-pass every packed grid: (task_id, nx, ny, nz, density, approx, n_kept), a grid at a time in numpy.

    ``fraction`` of the half spectrum is kept, lowest |G|^2 first, in complex64.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            approx, kept = [], []
            for nx, ny, nz, d in zip(f.nx, f.ny, f.nz, f.density, strict=True):
                spectrum = np.fft.rfftn(np.asarray(d, float).reshape(nx, ny, nz))
                g = [np.fft.fftfreq(nx, 1 / nx)[:, None, None], np.fft.fftfreq(ny, 1 / ny)[None, :, None], np.arange(nz // 2 + 1)[None, None]]
                order = np.argsort((g[0] ** 2 + g[1] ** 2 + g[2] ** 2).ravel(), kind="stable")
                k = max(1, min(len(order), round(len(order) * fraction)))
                low = np.zeros(spectrum.size, np.complex64)
                low[order[:k]] = spectrum.ravel()[order[:k]]
                approx.append(np.fft.irfftn(low.reshape(spectrum.shape), s=(nx, ny, nz), axes=(0, 1, 2)).ravel())
                kept.append(k)
            yield f.assign(approx=approx, n_kept=kept)

    return grids.select("task_id", "nx", "ny", "nz", "density").mapInPandas(run, "task_id long, nx int, ny int, nz int, density array<double>, approx array<double>, n_kept int")


def minimum_image(d: Column) -> Column:
    """A fractional difference brought to [-1/2, 1/2]."""
    return d - F.rint(d)
