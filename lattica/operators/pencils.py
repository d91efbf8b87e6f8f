"""Fourier transforms of grids in bricks: one axis at a time, with a shuffle between that turns bricks into pencils along the next axis.

A spectrum is rows (task_id, nx, ny, nz, side, bx, by, bz, re, im) of the half spectrum, nx * ny * (nz // 2 + 1)
coefficients in bricks of ``side``. A task holds one pencil: side^2 lines along one axis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.bricks import _PLACED, PLACE, SIZES, _typed, sides
from lattica.operators.grids import kept_count
from lattica.operators.grouped import Columns, by_group, each_row

_SPECTRUM = f"{_PLACED}, re array<double>, im array<double>"


def _along(rows: DataFrame, axis: int, change: Callable[[np.ndarray, int], np.ndarray], whole: Callable[[tuple[int, ...]], tuple[int, ...]]) -> DataFrame:
    """``change`` applied to the lines along an axis; ``whole`` gives the full shape of what comes in from that of the grid. A group is one pencil."""

    def run(c: Columns) -> Iterator[tuple]:
        n, side, b = tuple(c[x][0] for x in SIZES), c["side"][0], [c[x][0] for x in PLACE]
        shape = whole(n)
        mine = list(sides(shape, side, tuple(b)))
        mine[axis] = shape[axis]
        lines = np.empty(mine, complex)
        for place, re, im in zip(c[PLACE[axis]], c["re"], c["im"], strict=True):
            spot = [slice(None)] * 3
            spot[axis] = slice(side * place, side * (place + 1))
            part = lines[tuple(spot)]
            part[...] = np.reshape(re, part.shape) if im is None else np.reshape(re, part.shape) + 1j * np.reshape(im, part.shape)
        lines = change(lines, n[axis])
        for place in range(-(-lines.shape[axis] // side)):
            spot = [slice(None)] * 3
            spot[axis] = slice(side * place, side * (place + 1))
            part, b[axis] = lines[tuple(spot)], place
            yield c["task_id"][0], *n, side, *b, part.real.ravel(), part.imag.ravel()

    across = [c for i, c in enumerate(PLACE) if i != axis]
    return by_group(rows, ["task_id", *across], run, _typed(rows, _SPECTRUM))


def _half(n: tuple[int, ...]) -> tuple[int, ...]:
    return n[0], n[1], n[2] // 2 + 1


def spectrum(bricks: DataFrame) -> DataFrame:
    """The half spectrum of real grids in bricks."""
    rows = bricks.select("task_id", *SIZES, "side", *PLACE, F.col("brick").alias("re"), F.lit(None).cast("array<double>").alias("im"))
    rows = _along(rows, 2, lambda x, n: np.fft.rfft(x.real, axis=2), lambda n: n)
    rows = _along(rows, 1, lambda x, n: np.fft.fft(x, axis=1), _half)
    return _along(rows, 0, lambda x, n: np.fft.fft(x, axis=0), _half)


def inverse(spectra: DataFrame) -> DataFrame:
    """Bricks of the real grids of half spectra."""
    rows = _along(spectra, 0, lambda x, n: np.fft.ifft(x, axis=0), _half)
    rows = _along(rows, 1, lambda x, n: np.fft.ifft(x, axis=1), _half)
    rows = _along(rows, 2, lambda x, n: np.fft.irfft(x, n, axis=2), _half)
    return rows.select("task_id", *SIZES, "side", *PLACE, F.col("re").alias("brick"))


def _squares(n: tuple[int, ...], side: int, b: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """|G|^2 and the place in the whole half spectrum of a brick's coefficients."""
    at = [np.arange(side * i, min(side * (i + 1), size)) for i, size in zip(b, _half(n), strict=True)]
    kx, ky = (np.where(k > (size - 1) // 2, k - size, k) for k, size in zip(at[:2], n[:2], strict=True))
    g2 = (kx[:, None, None] ** 2 + ky[:, None] ** 2 + at[2] ** 2).astype(np.int64)
    flat = (at[0][:, None, None].astype(np.int64) * n[1] + at[1][:, None]) * _half(n)[2] + at[2]
    return g2, flat


def _limits(spectra: DataFrame, fraction: float) -> DataFrame:
    """(task_id, last_g2, last_flat): the last coefficient that is kept, in order of |G|^2 and then place.

    Counts of each |G|^2 give the shell where the limit falls; only that shell is ordered.
    """
    placed = spectra.select("task_id", *SIZES, "side", *PLACE)

    def shells(task_id: object, nx: int, ny: int, nz: int, side: int, *b: int) -> Iterator[tuple]:
        for g2, many in zip(*(x.tolist() for x in np.unique(_squares((nx, ny, nz), side, b)[0], return_counts=True)), strict=True):
            yield task_id, nx * ny * (nz // 2 + 1), g2, many

    counts = each_row(placed, shells, _typed(spectra, "size long, g2 long, many long")).groupBy("task_id", "size", "g2").agg(F.sum("many").alias("many"))
    run = counts.withColumn("upto", F.sum("many").over(Window.partitionBy("task_id").orderBy("g2"))).withColumn("kept", kept_count(F.col("size"), fraction))
    shell = run.where("upto >= kept and upto - many < kept").select("task_id", F.col("g2").alias("last_g2"), (F.col("kept") - F.col("upto") + F.col("many")).alias("room"))

    def members(task_id: object, nx: int, ny: int, nz: int, side: int, bx: int, by: int, bz: int, last: int, room: int) -> Iterator[tuple]:
        g2, flat = _squares((nx, ny, nz), side, (bx, by, bz))
        for at in flat[g2 == last].tolist():
            yield task_id, last, room, at

    tied = each_row(placed.join(shell, "task_id"), members, _typed(spectra, "last_g2 long, room long, flat long"))
    ranked = tied.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("flat")))
    return ranked.where("rank = room").select("task_id", "last_g2", F.col("flat").alias("last_flat"))


def lowest(spectra: DataFrame, fraction: float, single: bool = True) -> DataFrame:
    """Spectra with only the coefficients of lowest frequency, others zero; in single precision, as they are stored, unless ``single`` is off."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")

    def run(task_id: object, nx: int, ny: int, nz: int, side: int, bx: int, by: int, bz: int, re: np.ndarray, im: np.ndarray, last: int, end: int) -> Iterator[tuple]:
        g2, flat = (x.ravel() for x in _squares((nx, ny, nz), side, (bx, by, bz)))
        keep = (g2 < last) | ((g2 == last) & (flat <= end))
        yield task_id, nx, ny, nz, side, bx, by, bz, *(np.where(keep, x.astype(np.float32).astype(float) if single else x, 0.0) for x in (re, im))

    rows = spectra.join(_limits(spectra, fraction), "task_id").select("task_id", *SIZES, "side", *PLACE, "re", "im", "last_g2", "last_flat")
    return each_row(rows, run, _typed(spectra, _SPECTRUM))


def lowpass(bricks: DataFrame, fraction: float, single: bool = True) -> DataFrame:
    """Bricks of the grids that the coefficients of lowest frequency give back."""
    return inverse(lowest(spectrum(bricks), fraction, single))
