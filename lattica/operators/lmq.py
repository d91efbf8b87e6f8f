"""Lloyd-Max quantizer: distributed histogram, equal-mass start, iterations, encode and decode."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.selection import quantiles, wide


def fine_bin(value: Column, low: float = 1e-6, high: float = 1e5, bins: int = 1_000_000) -> Column:
    """Index of a magnitude's bin on a grid even in its logarithm; what lies outside goes to the end bins."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.abs(value.cast("double"))))
    at = F.floor((F.ln(x) - math.log(low)) / F.lit(math.log(high) - math.log(low)) * bins)
    return F.least(F.lit(bins - 1).cast("long"), at.cast("long"))


def fine_centre(index: Column, low: float = 1e-6, high: float = 1e5, bins: int = 1_000_000) -> Column:
    return F.exp(F.lit(math.log(low)) + (index + 0.5) / F.lit(float(bins)) * F.lit(math.log(high) - math.log(low)))


def histogram(values: DataFrame, column: str, low: float = 1e-6, high: float = 1e5, bins: int = 1_000_000) -> DataFrame:
    """(bin, n, centre): each task counts before the shuffle, so at most ``bins`` rows leave it."""
    return values.where(F.col(column).isNotNull()).groupBy(fine_bin(F.col(column), low, high, bins).alias("bin")).agg(F.count("*").alias("n")).withColumn("centre", fine_centre(F.col("bin"), low, high, bins))


def equal_mass(hist: DataFrame, n_bins: int) -> DataFrame:
    """(q, boundary): centres at which the cumulative share first reaches q / n_bins, for q from 1 to n_bins - 1.

    The window runs over the histogram, whose size is a parameter, not over the data.
    """
    order = Window.orderBy("bin")
    shares = hist.withColumn("cdf", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()))
    reached = shares.withColumn("upto", F.floor(F.col("cdf") * n_bins + 1e-9)).withColumn("before", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    first = reached.where("upto > before").select(F.explode(F.sequence(F.col("before") + 1, F.col("upto"))).alias("q"), F.col("centre").alias("boundary"))
    return first.where(F.col("q") < n_bins)


def assign(values: DataFrame, column: str, boundaries: list[float], out: str = "bin") -> DataFrame:
    """Bin of each value by binary search, upper side at a boundary; repeated boundaries leave empty bins."""
    distinct = sorted(set(boundaries))
    at = {b: i + 1 for i, b in enumerate(sorted(boundaries))}  # the last of equal ones
    splits = [-math.inf, *distinct, math.inf]
    placed = Bucketizer(splits=splits, inputCol="__v", outputCol="__b", handleInvalid="keep").transform(values.withColumn("__v", F.col(column).cast("double")))
    bucket = F.col("__b").cast("int")
    if len(distinct) < len(boundaries):
        bucket = F.get(F.array(F.lit(0), *[F.lit(at[b]) for b in distinct]), bucket)
    return placed.withColumn(out, bucket.cast("long")).drop("__v", "__b")


def lloyd_step(hist: DataFrame, boundaries: list[float]) -> DataFrame:
    """One iteration over the histogram: (bin, n, recon), recon the weighted mean of each bin."""
    return assign(hist, "centre", boundaries).groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("centre") * F.col("n")) / F.sum("n")).alias("recon"))


def bin_medians(hist: DataFrame, boundaries: list[float]) -> DataFrame:
    """(bin, median): the first centre at which half of a bin's weight is reached."""
    placed = assign(hist, "centre", boundaries)
    w = Window.partitionBy("bin")
    run = F.sum("n").over(w.orderBy("centre").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("run", run).withColumn("half", F.sum("n").over(w) / 2).where("run >= half").groupBy("bin").agg(F.min("centre").alias("median"))


@dataclass
class LloydMax:
    """Fitted quantizer: n - 1 boundaries, n reconstruction points, and the largest value."""

    boundaries: list[float]
    recon: list[float]
    clip_max: float

    def __post_init__(self):
        if len(self.recon) != len(self.boundaries) + 1:
            raise ValueError("a quantizer has one more point than boundaries")
        if any(b > a for a, b in zip(self.boundaries[1:], self.boundaries, strict=False)):
            raise ValueError("boundaries must not fall")

    @property
    def n_bins(self) -> int:
        return len(self.recon)

    @property
    def bits(self) -> int:
        return math.ceil(math.log2(self.n_bins))

    def encode(self, df: DataFrame, column: str, out: str = "bin") -> DataFrame:
        clipped = df.withColumn("__c", F.greatest(F.lit(0.0), F.least(F.lit(self.clip_max), F.col(column).cast("double"))))
        return assign(clipped, "__c", self.boundaries, out).drop("__c")

    def decode(self, index: Column) -> Column:
        at = F.greatest(F.lit(0).cast("long"), F.least(F.lit(self.n_bins - 1).cast("long"), index.cast("long")))
        return F.get(F.array(*map(F.lit, self.recon)), at.cast("int"))


def _iterate(x: np.ndarray, w: np.ndarray, n_bins: int, iterations: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, points) of Lloyd's iterations from an equal-mass start; empty bins get points between their neighbours'."""
    bounds, points = np.interp(np.arange(1, n_bins) / n_bins, np.cumsum(w) / w.sum(), x), x[:0]
    for _ in range(iterations):
        points = _points(np.searchsorted(bounds, x, side="left"), x, w, n_bins)
        new = (points[1:] + points[:-1]) / 2
        moved = np.abs(new - bounds).max(initial=0)
        bounds = new
        if moved < tolerance:
            break
    return bounds, points


def _points(at: np.ndarray, x: np.ndarray, w: np.ndarray, n_bins: int) -> np.ndarray:
    """Weighted mean of each bin."""
    weight = np.bincount(at, w, n_bins)
    held = np.flatnonzero(weight)
    return np.interp(np.arange(n_bins), held, np.bincount(at, w * x, n_bins)[held] / weight[held])


def _middles(at: np.ndarray, x: np.ndarray, w: np.ndarray, n_bins: int) -> np.ndarray:
    """First centre of each bin at which half of its weight is reached."""
    run = np.cumsum(w)
    ends = np.searchsorted(at, np.arange(n_bins), side="right")
    starts = np.searchsorted(at, np.arange(n_bins))
    held = np.flatnonzero(ends > starts)
    before = np.concatenate(([0.0], run))[starts[held]]
    half = before + (run[ends[held] - 1] - before) / 2
    return np.interp(np.arange(n_bins), held, x[np.minimum(np.searchsorted(run, half), ends[held] - 1)])


def _weights(hist: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = hist.orderBy("bin").select("centre", "n").toPandas()  # at most the histogram's fixed number of bins
    return rows["centre"].to_numpy(float), rows["n"].to_numpy(float)


def fit(hist: DataFrame, n_bins: int, clip_max: float, iterations: int = 30, tolerance: float = 1e-8) -> LloydMax:
    """Lloyd's iterations from an equal-mass start.

    The histogram, of at most its fixed number of bins, comes to the driver; the data does not.
    """
    bounds, points = _iterate(*_weights(hist), n_bins, iterations, tolerance)
    return LloydMax(bounds.tolist(), points.tolist(), clip_max)


def fit_report(hist: DataFrame, n_bins: int, clip_max: float, iterations: int = 30, tolerance: float = 1e-8) -> tuple[DataFrame, dict[str, float]]:
    """What a fit gives beside its boundaries: (bin, n, low, mean, median) of each bin, and the expected absolute error with means
    (``mae``), with medians (``mae_median``), the mean value, and the errors over it (``nmae``, ``nmae_median``), which bound a model's."""
    x, w = _weights(hist)
    bounds, _ = _iterate(x, w, n_bins, iterations, tolerance)
    at = np.searchsorted(bounds, x, side="left")
    mean, median = _points(at, x, w, n_bins), _middles(at, x, w, n_bins)
    rho = float((x * w).sum() / w.sum())
    off = lambda p: float((np.abs(x - p[at]) * w).sum() / w.sum())
    totals = {"mae": off(mean), "mae_median": off(median), "mean": rho, "nmae": off(mean) / max(rho, 1e-30), "nmae_median": off(median) / max(rho, 1e-30)}
    low = np.concatenate(([0.0], bounds))
    rows = [(int(i), int(n), *map(float, v)) for i, n, *v in zip(range(n_bins), np.bincount(at, w, n_bins), low, mean, median, strict=True)]
    return hist.sparkSession.createDataFrame(rows, "bin long, n long, low double, mean double, median double"), totals


def quantizer_errors(hist: DataFrame, boundaries: list[float]) -> DataFrame:
    """Expected absolute and root mean square error of a histogram quantized at boundaries to its bins' means."""
    placed = assign(hist, "centre", boundaries)
    points = placed.groupBy("bin").agg((F.sum(F.col("centre") * F.col("n")) / F.sum("n")).alias("_p"))
    off = placed.select(F.col("bin"), "centre", "n").join(points, "bin").withColumn("_d", F.abs(F.col("centre") - F.col("_p")))
    return off.agg((F.sum(F.col("_d") * F.col("n")) / F.sum("n")).alias("mae"), F.sqrt(F.sum(F.col("_d") * F.col("_d") * F.col("n")) / F.sum("n")).alias("rmse"))


def log_range(rows: DataFrame, keys: list[str], value: str | Column, low: float = 0.0001, high: float = 0.9999, padding: float = 1.0, least: float = 0.0) -> DataFrame:
    """(keys, log_min, log_max): decimal logarithms of two exact quantiles of the magnitudes above ``least``, widened by ``padding``; ``high=1`` takes the greatest, as coefficients of a transform need."""
    size = F.abs(F.col(value) if isinstance(value, str) else value)
    found = wide(quantiles(rows.select(*keys, size.alias("_size")).where(F.col("_size") > least), keys, "_size", [low, high]), keys, {low: "_low", high: "_high"})
    return found.select(*keys, (F.log10("_low") - padding).alias("log_min"), (F.log10("_high") + padding).alias("log_max"))
