"""Evaluation: decoding distributions over density ids, losses, per-material errors, bootstrap, tests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.formulas import draw
from lattica.operators import order
from lattica.operators.selection import quantiles, wide


def restrict(logits: DataFrame, keys: list[str], first: int, count: int) -> DataFrame:
    """Softmax over ids [first, first + count): rows (keys, token, logit) become (keys, bin, p); other ids are dropped before any shuffle."""
    own = Window.partitionBy(*keys)
    rows = logits.where((F.col("token") >= first) & (F.col("token") < first + count))
    e = rows.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(own)))
    return e.withColumn("p", F.col("_e") / (F.sum("_e").over(own) + 1e-12)).withColumn("bin", F.col("token") - first).drop("_e", "token", "logit")


def decode(dist: DataFrame, keys: list[str], recon: Column, n_bins: int) -> DataFrame:
    """argmax, median and mean decoders of (keys, bin, p), with ``recon`` the value of a bin; ties of argmax go to the smaller bin."""
    rows = dist.withColumn("_v", recon).withColumn("_cum", F.sum("p").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    below = F.least(F.count_if(F.col("_cum") < 0.5), F.lit(n_bins - 1))
    return rows.groupBy(*keys).agg(
        F.max_by("_v", F.struct("p", -F.col("bin"))).alias("argmax_value"),
        below.alias("median_bin"),
        F.sum(F.col("p") * F.col("_v")).alias("mean_value"),
    )


def earth_mover(dist: DataFrame, keys: list[str], recon: Column, target: Column) -> DataFrame:
    """Expected distance to the target: sum of p |recon - target|; give the target of the next token."""
    return dist.groupBy(*keys).agg(F.sum(F.col("p") * F.abs(recon - target)).alias("emd"))


def next_tokens(tokens: DataFrame, keys: list[str], position: str = "pos", token: str = "token") -> DataFrame:
    """Add ``target``, the token at the next position of the sequence, which is what a position predicts; null at the last one."""
    return tokens.withColumn("target", F.lead(token).over(Window.partitionBy(*keys).orderBy(position)))


def shifted_earth_mover(dist: DataFrame, tokens: DataFrame, keys: list[str], recon: Callable[[Column], Column], first: int, count: int) -> DataFrame:
    """Earth mover's distance of (keys, pos, bin, p) to the value of the next position's token, its bin clipped to the range; none at the last position."""
    ahead = next_tokens(tokens, keys).where("target is not null").withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(count - 1), F.col("target") - first)))
    both = dist.join(ahead.select(*keys, "pos", "_bin"), [*keys, "pos"])
    return earth_mover(both, [*keys, "pos"], recon(F.col("bin")), recon(F.col("_bin")))


def predicted_cells(dist: DataFrame, tokens: DataFrame, keys: list[str], recon: Callable[[Column], Column], first: int, count: int) -> DataFrame:
    """(keys, pos, true, pred, emd) of (keys, pos, bin, p): the value of the next position's token, its bin clipped to the range, the mean decoder's value, and the distance between the distribution and it."""
    ahead = next_tokens(tokens, keys).where("target is not null").withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(count - 1), F.col("target") - first)))
    both = dist.join(ahead.select(*keys, "pos", "_bin"), [*keys, "pos"])
    here, there = recon(F.col("bin")), recon(F.col("_bin"))
    return both.groupBy(*keys, "pos").agg(F.first(there).alias("true"), F.sum(F.col("p") * here).alias("pred"), F.sum(F.col("p") * F.abs(here - there)).alias("emd"))


def voxel_pairs(tokens: DataFrame, predicted: DataFrame, keys: list[str], a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """(keys, pos, true_a, true_b, pred_a, pred_b) wherever the two tokens after a position are a pair of ranges ``a`` and ``b`` ([low, high) each).

    ``tokens``: (keys, pos, token); ``predicted``: (keys, pos, pred), what each position predicts for the next one.
    """
    own = Window.partitionBy(*keys).orderBy("pos")
    rows = tokens.join(predicted, [*keys, "pos"])
    ahead = rows.select(*keys, "pos", F.lead("token", 1).over(own).alias("true_a"), F.lead("token", 2).over(own).alias("true_b"), F.col("pred").alias("pred_a"), F.lead("pred").over(own).alias("pred_b"))
    inside = lambda c, r: (F.col(c) >= r[0]) & (F.col(c) < r[1])
    return ahead.where(inside("true_a", a) & inside("true_b", b))


def pair_errors(pairs: DataFrame, value: Callable[[Column, Column], Column], a: tuple[int, int], b: tuple[int, int], *by: str) -> DataFrame:
    """Mean, median and 99th percentile of the absolute error over the mean magnitude, and the pairs predicted outside their ranges, which count as zero."""
    inside = lambda c, r: (F.col(c) >= r[0]) & (F.col(c) < r[1])
    good = inside("pred_a", a) & inside("pred_b", b)
    true = value(F.col("true_a") - a[0], F.col("true_b") - b[0])
    pred = F.when(good, value(F.col("pred_a") - a[0], F.col("pred_b") - b[0])).otherwise(0.0)
    rows = pairs.select(*by, F.abs(true).alias("_size"), F.abs(pred - true).alias("_off"), (~good).alias("_bad"))
    scale = F.avg("_size")
    off = wide(quantiles(rows, list(by), "_off", [0.5, 0.99]), list(by), {0.5: "_p50", 0.99: "_p99"})
    off = off.select(*(F.col(c).alias(f"_of_{c}") for c in by), "_p50", "_p99")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.lit(True))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_voxels"),
        scale.alias("mean_abs_true"),
        F.try_divide(F.avg("_off"), scale).alias("nmae_mean"),
        F.count_if("_bad").alias("n_bad"),
    )
    return sums.join(off, same, "left").select(*by, "n_voxels", "mean_abs_true", "nmae_mean", *(F.try_divide(F.col(c), F.col("mean_abs_true")).alias(n) for c, n in (("_p50", "nmae_median"), ("_p99", "nmae_p99"))), "n_bad")


def position_losses(logits: DataFrame, tokens: DataFrame, keys: list[str], recon: Callable[[Column], Column], first: int, count: int, penalty: float) -> DataFrame:
    """(keys, pos, ce, l1, emd, dense, weight): what every loss of a position is made of, in one pass over the logits.

    ``logits``: (keys, pos, token, logit); ``tokens``: (keys, pos, token, weight), weight null counts as 1. A position's target is
    the next token, so a sequence's last position takes no part. ``ce``: cross entropy; ``l1``: the expected value against the
    target's; ``emd``: the expected distance to it; ids outside [first, first + count) have the value ``penalty``; ``dense``: whether the target is inside.
    """
    value = lambda t: F.when((t >= first) & (t < first + count), recon(t - first)).otherwise(F.lit(float(penalty)))
    ahead = next_tokens(tokens, keys).where("target is not null").select(*keys, "pos", "target", F.coalesce("weight", F.lit(1.0)).alias("_w"))
    own = Window.partitionBy(*keys, "pos")
    rows = logits.join(ahead, [*keys, "pos"]).withColumn("_top", F.max("logit").over(own)).withColumn("_e", F.exp(F.col("logit") - F.col("_top")))
    here, there = value(F.col("token")), value(F.col("target"))
    return rows.groupBy(*keys, "pos").agg(
        (F.ln(F.sum("_e")) + F.first("_top") - F.max(F.when(F.col("token") == F.col("target"), F.col("logit")))).alias("ce"),
        F.abs(F.sum(F.col("_e") * here) / F.sum("_e") - F.first(there)).alias("l1"),
        (F.sum(F.col("_e") * F.abs(here - there)) / F.sum("_e")).alias("emd"),
        ((F.first("target") >= first) & (F.first("target") < first + count)).alias("dense"),
        F.first("_w").alias("weight"),
    )


def mean_loss(*, factor: float, mode: str = "add", kind: str = "l1", density_only: bool = False) -> Column:
    """Aggregate over ``position_losses``: cross entropy plus ``factor`` times the density error (``l1`` or ``emd``), averaged over weighted positions.

    ``mode`` ``replace`` drops the cross entropy where the target is a density id, ``density_only`` everywhere, and then divides by the weight of density positions.
    """
    if mode not in ("add", "replace") or kind not in ("l1", "emd"):
        raise ValueError("mode is add or replace, kind is l1 or emd")
    kept = F.lit(0.0) if density_only else F.when(F.col("dense"), 0.0).otherwise(F.col("ce")) if mode == "replace" else F.col("ce")
    loss = kept + factor * F.when(F.col("dense"), F.col(kind)).otherwise(0.0)
    share = F.when(F.col("dense"), F.col("weight")).otherwise(0.0) if density_only else F.col("weight")
    return F.sum(loss * F.col("weight")) / F.greatest(F.sum(share), F.lit(1.0))


def density_aware_loss(logits: DataFrame, tokens: DataFrame, keys: list[str], recon: Callable[[Column], Column], first: int, count: int, *, weight: float, penalty: float, mode: str = "add", kind: str = "l1", density_only: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, loss, positions): ``mean_loss`` of ``position_losses`` for each group."""
    loss = mean_loss(factor=weight, mode=mode, kind=kind, density_only=density_only)
    return position_losses(logits, tokens, keys, recon, first, count, penalty).groupBy(*by).agg(loss.alias("loss"), F.count("*").alias("positions"))


def cross_entropy(logits: DataFrame, keys: list[str], token: str = "token", logit: str = "logit", target: str = "target") -> DataFrame:
    """Log-sum-exp minus the target's logit, by position."""
    own = Window.partitionBy(*keys)
    top = logits.withColumn("_m", F.max(logit).over(own))
    return top.groupBy(*keys).agg((F.ln(F.sum(F.exp(F.col(logit) - F.col("_m")))) + F.max("_m") - F.max(F.when(F.col(token) == F.col(target), F.col(logit)))).alias("loss"))


def weighted_loss(losses: DataFrame, loss: Column, weight: Column, *by: str) -> DataFrame:
    """sum(loss * weight) / max(sum(weight), 1)."""
    return losses.groupBy(*by).agg((F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss"))


def material_errors(cells: DataFrame, key: str, true: str, pred: str, emd: str | None = None) -> DataFrame:
    """mae, mean_abs_true, nmae and, with ``emd``, mean_emd and nemd of each material; denominators of at least 1e-30."""
    scale = F.greatest(F.avg(F.abs(true)), F.lit(1e-30))
    mae = F.avg(F.abs(F.col(true) - F.col(pred)))
    aggs = [F.count("*").alias("n_cells"), mae.alias("mae"), F.avg(F.abs(true)).alias("mean_abs_true"), (mae / scale).alias("nmae")]
    if emd:
        aggs += [F.avg(emd).alias("mean_emd"), (F.avg(emd) / scale).alias("nemd")]
    return cells.groupBy(key).agg(*aggs)


def summary(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, median and 99th percentile (exact, linear); nulls for an empty set."""
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.99)).alias("p99"))


def bootstrap(rows: DataFrame, column: str, key: str, resamples: int, seed: int, by: str) -> DataFrame:
    """Standard errors (population) of mean, median and 99th percentile over resamples drawn by hashing, so any partitioning gives the same.

    Each group's values are numbered once, in ranges of groups and keys; every resample draws as many numbers as the group has rows.
    Rows: ``resamples`` times the input's, by design.
    """
    placed = order.numbered(rows.where(F.col(column).isNotNull()).select(by, key, F.col(column).alias("_v")), by, key, name="_place")
    groups = placed.groupBy(by).agg(F.min("_place").alias("_from"), F.count("*").alias("_n"))
    numbered = placed.join(groups, by).select(by, "_v", (F.col("_place") - F.col("_from")).alias("_i"), "_n")
    draws = numbered.select(by, "_n", "_i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep"))
    draws = draws.withColumn("_pick", draw(F.col("_n"), F.lit(seed), F.col(by), F.col("_rep"), F.col("_i")))
    picked = draws.join(numbered.select(by, F.col("_i").alias("_pick"), "_v"), [by, "_pick"])
    stats = picked.groupBy(by, "_rep").agg(F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.5)).alias("median"), F.percentile("_v", F.lit(0.99)).alias("p99"))
    return stats.groupBy(by).agg(*[F.stddev_pop(c).alias(f"se_{c}") for c in ("mean", "median", "p99")])


def two_sample(a: Column, se_a: Column, b: Column, se_b: Column) -> dict[str, Column]:
    """Difference, its standard error, z, and the 95 % interval."""
    diff, se = a - b, F.hypot(se_a, se_b)
    return {"diff": diff, "se": se, "z": F.try_divide(diff, se), "low": diff - 1.96 * se, "high": diff + 1.96 * se}
