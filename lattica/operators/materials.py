"""The materials table: generated columns, queries, percentiles, upserts, coverage and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.formulas import ball_length, cube_length, shell_counts
from lattica.operators.selection import order_statistics, quantiles

BALL_RADII = (75, 86, 100, 138, 153)


def with_generated(mats: DataFrame, cubes=range(14, 21), balls=BALL_RADII, overhead: int = 36, tokens_per_voxel: int = 2) -> DataFrame:
    """n_voxels, max_dim, cube_seq_p*, ball_seq_r*; null where an input is null."""
    n = [F.col(f"n{a}").cast("long") for a in "xyz"]
    known = n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull()
    volumes = shell_counts(max(balls)) if balls else []
    return mats.withColumns({
        "n_voxels": n[0] * n[1] * n[2],
        "max_dim": F.when(known, F.greatest(*n)),
        **{f"cube_seq_p{p}": cube_length(F.col("n_atoms"), p, tokens_per_voxel, overhead) for p in cubes},
        **{f"ball_seq_r{r}": ball_length(F.col("n_atoms"), volumes[r], tokens_per_voxel) for r in balls},
    })


def select_where(mats: DataFrame, columns: list[str], condition: str, limit: int | None = None) -> DataFrame:
    """Ad-hoc projection and filter; the columns must exist, the condition is trusted SQL."""
    if unknown := [c for c in columns if c not in mats.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    rows = mats.where(F.expr(condition)).select(*columns)
    return rows.limit(limit) if limit is not None else rows


def fit_fraction(mats: DataFrame, lengths: list[str], budgets: list[int]) -> DataFrame:
    """(length, budget, fits, share): how many materials have a length within each context; one pass over the rows."""
    aggs = [F.count(F.when(F.col(c) <= b, 1)).alias(f"{c}:{b}") for c in lengths for b in budgets]
    one = mats.agg(F.count("*").alias("n"), *aggs)
    pairs = [F.struct(F.lit(c).alias("length"), F.lit(b).cast("long").alias("budget"), F.col(f"`{c}:{b}`").alias("fits")) for c in lengths for b in budgets]
    return one.select("n", F.explode(F.array(*pairs)).alias("p")).select("p.length", "p.budget", "p.fits", F.try_divide("p.fits", "n").alias("share"))


def nearest_rank(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """(p, value) at row floor(n p / 100), from 0 and at most n - 1, of the sorted non-null values, found by narrowing brackets without a sort."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    asked = known.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("rank")) for p in percents])).alias("a")).select("a.p", "a.rank")
    return order_statistics(known, [], "value", asked).join(asked, "rank").select("p", F.col("value").cast(df.schema[column].dataType).alias("value"))


def corpus_totals(shapes: DataFrame, patch: int) -> DataFrame:
    """Totals of grids (nx, ny, nz): voxels (sum, mean, median, largest), disjoint tiles and all offsets of a patch, and the share of grids no larger than it."""
    v = F.col("nx") * F.col("ny") * F.col("nz")
    tiles = F.floor(F.col("nx") / patch) * F.floor(F.col("ny") / patch) * F.floor(F.col("nz") / patch)
    room = lambda c: F.greatest(F.col(c) - patch + 1, F.lit(0))
    offsets = room("nx") * room("ny") * room("nz")
    median = quantiles(shapes, [], v, [0.5]).select(F.col("value").alias("median"))
    totals = shapes.agg(
        F.count("*").alias("n"),
        F.sum(v).alias("voxels"),
        F.avg(v).alias("mean"),
        F.max(v).alias("largest"),
        F.sum(tiles).alias("disjoint"),
        F.max(tiles).alias("most_disjoint"),
        F.sum(offsets).alias("offsets"),
        F.max(offsets).alias("most_offsets"),
        F.avg((v <= patch**3).cast("double")).alias("small"),
    )
    return totals.join(F.broadcast(median), F.lit(True), "left")  # broadcast: one row


def upsert(current: DataFrame, incoming: DataFrame, key: str, replace_split: str | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those of equal key; with ``replace_split``, all current rows of that split go first."""
    kept = current if replace_split is None else current.where(~F.col("split").eqNullSafe(F.lit(replace_split)))
    both = kept.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_new", "_rank")


def budgets(mats: DataFrame, weight: Column, mean_draws: int) -> DataFrame:
    """(…, budget): draws of each material in proportion to its weight, mean_draws on average."""
    total = mats.agg(F.sum(weight).alias("_total"), F.count("*").alias("_n"))
    return mats.crossJoin(F.broadcast(total)).withColumn("budget", F.try_divide(weight.cast("double"), "_total") * mean_draws * F.col("_n")).drop("_total", "_n")  # broadcast: one row


def budget_summary(rows: DataFrame, mean_draws: int) -> DataFrame:
    """Starved (below one draw) and drowned (beyond ten times the mean) materials."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("budget") < 1).alias("starved"), F.count_if(F.col("budget") > 10 * mean_draws).alias("drowned"), F.sum("budget").alias("total"))


def largest_patch(mats: DataFrame, sizes: list[int], budgets_: list[int], targets: list[float], overhead: int = 36, tokens_per_voxel: int = 2) -> DataFrame:
    """(budget, target, p): the last size before the fitting share first falls below the target; null if none."""
    shares = fit_fraction(mats.select(*[cube_length(F.col("n_atoms"), p, tokens_per_voxel, overhead).alias(f"p{p}") for p in sizes]), [f"p{p}" for p in sizes], budgets_)
    shares = shares.withColumn("p", F.substring("length", 2, 9).cast("int"))
    asked = shares.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    run = Window.partitionBy("budget", "target").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ok = asked.withColumn("ok", F.min((F.col("share") >= F.col("target")).cast("int")).over(run))
    return ok.groupBy("budget", "target").agg(F.max(F.when(F.col("ok") == 1, F.col("p"))).alias("p"))
