"""Exact order statistics of groups of any size, by narrowing brackets.

Each pass reads the values twice: a sketch of every open interval proposes a bracket around each rank
that is sought, and exact counts tell on which side of the bracket's ends the rank falls. What a task
sends on is a sketch or four counts for each bracket, however many values it read. An interval of at
most ``GATHER`` values is sorted; equal values need no further pass, as a bracket's ends count apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.scratch import checkpointed

#: An interval of so many values is sorted.
GATHER = 10_000
#: Points of a sketch, and its accuracy: ranks are off by at most a part in ``ACCURACY`` of the interval's values.
POINTS, ACCURACY = 128, 2048
#: Rows of the table of open intervals up to which it is broadcast.
BROADCAST = 50_000


def _within(values: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside the open intervals (keys, low, high; null ends are open) of their group."""
    inner = intervals.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in intervals.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = (F.col("low").isNull() | (F.col("_v") > F.col("low"))) & (F.col("high").isNull() | (F.col("_v") < F.col("high")))
    small = intervals.count() <= BROADCAST
    return values.join(F.broadcast(inner) if small else inner, reduce(Column.__and__, [*same, inside])).drop(*(f"_{k}" for k in keys))


def order_statistics(rows: DataFrame, keys: list[str], value: str | Column, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each rank, from 0, of its group's sorted non-null values; ``ranks``: (keys, rank), inside the group's size.

    Null keys are a group of their own. NaN counts as the greatest value.
    """
    own = [f"_k{i}" for i in range(len(keys) or 1)]
    given = [F.col(k) for k in keys] or [F.lit(0)]
    values = rows.select(*(c.alias(k) for c, k in zip(given, own, strict=True)), (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null")
    sizes = values.groupBy(*own).agg(F.count("*").alias("inside"))
    asked = ranks.select(*(c.alias(f"_{k}") for c, k in zip(given, own, strict=True)), F.col("rank").cast("long").alias("rank")).distinct()
    met = sizes.join(asked, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in own])).where("rank >= 0 and rank < inside")
    sought, found = met.select(*own, "rank", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"), "inside", F.lit(None).cast("double").alias("value")), []
    while True:
        sought = checkpointed(sought)
        found.append(sought.where("value is not null").select(*own, "rank", "value"))
        few, many = sought.where(f"value is null and inside <= {GATHER}"), sought.where(f"value is null and inside > {GATHER}")
        found.append(_sorted(values, few, own))
        if many.isEmpty():
            break
        sought = _narrowed(values, many, own)
    result = reduce(DataFrame.unionAll, found)
    return result.select(*(F.col(k).alias(name) for k, name in zip(own, keys, strict=False)), "rank", "value")


def _sorted(values: DataFrame, few: DataFrame, own: list[str]) -> DataFrame:
    """Values at ranks of intervals that may be sorted: equal values are counted first, and an interval's counts are one short array."""
    spans = few.select(*own, "low", "high").distinct()
    counts = _within(values, spans, own).groupBy(*own, "low", "high", "_v").agg(F.count("*").alias("n"))
    lists = counts.groupBy(*own, "low", "high").agg(F.array_sort(F.collect_list(F.struct("_v", "n"))).alias("held"))
    lists = lists.select(*(F.col(c).alias(f"_{c}") for c in (*own, "low", "high")), "held")
    both = few.join(lists, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, "low", "high")]))
    start = F.struct((F.col("rank") - F.col("below")).alias("left"), F.lit(None).cast("double").alias("value"))
    step = lambda s, x: F.struct((s["left"] - x["n"]).alias("left"), F.when((s["left"] >= 0) & (s["left"] < x["n"]), x["_v"]).otherwise(s["value"]).alias("value"))
    return both.select(*own, "rank", F.aggregate("held", start, step)["value"].alias("value"))


def _narrowed(values: DataFrame, many: DataFrame, own: list[str]) -> DataFrame:
    """The ranks with a narrower interval each, or their value."""
    spans = many.select(*own, "low", "high").distinct()
    points = [i / POINTS for i in range(POINTS + 1)]
    sketch = _within(values, spans, own).groupBy(*own, "low", "high").agg(F.percentile_approx("_v", points, ACCURACY).alias("points"))
    sketch = sketch.select(*(F.col(c).alias(f"_{c}") for c in (*own, "low", "high")), "points")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, "low", "high")])
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * POINTS).cast("int")
    near = many.join(sketch, same).select(*own, "rank", "low", "high", "below", "inside", F.get("points", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("points", F.least(at + 2, F.lit(POINTS))).alias("b"))
    near = checkpointed(near)
    v = F.col("_v")
    counts = _within(values, near.select(*own, "low", "high", "a", "b").distinct(), own).groupBy(*own, "low", "high", "a", "b")
    counts = counts.agg(F.count_if(v < F.col("a")).alias("under_a"), F.count_if(v <= F.col("a")).alias("upto_a"), F.count_if(v < F.col("b")).alias("under_b"), F.count_if(v <= F.col("b")).alias("upto_b"))
    ends = (*own, "low", "high", "a", "b")
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in ends), "under_a", "upto_a", "under_b", "upto_b")
    both = near.join(counts, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ends]))
    k, none = F.col("rank") - F.col("below"), F.lit(None).cast("double")
    pick = lambda first, at_a, middle, at_b, last: F.when(k < F.col("under_a"), first).when(k < F.col("upto_a"), at_a).when(k < F.col("under_b"), middle).when(k < F.col("upto_b"), at_b).otherwise(last)
    zero = F.lit(0).cast("long")
    return both.select(
        *own, "rank",
        pick(F.col("low"), none, F.col("a"), none, F.col("b")).alias("low"), pick(F.col("a"), none, F.col("b"), none, F.col("high")).alias("high"),
        (F.col("below") + pick(zero, zero, F.col("upto_a"), zero, F.col("upto_b"))).alias("below"),
        pick(F.col("under_a"), zero, F.col("under_b") - F.col("upto_a"), zero, F.col("inside") - F.col("upto_b")).alias("inside"),
        pick(none, F.col("a"), none, F.col("b"), none).alias("value"),
    )


def quantiles(rows: DataFrame, keys: list[str], value: str | Column, shares: list[float]) -> DataFrame:
    """(keys, q, value): exact quantiles, linear between neighbouring ranks, as numpy's and SQL's continuous ones. Groups without a value have no rows."""
    named = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_x")).where("_x is not null")
    sizes = checkpointed(named.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 0"))
    place = sizes.select(*keys, "_n", F.explode(F.array(*map(F.lit, shares))).alias("q")).withColumn("_at", F.col("q") * (F.col("_n") - 1))
    ends = place.select(*keys, "q", F.floor("_at").alias("_low"), F.ceil("_at").alias("_high"), (F.col("_at") - F.floor("_at")).alias("_part"))
    ranks = ends.select(*keys, F.col("_low").alias("rank")).union(ends.select(*keys, F.col("_high").alias("rank")))
    found = order_statistics(named, keys, "_x", ranks)
    both = ends.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "q", "_low", "_high", "_part")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    hit = found.join(both, reduce(Column.__and__, [*same, (F.col("rank") == F.col("_low")) | (F.col("rank") == F.col("_high"))]))
    low, high = F.max(F.when(F.col("rank") == F.col("_low"), F.col("value"))), F.max(F.when(F.col("rank") == F.col("_high"), F.col("value")))
    return hit.groupBy(*keys, "q", "_part").agg((low + F.when(F.col("_part") > 0, (high - low) * F.col("_part")).otherwise(0.0)).alias("value")).drop("_part")


def wide(found: DataFrame, keys: list[str], names: dict[float, str]) -> DataFrame:
    """One row a group with a column for each share in ``names``."""
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in names.items()))
