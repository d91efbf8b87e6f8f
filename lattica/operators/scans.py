"""Running values along ordered series of any length: a series is cut into ranges, and ranges carry over to each other.

Rows are sorted by ranges of (series, order), so a series with a third of all rows lies in many of them.
Inside a range windows work on its rows alone; each range of a series sums itself up in one row, a window
over these few rows gives what the ranges before (or after) hand over, and the two are combined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.scratch import checkpointed


@dataclass(frozen=True)
class Rule:
    """A running value: ``local`` inside a range, ``summary`` of a whole range, ``carry`` of summaries from other ranges, ``combine`` of local and carried."""

    summary: Column
    carry: Callable[[Column], Column]
    local: Column | None = None
    combine: Callable[[Column, Column], Column] = F.coalesce


_ROW = "_row"


def _windows(series: str):
    here, across = Window.partitionBy(series, "_part").orderBy("_row"), Window.partitionBy(series).orderBy("_part")
    upto, onward = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(0, Window.unboundedFollowing)
    before, after = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(1, Window.unboundedFollowing)
    return here, upto, onward, across, before, after


def greatest_so_far(series: str, value: Column) -> Rule:
    _, upto, _, _, before, _ = _windows(series)
    return Rule(F.max(value), lambda s: F.max(s).over(before), F.max(value).over(upto), F.greatest)


def count_so_far(series: str, condition: Column) -> Rule:
    _, upto, _, _, before, _ = _windows(series)
    return Rule(F.count_if(condition), lambda s: F.sum(s).over(before), F.count_if(condition).over(upto), lambda here, carried: here + F.coalesce(carried, F.lit(0)))


def last_known(series: str, value: Column) -> Rule:
    """The last value that is not null, up to the row itself."""
    _, upto, _, _, before, _ = _windows(series)
    return Rule(F.max_by(value, F.when(value.isNotNull(), F.col(_ROW))), lambda s: F.last(s, ignorenulls=True).over(before), F.last(value, ignorenulls=True).over(upto))


def next_known(series: str, value: Column) -> Rule:
    """The first value that is not null, from the row itself on."""
    _, _, onward, _, _, after = _windows(series)
    return Rule(F.min_by(value, F.when(value.isNotNull(), F.col(_ROW))), lambda s: F.first(s, ignorenulls=True).over(after), F.first(value, ignorenulls=True).over(onward))


def row_before(series: str, value: Column) -> Rule:
    """The value of the row before as a struct with the field ``value``; null where there is no such row."""
    here, _, _, across, _, _ = _windows(series)
    held = F.struct(value.alias("value"))
    return Rule(F.max_by(held, _ROW), lambda s: F.lag(s).over(across), F.lag(held).over(here))


def first_of(series: str, value: Column) -> Rule:
    """The value of the series' first row."""
    across = _windows(series)[3]
    return Rule(F.min_by(value, _ROW), lambda s: F.first(s).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def scan(rows: DataFrame, series: str, order: list[str | Column], **rules: Rule) -> DataFrame:
    """``rows`` with a column for each rule, along ``order`` (nulls first) inside each ``series``; rows of equal order have any order, and a null series is one."""
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate([series, *order])}
    ranged = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    sums = ranged.groupBy(series, "_part").agg(*(r.summary.alias(f"_s_{name}") for name, r in rules.items()))
    carried = sums.select(F.col(series).alias("_of"), F.col("_part").alias("_in"), *(r.carry(F.col(f"_s_{name}")).alias(f"_c_{name}") for name, r in rules.items()))
    both = ranged.join(carried, F.col(series).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    # Locals first: a window cannot stand inside the expression that combines.
    both = both.withColumns({f"_l_{name}": r.local for name, r in rules.items() if r.local is not None})
    made = {name: F.col(f"_c_{name}") if r.local is None else r.combine(F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, r in rules.items()}
    return both.withColumns(made).select(*rows.columns, *rules)
