"""Places in a global order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.scratch import checkpointed


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Add the row's place, from 1, in the order of the given columns: sorted by ranges, numbered in each, shifted by the ranges before it.

    Rows are written once, between the sort and the count, since the ranges come from a sample. Equal
    rows get places in any order. Only a row for each range goes to every task.
    """
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    ranged = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select(F.col("_part").alias("_other"), "_n")
    before = sizes.select("_part").join(F.broadcast(ahead), F.col("_other") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_at", "_part", "_row", "_before")
