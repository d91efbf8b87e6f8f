"""Streaming forms: counter deltas with state for each run, and running counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.sources.scratch import new_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def counter_deltas(events: DataFrame, settled_minutes: float = 0.5) -> DataFrame:
    """A row for each poll (user_id, poll, event_id, total, delta, per_hour): state per run is its first time, its count of polls and its last total.

    A run's events are taken in time order within a micro-batch; a total that falls counts as no step,
    and there is no rate before ``settled_minutes``. Null totals are polls that could not be read: they are left out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, polls, last = state.get if state.exists else (None, 0, None)
        batch = pd.concat(list(frames)).dropna(subset=["value"]).sort_values(["ts", "event_id"], kind="stable")
        if not len(batch):
            return
        at = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        began = int(at[0]) if began is None else began
        total = batch["value"].to_numpy(float)
        before = np.concatenate(([total[0] if last is None else last], total[:-1]))
        hours = (at - began) / 3.6e9
        rate = np.where(hours * 60 > settled_minutes, total / np.where(hours > 0, hours, 1), 0.0)
        number = polls + np.arange(1, len(batch) + 1)
        state.update((began, int(number[-1]), float(total[-1])))
        yield pd.DataFrame({"user_id": key[0], "poll": number, "event_id": batch["event_id"].to_numpy(), "total": total, "delta": np.maximum(0.0, total - before), "per_hour": rate})

    schema = "user_id long, poll long, event_id long, total double, delta double, per_hour double"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "began long, polls long, last double", "update", GroupStateTimeout.NoTimeout)


def late_points(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The latest value of each point of a metric that has its own step axis: points may come late, out of order and again."""
    return points.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))


def new_results(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the result files ``step-<n>.json`` that appear below a folder, each row with its step."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "step-*.json").json(folder)
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"step-(\d+)", 1).cast("long"))


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is available and give its rows, written in each micro-batch to a shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/number={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and type with a watermark (an extension beyond the telemetry loops)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
