"""Queries on streams that need state in event order, snapshots and counters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.plans.registry import query, table
from lattica.sources.scratch import new_path
from lattica.streaming import counters, ordered

_PARTS = 4


def _crossed(spark, d):
    """A stream of the events in parts by time, every other event one part late, and after them a row that moves the watermark past all; and by how much events are late at most."""
    events, folder = table(spark, d, "events").select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in counters.EVENTS.split(", ")))), new_path(spark, "crossed")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    width = (last - first) // _PARTS + 1
    part = F.floor((F.unix_seconds("ts") - first) / width) + F.col("event_id") % 2
    for i in range(_PARTS + 1):
        events.where(part == i).write.mode("append").parquet(folder)
    end = spark.createDataFrame([(-1, dt.datetime.fromtimestamp(last + 100 * width, dt.timezone.utc), -1, None, 0.0, None)], counters.EVENTS)
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(counters.EVENTS).option("maxFilesPerTrigger", 8).parquet(folder), f"{2 * width} seconds"


@query("""WITH e AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS hours, lag(value) OVER w AS before, row_number() OVER w AS poll FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, poll, event_id, value AS total, round(greatest(0, value - coalesce(before, value)), 6) AS delta, round(CASE WHEN hours * 60 > 0.5 THEN value / hours ELSE 0 END, 5) AS per_hour FROM e""")
def stream_ordered_deltas(spark, d):
    """Polls that come one batch late stand in their place."""
    events, late = _crossed(spark, d)
    out = counters.run_to_table(ordered.ordered_deltas(events, late), "append", "ordered")
    return out.select("user_id", "poll", "event_id", "total", F.round("delta", 6).alias("delta"), F.round("per_hour", 5).alias("per_hour"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_snapshot(spark, d):
    """The latest event of each user, merged batch by batch into versions of a table."""
    events, _ = _crossed(spark, d)
    path = new_path(spark, "snapshot")
    ordered.merge_batches(events.select("user_id", "event_id", "event_type", "value"), path, ["user_id"], "event_id")
    return ordered.Versions(spark, path).read().where("user_id >= 0")


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS finished, count(*) AS n FROM events GROUP BY 1")
def stream_lifecycle_counts(spark, d):
    """Counters of each user's events of three kinds, kept as a stream's state; the last update of each counts."""
    events, _ = _crossed(spark, d)
    of = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    counts = events.groupBy("user_id").agg(of("signup", "started"), of("error", "failed"), of("purchase", "finished"), F.count("*").alias("n"))
    out = counters.run_to_table(counts, "update", "lifecycle")
    newest = Window.partitionBy("user_id").orderBy(F.desc("batch"))  # a row for each batch
    return out.where("user_id >= 0").withColumn("r", F.row_number().over(newest)).where("r = 1").select("user_id", "started", "failed", "finished", "n")
