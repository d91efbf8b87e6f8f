"""Polls in event order across micro-batches, and tables kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELTAS = "user_id long, poll long, event_id long, ts timestamp, total double, delta double, per_hour double"


def keep_state_in_rocks(spark: SparkSession) -> None:
    """State with lists and timers needs this store; it spills to disk and is saved in the checkpoint folder."""
    spark.conf.set(STORE, ROCKS)


#: Groups of runs that share their state; each takes some calls to the state store in a micro-batch, however many runs it has.
PARTS = 1024


class OrderedPolls(StatefulProcessor):
    """Polls of a group of runs wait until the watermark has passed them and are then taken in order of time, so one that comes in a later batch still stands in its place."""

    def __init__(self, settled_minutes: float):
        self.settled = settled_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "user_id long, at long, event_id long, total double")
        self.past = handle.getListState("past", "user_id long, began long, polls long, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            f = f.dropna(subset=["value"])
            at = f["ts"].astype("datetime64[us]").astype("int64")
            if len(f):
                self.pending.appendList(list(zip(f["run"].tolist(), at.tolist(), f["event_id"].tolist(), f["value"].astype(float).tolist(), strict=True)))
                first = min(int(at.min()), first if first is not None else int(at.min()))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.pending.get())
        due, rest = [p for p in held if p[1] < mark], [p for p in held if p[1] >= mark]
        if not due:
            if rest:
                self.handle.registerTimer(min(p[1] for p in rest) // 1000 + 1)
            return
        self.pending.clear()
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(min(p[1] for p in rest) // 1000 + 1)
        known = {p[0]: tuple(p[1:]) for p in self.past.get()} if self.past.exists() else {}
        run, at, event, total = (np.array(c) for c in zip(*due, strict=True))
        start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(start, len(run)))
        past = [known.get(r, (a, 0, t)) for r, a, t in zip(run[start].tolist(), at[start].tolist(), total[start].tolist(), strict=True)]
        began, polls, last = (np.array(c) for c in zip(*past, strict=True))
        before = np.concatenate(([0.0], total[:-1]))
        before[start] = last
        hours = (at - np.repeat(began, size)) / 3.6e9
        rate = np.where(hours * 60 > self.settled, total / np.where(hours > 0, hours, 1), 0.0)
        number = np.repeat(polls - start, size) + np.arange(1, len(run) + 1)
        end = start + size - 1
        known.update(zip(run[end].tolist(), zip(began.tolist(), number[end].tolist(), total[end].tolist(), strict=True), strict=True))
        self.past.put([(r, *p) for r, p in known.items()])
        yield pd.DataFrame({"user_id": pd.array(run if key[1] else [None] * len(run), dtype="Int64"), "poll": number, "event_id": event, "ts": at.astype("datetime64[us]"), "total": total, "delta": np.maximum(0.0, total - before), "per_hour": rate})

    def close(self) -> None:
        pass


def ordered_deltas(events: DataFrame, late: str, settled_minutes: float = 0.5) -> DataFrame:
    """A row for each poll as in ``counters.counter_deltas``, but in event order over all batches.

    A poll is given once the watermark (the latest time seen less ``late``) has passed it; one that comes
    after that is dropped. Null totals are left out. Runs share state in ``PARTS`` groups by a hash of
    their id (those of no id have their own); a group's state holds the polls that wait and a row for each run.
    """
    keep_state_in_rocks(events.sparkSession)
    marked = events.select(F.coalesce("user_id", F.lit(0)).alias("run"), F.col("user_id").isNotNull().alias("named"), "event_id", "ts", "value")
    parts = marked.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(PARTS))).withWatermark("ts", late).groupBy("part", "named")
    return parts.transformWithStateInPandas(OrderedPolls(settled_minutes), DELTAS, "append", "eventTime")


def merge_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str | None = None) -> None:
    """Keep a snapshot of the latest row of each key, by ``order``, while a stream is read: each micro-batch merges into a new version.

    A version's folder bears the number of its batch and is complete once Spark's ``_SUCCESS`` file is
    there. A batch that is run again, after a stop at any point, starts from the version before it and
    writes the same one; older versions than the last two are removed.
    """
    spark = stream.sparkSession
    files = Versions(spark, path)

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in files.complete() if v < number]
        old = [files.read(before[-1])] if before else []
        rows = batch.select(*batch.columns)
        for table in old:
            rows = rows.unionByName(table)
        whole = F.struct(order, *(c for c in rows.columns if c != order))
        latest = rows.groupBy(*keys).agg(F.max(whole).alias("_row"))
        latest.select(*(F.col("_row")[c].alias(c) for c in batch.columns)).write.mode("overwrite").parquet(files.at(number))
        for gone in before[:-1]:
            files.remove(gone)

    stream.writeStream.option("checkpointLocation", checkpoint or f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


class Versions:
    """The numbered versions of a table below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, number: int) -> str:
        return f"{self.path}/version-{number:012d}"

    def complete(self) -> list[int]:
        """Numbers of whole versions, in order."""
        found = self._fs.globStatus(self._hadoop(f"{self.path}/version-*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("version-")) for f in found)

    def read(self, number: int | None = None) -> DataFrame:
        """A version, by default the last."""
        return self.spark.read.parquet(self.at(self.complete()[-1] if number is None else number))

    def remove(self, number: int) -> None:
        self._fs.delete(self._hadoop(self.at(number)), True)
