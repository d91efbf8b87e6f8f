"""Batch preparation: rejects, splits, stripes, shard sizes, sampling, shuffling, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.order import numbered


def reject_reason(missing: Column, dims: list[Column], lattice_ok: Column, longest: Column, limit: int, grid_limit: int = 1024) -> Column:
    """The first of missing, oversized, lattice and overflow that holds; null for an accepted material."""
    return F.when(missing, "missing").when(F.greatest(*dims) >= grid_limit, "oversized").when(~lattice_ok, "lattice").when(longest > limit, "overflow")


def reject_summary(rows: DataFrame, task: str = "task_id", first: int = 50) -> DataFrame:
    """(reason, n, examples): counts per class and its smallest ids, as run metadata holds them.

    Ranks come before the lists, so no list is longer than ``first``.
    """
    w = Window.partitionBy("reason").orderBy(task)
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first).groupBy("reason").agg(F.array_sort(F.collect_list(task)).alias("examples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason", "left")


def resolve_split(indices: DataFrame, listing: DataFrame) -> DataFrame:
    """Split members given by position: (split, idx) with (idx, id) of the listing."""
    return indices.join(listing, "idx")


def stripe(rows: DataFrame, index: str, worker: int, workers: int) -> DataFrame:
    return rows.where(F.pmod(F.col(index), F.lit(workers)) == worker)


def shard_bins(rows: DataFrame, task: str, per_shard: int, worker: str | None = None) -> DataFrame:
    """(task, rows, shard): shards of at most ``per_shard`` rows by running count, where a task never straddles two.

    A shard is closed when its rows and the next task's would exceed the limit. Tasks are numbered in
    order within a worker, or, without ``worker``, within ranges of tasks; each partition carries the
    running count over its sorted stream, so no list of tasks is held. Shards are numbered within their worker or range.
    """
    by = worker or "_range"
    sizes = rows.groupBy(*([worker] if worker else []), F.col(task).cast("long").alias("_t")).agg(F.count("*").alias("_n"))
    if worker:
        sorted_ = sizes.select(F.col(worker).cast("long").alias(by), "_t", "_n").repartition(by).sortWithinPartitions(by, "_t")
    else:
        sorted_ = sizes.repartitionByRange("_t").sortWithinPartitions("_t").select(F.spark_partition_id().cast("long").alias(by), "_t", "_n")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, fill = None, 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    key, shard, fill = k, 0, 0
                elif fill + n > per_shard:
                    shard, fill = shard + 1, 0
                fill += n
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[by, task, "rows", "shard"])

    return sorted_.mapInArrow(fold, f"{by} long, {task} long, rows long, shard long")


def fitting(rows: DataFrame, task: str, length: Column, limit: int) -> DataFrame:
    """Rows of the tasks of which no row is longer than ``limit``: one that overflows drops its whole task."""
    return rows.withColumn("_longest", F.max(length).over(Window.partitionBy(task))).where(F.col("_longest") <= limit).drop("_longest")


def every_nth_shard(files: DataFrame, folder: str, path: str, per_folder: int, nth: int) -> DataFrame:
    """The first ``per_folder`` files of each folder, every ``nth`` of them."""
    r = F.row_number().over(Window.partitionBy(folder).orderBy(path))
    return files.withColumn("r", r).where((F.col("r") <= per_folder) & (F.pmod(F.col("r") - 1, F.lit(nth)) == 0))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, by: str | None = None) -> DataFrame:
    """``n`` rows (of each ``by``) decided by the md5 of seed and key, whatever the partitioning."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    if by is None:
        return rows.orderBy(mark, key).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(mark, key))).where(F.col("_r") <= n).drop("_r")


def block_shuffle(rows: DataFrame, index: str, io_block: int, window_blocks: int, seed: int) -> DataFrame:
    """Add ``block``, ``window`` and ``mark``: blocks of neighbouring rows in shuffled order, grouped into windows, and rows shuffled within a window.

    Reading in (window, mark) order needs ``window_blocks`` blocks in memory.
    """
    blocks = rows.select(F.floor(F.col(index) / io_block).alias("block")).distinct()
    placed = numbered(blocks, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"))), "block").select("block", F.floor((F.col("place") - 1) / window_blocks).alias("window"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("row"), F.col(index).cast("string")))
    return rows.withColumn("block", F.floor(F.col(index) / io_block)).join(placed, "block").withColumn("mark", mark)


def compare_manifests(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, status): ok, mismatch or missing for each local (path, md5)."""
    there = remote.select("path", F.col("md5").alias("_there"), F.lit(True).alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("md5").eqNullSafe(F.col("_there")), "ok").otherwise("mismatch")
    return local.join(there, "path", "left").select("path", status.alias("status"))


def write_shards(rows: DataFrame, path: str, task: str, worker: str = "worker", rows_per_file: int = 10_000) -> None:
    """Zstandard Parquet files under a folder for each worker: a file for each shard of ``shard_bins``, so none splits a task."""
    bins = shard_bins(rows, task, rows_per_file, worker).select(F.col(worker).alias("_w"), F.col(task).alias("_t"), F.col("shard").alias("_shard"))
    placed = rows.join(bins, (rows[worker].cast("long") == bins["_w"]) & (rows[task].cast("long") == bins["_t"])).drop("_w", "_t")
    placed.repartition(worker, "_shard").sortWithinPartitions(worker, "_shard").write.mode("overwrite").partitionBy(worker, "_shard").option("compression", "zstd").parquet(path)
