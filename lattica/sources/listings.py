"""Small inputs around the grids: id lists, splits, result files, logs, codec files, table writers."""

from __future__ import annotations

import io
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.lmq import LloydMax
from lattica.operators.order import numbered
from lattica.sources.arrays import store


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(idx, id): non-blank lines of a text listing, or of the files of a folder by name, numbered from 0 in their order.

    A large listing is split: lines are ordered by file, start of their split and place in it.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    return numbered(lines.where("id <> ''"), "_file", "_start", "_line", name="idx").select((F.col("idx") - 1).alias("idx"), "id")


def read_split(spark: SparkSession, path: str, split: str, listing: DataFrame) -> DataFrame:
    """Ids of a split in a JSON map of splits to lists of ids or of positions in the listing."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    members = doc.select(F.explode(F.element_at("m", split)).alias("member"))
    at = F.expr("try_cast(member AS BIGINT)")
    by_place = members.where(at.isNotNull()).select(at.alias("idx")).join(listing, "idx").select("id")
    return by_place.unionByName(members.where(at.isNull()).select(F.col("member").alias("id")))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results ``step-<n>.json`` with their step; unreadable files give nulls."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"step-(\d+)", 1).cast("long"))


def read_job_log(spark: SparkSession, path: str, prefix: str = "I20") -> DataFrame:
    """Distinct first tokens of log lines, without log noise and a header line."""
    lines = spark.read.text(path).where(~F.col("value").startswith(prefix) & (F.trim("value") != ""))
    first = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    return lines.select(first.alias("job_id")).where(F.col("job_id").startswith("/")).distinct()


def read_codec(path: str) -> LloydMax:
    """A fitted quantizer from a numpy archive on any file system; small, so the driver reads it."""
    system, at = store(path)
    with system.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as z:
        return LloydMax(z["boundaries"].astype(float).tolist(), z["recon_points"].astype(float).tolist(), float(z["clip_max"]))


def write_codec(codec: LloydMax, path: str) -> None:
    """A fitted quantizer as a numpy archive; its size is the number of bins."""
    system, at = store(path)
    body = io.BytesIO()
    np.savez(body, boundaries=codec.boundaries, recon_points=codec.recon, clip_max=codec.clip_max)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(body.getvalue())


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, md5) of every file below a folder; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^file:/*", "/", path.rstrip("/"))
    return files.select(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(f"{root}/"), F.lit("")).alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def write_history(rows: DataFrame, path: str, step: str = "_step") -> DataFrame:
    """Snappy Parquet in step order, null and zero steps first, and the manifest (rows, first and last step)."""
    rows.orderBy(F.coalesce(F.nullif(F.col(step), F.lit(0)), F.lit(-1))).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return rows.agg(F.count("*").alias("rows"), F.min(step).alias("first"), F.max(step).alias("last"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in order of first appearance."""
    return numbered(rows.groupBy(key).agg(F.min(order).alias("_at")), "_at").drop("_at")
