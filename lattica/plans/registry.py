"""Registration of queries with their SQL equivalents, and the pieces that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 4 x 4 x 4 grids of signed values."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("task_id"), F.lit(4).alias("nx"), F.lit(4).alias("ny"), F.lit(4).alias("nz"), F.transform("embedding", lambda x: x.cast("double")).alias("density"), "label")


def r6(c: Column) -> Column:
    """Six decimals, without minus zero."""
    return F.round(c, 6) + F.lit(0.0)


#: The voxel table in SQL.
VOX = """e AS (SELECT vec_id AS task_id, label, embedding, unnest(range(0, 64)) AS flat FROM embeddings),
vox AS (SELECT task_id, label, flat, flat // 16 AS ix, (flat // 4) % 4 AS iy, flat % 4 AS iz, CAST(embedding[flat + 1] AS DOUBLE) AS rho FROM e)"""


def sql_bin(v: str, lo: float, hi: float, bits: int) -> str:
    """SQL of a log bin."""
    clipped = f"greatest(CAST({lo} AS DOUBLE), least(CAST({hi} AS DOUBLE), log10(greatest(abs({v}), 1e-15))))"
    return f"CASE WHEN abs({v}) < 1e-15 THEN 0 ELSE CAST(trunc(({clipped} - ({lo})) / CAST({hi - lo!r} AS DOUBLE) * {(1 << bits) - 1}) AS BIGINT) END"


def sql_unbin(b: str, lo: float, hi: float, bits: int) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE pow(10.0, {b} / CAST({(1 << bits) - 1} AS DOUBLE) * CAST({hi - lo!r} AS DOUBLE) + ({lo})) END"


def sql_r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
