"""Ordered series and small inspections: gap filling, interpolation, previews, holdouts, trees, file integrity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.scans import count_so_far, last_known, next_known, row_before, scan
from lattica.sources.arrays import store


def fill_gaps(rows: DataFrame, series: str, index: str, value: str) -> DataFrame:
    """Linear interpolation over the index inside each series, the nearest value at its edges; ``filled``."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("x"), F.col(value).alias("y")))
    known = scan(rows, series, [index], _before=last_known(series, point), _after=next_known(series, point))
    x0, y0, x1, y1 = (F.col(c) for c in ("_before.x", "_before.y", "_after.x", "_after.y"))
    inside = y0 + (y1 - y0) * F.try_divide(F.col(index) - x0, x1 - x0)
    return known.withColumn("filled", F.coalesce(F.col(value).cast("double"), inside, y0.cast("double"), y1.cast("double"))).drop("_before", "_after")


def interpolate_quantiles(hist: DataFrame, quantiles: list[float]) -> DataFrame:
    """(q, value): centres at the given cumulative shares, linear between bins, clamped at the ends.

    The window runs over the histogram's bins, whose number is a parameter.
    """
    order = Window.orderBy("bin")
    cdf = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    seg = hist.withColumn("cdf", cdf).withColumn("cdf0", F.lag("cdf").over(order)).withColumn("x0", F.lag("centre").over(order))
    asked = seg.select("*", F.explode(F.array(*map(F.lit, quantiles))).alias("q"))
    inside = (F.col("q") <= F.col("cdf")) & (F.coalesce(F.col("cdf0"), F.lit(-1.0)) < F.col("q"))
    value = F.when(F.col("cdf0").isNull(), F.col("centre")).otherwise(F.col("x0") + (F.col("centre") - F.col("x0")) * (F.col("q") - F.col("cdf0")) / (F.col("cdf") - F.col("cdf0")))
    return asked.where(inside).select("q", value.alias("value"))


def log_histogram(values: Column, weight: Column, low: float, high: float, bins: int) -> tuple[Column, Column]:
    """(bin, weight) of values on an even grid of their decimal logarithm; outliers go to the end bins."""
    at = F.floor((F.log10(values) - low) / F.lit((high - low) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("long"), weight


def segments(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Add ``starts`` (the value differs from the one before, or there is none) and ``segment``, the run's number from 1, in the order of each series."""
    marked = scan(rows, series, order, _last=row_before(series, F.col(value))).withColumn("starts", F.col("_last").isNull() | ~F.col(value).eqNullSafe(F.col("_last.value")))
    return scan(marked.drop("_last"), series, order, segment=count_so_far(series, F.col("starts")))


def ends(array: Column, k: int) -> tuple[Column, Column]:
    """The first and last ``k`` items of an array; the whole array where it is shorter."""
    return F.slice(array, 1, k), F.when(F.size(array) <= k, array).otherwise(F.slice(array, -k, k))


def holdout(rows: DataFrame, index: str, n: int) -> DataFrame:
    """Add ``held_out``: the last ``n`` rows by index."""
    last = rows.select(F.col(index).alias("_i")).orderBy(F.desc("_i")).limit(n).agg(F.min("_i").alias("_from"))
    return rows.crossJoin(F.broadcast(last)).withColumn("held_out", F.col(index) >= F.col("_from")).drop("_from")  # broadcast: one row


def status_counts(rows: DataFrame, by: list[str], kinds: dict[str, Column]) -> DataFrame:
    """How often each condition holds in each group."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in kinds.items()])


def walk_tree(docs: DataFrame, column: str, children: str = "children", deepest: int = 100) -> DataFrame:
    """(key, depth, name, leaf, path) of every node in nested JSON documents: a recursive query over variants, level by level.

    ``path`` has the places of a node and those above it. A null document has no nodes; more than
    ``deepest`` levels are an error. The session's limits on recursion are set to that, and rows are not limited.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(deepest + 1))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    given = docs.select(F.col("key").cast("long").alias("key"), F.parse_json(column).alias("node")).where("node is not null")
    return spark.sql(
        """WITH RECURSIVE tree(key, depth, path, node) AS (
               SELECT key, 0, '', node FROM {given}
               UNION ALL
               SELECT tree.key, tree.depth + 1, concat(tree.path, '/', CAST(below.pos AS STRING)), below.value
               FROM tree, LATERAL variant_explode(try_variant_get(tree.node, :children, 'variant')) AS below)
           SELECT key, depth, try_variant_get(node, '$.name', 'string') AS name, try_variant_get(node, :first, 'variant') IS NULL AS leaf, path FROM tree""",
        args={"children": f"$.{children}", "first": f"$.{children}[0]"}, given=given,
    )


def parquet_integrity(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, md5, row_groups, rows, bad_groups, error) of every Parquet file below a folder, each read in full.

    Files, empty ones too, are listed by name on the driver, as Spark's own readers do, and dealt to tasks; a task reads the bytes of one in blocks and its rows in
    batches, so it holds a block and a batch, whatever the file's size. A file that is no Parquet has no row groups.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_integrity(p) for p in f["path"]], columns=["path", "size", "md5", "row_groups", "rows", "bad_groups", "error"])

    system, root = store(re.sub("^file:/*", "/", path))
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    files = [(scheme + f.path,) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".parquet")]
    return spark.createDataFrame(files, "path string").repartition("path").mapInPandas(run, "path string, size long, md5 string, row_groups int, rows long, bad_groups int, error string")


def _integrity(path: str, block: int = 4 << 20) -> tuple:
    """The facts of one file."""
    system, at = store(re.sub("^file:/*", "/", path))
    digest, size, groups, rows, bad, error = hashlib.md5(), 0, 0, 0, 0, None
    with system.open_input_stream(at) as f:
        while part := f.read(block):
            digest.update(part)
            size += len(part)
    try:
        with system.open_input_file(at) as f:
            file = pq.ParquetFile(f)
            groups = file.num_row_groups
            for g in range(groups):
                try:
                    rows += sum(b.num_rows for b in file.iter_batches(row_groups=[g]))
                except (pa.ArrowException, OSError) as e:  # a fault inside a row group counts it as bad
                    bad, error = bad + 1, str(e)[:200]
    except (pa.ArrowException, OSError) as e:  # not a Parquet file
        error = str(e)[:200]
    return path.rsplit("/", 1)[-1], size, digest.hexdigest(), groups, rows, bad, error
