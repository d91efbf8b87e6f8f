"""Text tables, shards, listings and result files, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """CSV files with a header and the given fields in their order; other columns are left out."""
    rows.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV rows of a schema; short, long and unreadable rows are dropped."""
    return spark.read.schema(schema).option("header", header).option("mode", "DROPMALFORMED").option("enforceSchema", True).option("escape", '"').csv(path)


def csv_lines(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One CSV line a row, for a stream of text."""
    return rows.select(F.to_csv(F.struct(*fields)).alias("value"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines and lines that are no object are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("row"), F.get_json_object("value", "$").alias("ok")).where("ok like '{%'").select("row.*")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Parquet shards of all worker folders, or of one flat folder, with the folder's worker (null if flat) and the file's name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    where = F.col("_metadata.file_path")
    worker = F.nullif(F.regexp_extract(where, r"/worker[-=](\d+)/", 1), F.lit("")).cast("int")
    return rows.select("*", worker.alias("worker"), F.col("_metadata.file_name").alias("shard"))


def stems(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Distinct names of the entries below a folder whose path holds ``/<name><suffix>``, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", rf"/([^/]+){suffix}(/|$)", 1)
    return files.select(name.alias("name")).where("name <> ''").distinct()


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Parquet files of a folder; those that cannot be read are skipped."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*([path] if isinstance(path, str) else path))


def write_results(rows: DataFrame, path: str, keys: list[str]) -> None:
    """JSON results in a folder for each combination of ``keys``."""
    rows.write.mode("overwrite").partitionBy(*keys).json(path)


def publish_path(root: str, name: str, version: int) -> str:
    if version < 1:
        raise ValueError("versions start at 1")
    return f"{root.rstrip('/')}/{name}/v{version}"


def publish(rows: DataFrame, root: str, name: str, version: int, dry_run: bool = False) -> str:
    """Write a table under its version, which must be new, and return the path; with ``dry_run`` only return it."""
    path = publish_path(root, name, version)
    if not dry_run:
        rows.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str, name: str) -> int:
    """The highest version under which a table was published, from the names of its folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root.rstrip('/')}/{name}")
    found = files.select(F.regexp_extract("path", rf"/{name}/v(\d+)/", 1).cast("int").alias("v")).agg(F.max("v")).first()[0]
    if found is None:
        raise ValueError(f"{name} was never published below {root}")
    return found


def copy_report(files: DataFrame, copied: DataFrame) -> DataFrame:
    """(path, bytes, status): ok where the copy has the same size, else error, for each (path, size) of ``files``."""
    there = copied.select("path", F.col("size").alias("_there"))
    status = F.when(F.col("size").eqNullSafe(F.col("_there")), "ok").otherwise("error")
    return files.join(there, "path", "left").select("path", F.col("size").alias("bytes"), status.alias("status"))


def one_match(rows: DataFrame, column: str, part: str) -> DataFrame:
    """The single row whose column holds ``part``; none or several are an error, told by at most two rows."""
    found = rows.where(F.col(column).contains(part)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} row has {part!r} in {column}")
    return rows.sparkSession.createDataFrame(found, rows.schema)


def top_jobs(path: Column, parent: Column, owner: str) -> Column:
    """Jobs of an owner that have no parent and lie directly below the owner's folder."""
    return path.like(f"/{owner}/%") & F.coalesce(parent == "", F.lit(True)) & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= 2)


def interesting(ready: Column, status: Column) -> Column:
    """Pools that have something ready or are in any state but available."""
    return (ready > 0) | (status != "available")
