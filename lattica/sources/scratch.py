"""Where results that must outlive a stage are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that what was decided by sampling is decided once."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(new_path(rows.sparkSession, "checkpoint"))
    return rows.checkpoint(eager=True)


def rename_only_file(spark: SparkSession, folder: str, suffix: str, target: str) -> None:
    """Give the one file of a folder that ends in ``suffix`` a name of its own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(folder).getFileSystem(conf)
    (found,) = [f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().endswith(suffix)]
    fs.mkdirs(path(target).getParent())
    fs.rename(found, path(target))
