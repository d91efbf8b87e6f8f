"""Files that show only with their manifest."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.sources import manifested

SCHEMA = "id long, v double"


def frame(spark, n=1000):
    return spark.range(n).select(F.col("id"), (F.col("id") * 0.5).alias("v"))


def test_manifest_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    manifested.write_sorted(frame(spark).repartition(7), path, "id", reject=F.col("id") % 10 == 3)
    about = manifested.manifest(spark, path).first()
    assert (about.rows, about.first, about.last, about.rejects) == (900, 0, 999, 100) and list(about.reject_ids) == list(range(3, 503, 10))
    assert [f.first for f in about.files] == sorted(f.first for f in about.files) and sum(f.rows for f in about.files) == 900
    assert all(a.last < b.first for a, b in zip(about.files, about.files[1:]))
    back = manifested.read_sorted(spark, path, frame(spark).schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame(spark).where("id % 10 <> 3").collect()))
    assert not [f for f in os.listdir(path) if f.startswith("_pending")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    manifested.write_sorted(frame(spark, 50), path, "id")
    before = sorted(os.listdir(path))
    broken = frame(spark).withColumn("v", F.when(F.col("id") == 700, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        manifested.write_sorted(broken, path, "id")
    assert sorted(os.listdir(path)) == before and manifested.read_sorted(spark, path, frame(spark).schema).count() == 50
    # A file that no manifest names, as a lost task may leave, is not read.
    (tmp_path / "t" / "part-999999-1.parquet").write_bytes(b"junk")
    assert manifested.read_sorted(spark, path, frame(spark).schema).count() == 50


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    assert manifested.read_sorted(spark, path, frame(spark).schema).count() == 0
    manifested.write_sorted(frame(spark, 0), path, "id")
    assert manifested.read_sorted(spark, path, frame(spark).schema).count() == 0 and manifested.manifest(spark, path).first().rows == 0
