"""SQLite source and sink, listings that are split, integrity of damaged files, reports, versions, losses in one pass."""

import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.vocabulary import Vocabulary
from lattica.operators import evaluation, lmq, patches, series, telemetry
from lattica.sources import listings, sqlite, tables


@pytest.fixture
def database(tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute('CREATE TABLE mats ("mp id" TEXT, n INTEGER, x REAL, raw BLOB)')
        db.executemany("INSERT INTO mats VALUES (?, ?, ?, ?)", [(f"mp-{i}", None if i % 10 == 9 else i, i / 4, bytes([i])) for i in range(100)])
        db.execute("CREATE TABLE lone (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO lone VALUES (?, ?)", [("a", 1), ("b", None)])
        db.execute("CREATE TABLE empty (k TEXT)")
    return str(tmp_path / "a.db")


def test_sqlite_types_ranges_and_empty_tables(spark, database):
    df = sqlite.read_table(spark, database, "mats", rows=30)
    assert df.rdd.getNumPartitions() == 4 and [t for _, t in df.dtypes] == ["string", "bigint", "double", "binary"]
    got = {r["mp id"]: r for r in df.collect()}
    assert len(got) == 100 and got["mp-8"].n == 8 and got["mp-9"].n is None and got["mp-9"].x == 2.25 and got["mp-3"].raw == b"\x03"
    assert {tuple(r) for r in sqlite.read_table(spark, database, "lone").collect()} == {("a", 1), ("b", None)}
    assert sqlite.read_table(spark, database, "empty").count() == 0 and sqlite.read_table(spark, database, "mats").count() == 100
    with pytest.raises(Exception, match="no table"):
        sqlite.read_table(spark, database, "absent")


def test_sqlite_answers_conditions(spark, database):
    fields = "`mp id` string, n long, x double"
    every = sqlite.read_table(spark, database, "mats", fields, rows=30)
    for cond in ["n > 20 and n <= 40", "n is null", '"mp id" = \'mp-7\'', "n in (1, 2, 99)", "n = 1 or x > 20"]:
        got = sqlite.read_table(spark, database, "mats", fields, cond, rows=30)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in every.where(cond.replace('"', "`")).collect()}, cond
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [every.where(c).count() for c in ("n > 20", "n = 1 or x > 20", "x >= 0")] == [71, 20, 100]  # no filter outlives its query


def test_sqlite_writer_shows_nothing_of_a_failed_job(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") / 2).alias("half"), F.concat(F.lit("k'\""), F.col("id").cast("string")).alias("name"))
    sqlite.write_table(rows.repartition(3), path, "t")
    assert len(sqlite.databases(path)) == 3
    assert sorted(map(tuple, sqlite.read_table(spark, path, "t").collect())) == sorted(map(tuple, rows.collect()))
    bad = rows.repartition(3).withColumn("half", F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("half")))
    with pytest.raises(Exception, match="broken"):
        sqlite.write_table(bad, path, "t")
    assert len(sqlite.databases(path)) == 3
    with pytest.raises(ValueError, match="mounted"):
        sqlite.databases("s3://bucket/x")


def test_listing_of_many_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "ids").write_text("\n".join(["", *(f" mp-{i} " if i % 7 else "  " for i in range(5000))]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = listings.read_ids(spark, str(tmp_path / "ids")).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == list(enumerate(f"mp-{i}" for i in range(5000) if i % 7))
    (tmp_path / "none").write_text("\n \n")
    assert listings.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_damaged_row_groups_are_counted(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": np.random.default_rng(1).random(3000)}), tmp_path / "a.parquet", row_group_size=1000, compression="zstd")
    body = bytearray((tmp_path / "a.parquet").read_bytes())
    start = pq.ParquetFile(tmp_path / "a.parquet").metadata.row_group(1).column(0).dictionary_page_offset
    body[start : start + 400] = b"\xff" * 400
    (tmp_path / "b.parquet").write_bytes(body)
    (tmp_path / "c.parquet").write_bytes(b"")
    got = {r.path: r for r in series.parquet_integrity(spark, str(tmp_path)).collect()}
    assert (got["a.parquet"].row_groups, got["a.parquet"].rows, got["a.parquet"].bad_groups, got["a.parquet"].error) == (3, 3000, 0, None)
    assert (got["b.parquet"].row_groups, got["b.parquet"].rows, got["b.parquet"].bad_groups) == (3, 2000, 1) and got["b.parquet"].error
    assert (got["c.parquet"].row_groups, got["c.parquet"].size) == (0, 0) and got["c.parquet"].error


def test_reports_are_bounded(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert telemetry.markdown(df.orderBy("k")) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError, match="more than 1"):
        telemetry.markdown(df, most=1)


def test_latest_version_is_by_number(spark, tmp_path):
    for v in (2, 10):
        tables.publish(spark.range(1), str(tmp_path), "mats", v)
    assert tables.latest_version(spark, str(tmp_path), "mats") == 10
    os.makedirs(tmp_path / "none")
    with pytest.raises(ValueError, match="never published"):
        tables.latest_version(spark, str(tmp_path), "none")


def test_codec_archive_round_trip(tmp_path):
    codec = lmq.LloydMax([1.0, 2.0, 2.0], [0.5, 1.5, 2.0, 3.5], 9.0)
    listings.write_codec(codec, str(tmp_path / "deep" / "codec.npz"))
    assert listings.read_codec(str(tmp_path / "deep" / "codec.npz")) == codec


def test_faults_of_ball_rows(spark):
    v = Vocabulary.ball()
    row = spark.createDataFrame([(1, [8, 8, 8], [6], [0.1, 0.2, 0.3], 5, [1, 2, 3], [0, 1, 2, 3, 4, 5], [1.0, -2.0])], "task_id long, grid array<int>, atoms array<int>, coords array<double>, r2_max int, center array<int>, bounds array<int>, patch array<double>")
    ids = patches.tokenize_ball(row, v).first().input_ids
    at = {n: ids.index(v.special(n)) for n in ("ATOMS_START", "RADIUS_START", "DENS_END", "CENTER_START")}
    cases = {"no BOS": ids[1:], "no EOS": ids[:-1], "density": ids[: at["DENS_END"]] + ids[at["DENS_END"] + 1 :], "radius": ids[: at["RADIUS_START"] + 1] + ids[at["RADIUS_START"] + 2 :], "center": ids[: at["CENTER_START"] + 1] + ids[at["CENTER_START"] + 2 :]}
    rows = spark.createDataFrame([*cases.items(), (None, ids + [0, 0]), ("no BOS", []), ("no BOS", None)], "want string, input_ids array<int>")
    assert [(r.want, r.error) for r in patches.detokenize_ball(rows, v).collect() if r.want != r.error] == []


def test_losses_of_one_pass_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    logit = rng.normal(size=(6, 5)) * 3
    token = [1, 4, 2, 0, 3, 2]
    logits = spark.createDataFrame([(0, p, t, float(logit[p, t])) for p in range(6) for t in range(5)], "s int, pos int, token int, logit double")
    tokens = spark.createDataFrame([(0, p, t, None if p % 2 else 0.5) for p, t in enumerate(token)], "s int, pos int, token int, weight double")
    value = np.array([9.0, 0.0, 0.5, 1.0, 9.0])
    got = {r.pos: r for r in evaluation.position_losses(logits, tokens, ["s"], lambda b: b * 0.5, 1, 3, 9.0).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for p, r in got.items():
        q, target = np.exp(logit[p]) / np.exp(logit[p]).sum(), token[p + 1]
        want = (-np.log(q[target]), abs(q @ value - value[target]), q @ abs(value - value[target]))
        assert np.allclose((r.ce, r.l1, r.emd), want) and r.dense == (1 <= target < 4) and r.weight == (1.0 if p % 2 else 0.5)
    loss = evaluation.density_aware_loss(logits, tokens, ["s"], lambda b: b * 0.5, 1, 3, weight=0.7, penalty=9.0, mode="replace", kind="emd").first()
    want = sum(r.weight * (0.7 * r.emd if r.dense else r.ce) for r in got.values()) / sum(r.weight for r in got.values())
    assert np.isclose(loss.loss, want) and loss.positions == 5
    with pytest.raises(ValueError, match="mode"):
        evaluation.mean_loss(factor=1.0, mode="other")
