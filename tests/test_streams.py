"""Polls in event order across triggers, and snapshots that survive a stop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lattica.streaming import counters, ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def loop(rows):
    out, runs = {}, {}
    for event, ts, user, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if value is not None:
            runs.setdefault(user, []).append((ts, event, value))
    for user, polls in runs.items():
        for i, (ts, event, value) in enumerate(polls):
            hours = (ts - polls[0][0]).total_seconds() / 3600
            out[user, event] = (i + 1, value, max(0.0, value - polls[max(i - 1, 0)][2]), value / hours if hours * 60 > 0.5 else 0.0)
    return out


def test_polls_crossed_between_triggers(spark, tmp_path):
    rng = random.Random(1)
    hour = lambda h: START + dt.timedelta(hours=h)
    first = [(1, hour(0), 7, 10.0), (2, hour(2), 7, 30.0)]
    second = [(3, hour(1), 7, 20.0), (4, hour(1), 8, 5.0), (5, hour(3), 7, None)]
    batches = [first, second]
    for b in range(3):
        batches.append([(100 * b + 10 + i, hour(4 + 6 * b + rng.uniform(0, 9)), rng.randrange(3), float(rng.randrange(100))) for i in range(30)])
    for rows in batches:
        write(spark, rows, str(tmp_path / "in"))
    write(spark, [(9999, hour(1000), -1, 0.0)], str(tmp_path / "in"))  # moves the watermark past all others
    out = counters.run_to_table(ordered.ordered_deltas(read(spark, str(tmp_path / "in")), "12 hours"), "append", "ordered")
    got = {(r.user_id, r.event_id): (r.poll, r.total, r.delta, pytest.approx(r.per_hour)) for r in out.collect()}
    assert got == loop([r for rows in batches for r in rows])
    assert got[7, 2][:3] == (3, 30.0, 10.0) and got[7, 3][:3] == (2, 20.0, 10.0)


def test_snapshot_survives_a_stop(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "table")
    batches = [[(10 * b + i, START + dt.timedelta(hours=b), i % 4, float(b)) for i in range(6)] for b in range(3)]
    for rows in batches[:2]:
        write(spark, rows, folder)
    ordered.merge_batches(read(spark, folder), path, ["user_id"], "event_id")
    files = ordered.Versions(spark, path)
    once = sorted(map(tuple, files.read().collect()))
    # A stop after the merge and before the stream's own commit: the batch is run again.
    last = files.complete()[-1]
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "table" / "state" / "commits" / name).unlink(missing_ok=True)
    ordered.merge_batches(read(spark, folder), path, ["user_id"], "event_id")
    assert files.complete()[-1] == last and sorted(map(tuple, files.read().collect())) == once
    # A stop within the merge: the version is not whole, and the batch is run again.
    (tmp_path / "table" / f"version-{last:012d}" / "_SUCCESS").unlink()
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "table" / "state" / "commits" / name).unlink(missing_ok=True)
    ordered.merge_batches(read(spark, folder), path, ["user_id"], "event_id")
    assert sorted(map(tuple, files.read().collect())) == once
    write(spark, batches[2], folder)
    ordered.merge_batches(read(spark, folder), path, ["user_id"], "event_id")
    want = {}
    for row in sorted(r for rows in batches for r in rows):
        want[row[2]] = row
    assert sorted(map(tuple, files.read().collect())) == sorted(want.values()) and len(files.complete()) <= 3


def test_runs_share_state(spark, tmp_path, monkeypatch):
    """Many runs make few calls to the state: the groups of state are at most ``PARTS``, and one of runs without an id."""
    monkeypatch.setattr(ordered, "PARTS", 2)
    rows = [(i, START + dt.timedelta(hours=i % 7), i % 50 if i % 50 else None, float(i % 11)) for i in range(500)]
    write(spark, rows[:300], str(tmp_path / "in"))
    write(spark, rows[300:], str(tmp_path / "in"))
    write(spark, [(9999, START + dt.timedelta(hours=1000), -1, 0.0)], str(tmp_path / "in"))
    out = counters.run_to_table(ordered.ordered_deltas(read(spark, str(tmp_path / "in")), "12 hours"), "append", "ordered")
    got = {(r.user_id, r.event_id): (r.poll, r.total, r.delta, pytest.approx(r.per_hour)) for r in out.collect()}
    assert got == loop(rows)
