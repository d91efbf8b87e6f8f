"""Running values over ranges against plain loops, with a series that fills many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import scans, series, telemetry


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(3000):
        run = rng.choice(["hot", "hot", "hot", "a", "b", None, f"r{rng.randrange(40)}"])
        out.append((run, rng.randrange(400), i, rng.choice([None, rng.randrange(50), rng.randrange(50)]), rng.random() < 0.2))
    return out


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges are not put together here, as they would be on so few rows."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def df(spark, rows, many_ranges):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "run string, ts long, id long, v long, flag boolean").repartition(5)


def by_run(rows):
    held = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        held.setdefault(r[0], []).append(r)
    return held


def test_rules_against_loops(spark, rows, df):
    v = F.col("v")
    rules = {"most": scans.greatest_so_far("run", v), "n": scans.count_so_far("run", F.col("flag")), "known": scans.last_known("run", v), "next": scans.next_known("run", v), "prior": scans.row_before("run", v), "first": scans.first_of("run", F.col("ts"))}
    got = {r.id: (r.most, r.n, r.known, r.next, None if r.prior is None else (r.prior.value,), r.first) for r in scans.scan(df, "run", ["ts", "id"], **rules).collect()}
    want = {}
    for held in by_run(rows).values():
        most = known = prior = None
        n = 0
        for i, (_, _, key, value, flag) in enumerate(held):
            if value is not None:
                most, known = value if most is None else max(most, value), value
            n += flag
            want[key] = (most, n, known, next((x[3] for x in held[i:] if x[3] is not None), None), prior, held[0][1])
            prior = (value,)
    assert got == want


def test_a_hot_series_lies_in_many_ranges(spark, df):
    sizes = [r["count"] for r in df.repartitionByRange("run", "ts", "id").withColumn("p", F.spark_partition_id()).where("run = 'hot'").groupBy("p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) * 0.8


def test_telemetry_and_series(spark, rows, df):
    held = by_run(rows)
    got = {r.id: (r.delta, round(r.hours, 9)) for r in telemetry.poll(df.where("v is not null"), "run", ["ts", "id"], "v").collect()}
    want = {}
    for run in held.values():
        run = [r for r in run if r[3] is not None]
        for before, r in zip([run[0] if run else None, *run], run, strict=False):
            want[r[2]] = (max(0, r[3] - before[3]), round((r[1] - run[0][1]) / 3600, 9))
    assert got == want
    runs = {(r.run, r.id): r.segment for r in series.segments(df, "run", ["ts", "id"], "flag").collect()}
    for name, run in held.items():
        number, last = 0, None
        for r in run:
            number += r[4] != last
            last = r[4]
            assert runs[name, r[2]] == number
    filled = {r.id: r.filled for r in series.fill_gaps(df, "run", "id", "v").collect()}
    for run in held.values():
        known = sorted((r[2], r[3]) for r in run if r[3] is not None)
        for r in run:
            if known and r[3] is None:
                low, high = [k for k in known if k[0] < r[2]][-1:], [k for k in known if k[0] > r[2]][:1]
                value = low[0][1] + (high[0][1] - low[0][1]) * (r[2] - low[0][0]) / (high[0][0] - low[0][0]) if low and high else (low or high)[0][1]
                assert filled[r[2]] == pytest.approx(value)
    assert scans.scan(df.where("id < 0"), "run", ["ts"], n=scans.count_so_far("run", F.lit(True))).count() == 0
