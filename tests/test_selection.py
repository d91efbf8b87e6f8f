"""Exact order statistics by narrowing brackets against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import selection

SHARES = [0.0, 0.001, 0.3, 0.5, 0.99, 1.0]


def spread(kind, n, rng):
    if kind == "ties":
        return [float(rng.randrange(3)) for _ in range(n)]
    if kind == "tails":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "one":
        return [2.5] * n
    if kind == "ints":
        return [float(rng.randrange(1000)) for _ in range(n)]
    return [rng.choice([math.inf, -math.inf, 0.0, -0.0, 1e-320]) if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("gather", [40, 10_000])
def test_quantiles_equal_sorting(spark, monkeypatch, gather):
    monkeypatch.setattr(selection, "GATHER", gather)
    monkeypatch.setattr(selection, "POINTS", 8)
    monkeypatch.setattr(selection, "ACCURACY", 40)
    rng = random.Random(3)
    groups = {None: spread("ints", 700, rng), "a": spread("ties", 900, rng), "b": spread("tails", 800, rng), "c": spread("one", 500, rng), "d": [7.0], "e": [1.0, 2.0], "f": spread("ends", 600, rng)}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("d", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    ranks = [(k, r) for k, values in groups.items() for r in {0, len(values) // 3, len(values) - 1}]
    got = {(r.k, r["rank"]): r.value for r in selection.order_statistics(df, ["k"], "v", spark.createDataFrame([*ranks, ("d", 5), ("none", 0)], "k string, rank long")).collect()}
    assert got == {(k, r): sorted(groups[k])[r] for k, r in ranks}
    finite = df.where("k is null or k <> 'f'")
    found = {(r.k, r.q): r.value for r in selection.quantiles(finite, ["k"], "v", SHARES).collect()}
    want = {(k, q): float(np.quantile(values, q)) for k, values in groups.items() if k != "f" for q in SHARES}
    assert found.keys() == want.keys()
    for key, value in want.items():
        assert found[key] == pytest.approx(value, rel=1e-9, abs=1e-300)


def test_no_keys_and_no_rows(spark):
    df = spark.range(1001).select((F.col("id") * 37 % 1001).cast("double").alias("v"))
    assert {r.q: r.value for r in selection.quantiles(df, [], "v", [0.25, 0.5]).collect()} == {0.25: 250.0, 0.5: 500.0}
    assert selection.quantiles(df.where("v < 0"), [], "v", [0.5]).count() == 0


def test_what_tasks_send_on_is_bounded(spark, monkeypatch):
    """However many values a group has, a task sends a sketch or counts, and an interval that may be sorted."""
    monkeypatch.setattr(selection, "GATHER", 100)
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("v")).repartition(8)
    got = {(r.k, r.q): r.value for r in selection.quantiles(df, ["k"], "v", [0.5]).collect()}
    want = {(r.k, 0.5): r.m for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert got == want
