"""Crowded signatures: every two different intervals meet, as without blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import compactwindows


@pytest.mark.parametrize("crowd", [8192, 20, 3])
def test_near_intervals_of_a_crowd_all_meet(spark, monkeypatch, crowd):
    """Pairs of one signature that differ in 5 of 46 tokens, with 30 copies of one interval among them."""
    monkeypatch.setattr(compactwindows, "CROWD", crowd)
    rng, rows = np.random.default_rng(4), []
    pack = lambda t: t.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    for i in range(40):
        a = rng.integers(0, 1 << 24, 46)
        a[20] = 5
        b = a.copy()
        b[30:35] = rng.integers(0, 1 << 24, 5)
        rows += [(9, 1000 + i, 50, -20, pack(a)), (9, 2000 + i, 70, -20, pack(b))]
    rows += [(9, 3000 + i, 50, -20, rows[0][4]) for i in range(30)]
    each = spark.createDataFrame(rows, "key long, doc long, at int, low int, tokens binary").withColumn("name", F.xxhash64("key", "low", "tokens"))
    found = compactwindows._crowded(each, 50, 5, 0.8).collect()
    label = {d: d for _, d, *_ in rows}
    names = {r.b for r in found if r.kind == 0} | {r.a for r in found if r.kind == 0}
    label |= {n: n for n in names}
    for _ in range(4):
        for r in found:
            if r.kind == 0:
                low = min(label[r.a], label[r.b])
                label = {n: low if v in (label[r.a], label[r.b]) else v for n, v in label.items()}
    assert all(label[1000 + i] == label[2000 + i] for i in range(40)) and len({label[1000 + i] for i in range(40)}) == 40
    assert {label[3000 + i] for i in range(30)} == {label[1000]}
    spans = {(r.a, r.start, r.end) for r in found if r.kind == 1}
    assert spans == {(d, at - 20, at + 30) for _, d, at, *_ in rows}


def test_shared_tells_crowds(spark, monkeypatch):
    monkeypatch.setattr(compactwindows, "CROWD", 5)
    rows = [(8, d, a) for d in range(4) for a in range(3)] + [(16, d, 0) for d in range(10)] + [(24, 1, a) for a in range(30)] + [(32, 1, 0), (32, 1, 0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = compactwindows.shared(spark.createDataFrame(rows, compactwindows.WINDOWS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.key, r.doc, r.at, r.crowd) for r in got) == sorted((k, d, a, k == 8) for k, d, a in rows if k in (8, 16))


def test_differences_at_both_edges_among_many_like_rows():
    """Each row is a window of one text whose first two and last three tokens differ."""
    width, need, rng = 46, 41, np.random.default_rng(4)
    base = rng.integers(0, 1 << 24, width).astype(np.uint32)
    rows = [base.copy() for _ in range(40)]
    for r in rows:
        r[[0, 1, 43, 44, 45]] = rng.integers(0, 1 << 24, 5)
    n = len(rows)
    x, y, matched = compactwindows.match(np.zeros(n, np.int64), np.arange(n), np.full(n, -20, np.int32), rows, width, need)[:3]
    label = compactwindows.contract(np.arange(n), x, y)
    assert (label == 0).all() and matched.any(axis=1).all()
