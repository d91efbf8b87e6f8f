"""Electron configurations, baselines in array form, and cutoffs of large grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import grids, promolecules, transforms

CONFIGURATIONS = {
    24: "3d5 4s1", 26: "3d6 4s2", 29: "3d10 4s1", 41: "4d4 5s1", 42: "4d5 5s1", 44: "4d7 5s1", 45: "4d8 5s1", 46: "4d10", 47: "4d10 5s1", 57: "5d1 6s2", 58: "4f1 5d1 6s2", 64: "4f7 5d1 6s2",
    78: "4f14 5d9 6s1", 79: "4f14 5d10 6s1", 80: "4f14 5d10 6s2", 90: "6d2 7s2", 92: "5f3 6d1 7s2", 103: "5f14 7s2 7p1", 118: "5f14 6d10 7s2 7p6",
}


def test_configurations(spark):
    rows = promolecules.shells(spark).collect()
    held = {(r.z, f"{r.n}{'spdf'[r.l]}"): r.electrons for r in rows}
    for z, named in CONFIGURATIONS.items():
        for part in named.split():
            assert held[z, part[:2]] == int(part[2:]), (z, part)
    assert all(sum(r.electrons for r in rows if r.z == z) == z for z in range(1, 119))
    assert (46, "5s") not in held and (57, "4f") not in held


@pytest.mark.parametrize("model", [promolecules.Gaussian(), promolecules.Slater(), promolecules.MultiShell(), promolecules.MultiShell(valence_only=False)])
def test_packed_and_voxel_baselines_agree(spark, model):
    cell = F.array(*[F.array(*map(F.lit, row)) for row in [[4.0, 0.0, 0.0], [0.5, 4.0, 0.0], [0.2, 0.3, 4.5]]])
    packed = spark.createDataFrame([(i, 3, 4, 5, [float(v) for v in range(60)]) for i in range(3)], "task_id long, nx int, ny int, nz int, density array<double>").withColumn("cell", cell)
    atoms = spark.createDataFrame([(0, 29, 0.1, 0.9, 0.5), (0, 1, 0.0, 0.0, 0.0), (1, 46, 0.3, 0.3, 0.3)], "task_id long, z int, fx double, fy double, fz double")
    one = {r.task_id: r.baseline for r in promolecules.packed_baseline(packed, atoms, model).collect()}
    many = promolecules.baseline(grids.unpack(packed), atoms, packed.select("task_id", "nx", "ny", "nz", "cell"), model).collect()
    assert one[2] == [0.0] * 60 and len(many) == 120
    assert all(one[r.task_id][r.flat] == pytest.approx(r.baseline, rel=1e-9) for r in many)


def test_cutoff_of_grids_of_many_sizes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, *s, [float(v) for v in rng.integers(-9, 9, s[0] * s[1] * s[2])]) for i, s in enumerate([(1, 1, 1), (40, 30, 20), (3, 5, 2), (24, 24, 24), (2, 2, 2)])]
    packed = spark.createDataFrame(rows, "task_id int, nx int, ny int, nz int, density array<double>").coalesce(1)
    monkeypatch.setattr(transforms, "VOXELS", 1000)
    for r in transforms.round_trip(transforms.Cutoff(0.25), packed).collect():
        d = np.array(r.density)
        kept = np.lexsort((np.arange(len(d)), -d))[: max(1, int(np.rint(len(d) * 0.25)))]
        want = np.zeros(len(d))
        want[kept] = d[kept]
        assert r.approx == want.tolist()


def test_few_grids_at_a_time_are_python_objects(spark, monkeypatch):
    """The sums that a task holds while it works do not grow with the rows of a batch."""

    class Held(promolecules.Gaussian):
        def sample(self, r, atom):
            import sys

            return np.full(r.shape, float(len(sys._getframe(1).f_locals["found"])))

    monkeypatch.setattr(promolecules, "SLICE", 1 << 13, raising=False)
    packed = spark.range(2000).coalesce(1).selectExpr("id AS task_id", "4 AS nx", "4 AS ny", "4 AS nz", "transform(sequence(1, 64), x -> double(x)) AS density").withColumn("cell", promolecules.cube(4.0))
    atoms = packed.selectExpr("task_id", "6 AS z", "0.5D AS fx", "0.5D AS fy", "0.5D AS fz")
    rows = promolecules.packed_baseline(packed, atoms, Held())
    n, most, sizes = rows.agg(F.count("*"), F.max(F.array_max("baseline")), F.min(F.size("baseline"))).first()
    assert n == 2000 and most < 100 and sizes == 64
