"""Array groups as a data source: both formats, attributes, pruning, patches that open only their chunks."""

import json
import shutil

import numpy as np
import pytest
from pyarrow import fs

from lattica.sources import arrays


def group(path, grid, chunk, attributes, **options):
    arrays.write_group(fs.LocalFileSystem(), str(path), grid, chunk, attributes, **options)


@pytest.fixture
def grid():
    return np.random.default_rng(0).uniform(0.01, 1, (9, 12, 20)).astype(np.float32)


@pytest.mark.parametrize("version,codec", [(2, "zstd"), (2, "gzip"), (2, "none"), (3, "zstd"), (3, "gzip"), (3, "none")])
def test_formats(spark, tmp_path, grid, version, codec):
    group(tmp_path / "a" / "m1.zarr", grid, (4, 5, 20), {"structure": json.dumps({"k": 1}), "metadata": json.dumps({"task_id": "mp-1"})}, version=version, codec=codec)
    group(tmp_path / "m2.zarr", grid[:3, :4, :5], (3, 4, 5), {"structure": {"k": 2}, "metadata": {"other": 1}}, version=version, codec=codec)
    group(tmp_path / "m3.zarr", grid[:1, :1, :1], (1, 1, 1), {}, version=version, codec=codec)
    got = {r.task_id: r for r in arrays.read_groups(spark, str(tmp_path)).collect()}
    assert set(got) == {"mp-1", "m2", "m3"} and all(r.error is None for r in got.values())
    assert np.array_equal(np.array(got["mp-1"].density).reshape(grid.shape), grid.astype(float)) and (got["mp-1"].nx, got["mp-1"].ny, got["mp-1"].nz) == grid.shape
    assert json.loads(got["mp-1"].structure) == {"k": 1} and json.loads(got["m2"].structure) == {"k": 2} and got["m3"].structure is None
    assert {r.task_id: r.grid for r in arrays.density_view(arrays.read_groups(spark, str(tmp_path))).collect()}["m2"] == [3, 4, 5]


def test_missing_chunks_and_damage(spark, tmp_path, grid):
    group(tmp_path / "hole.zarr", grid, (4, 5, 20), {})
    (tmp_path / "hole.zarr" / arrays.TOTAL / "c" / "0" / "0" / "0").unlink()
    group(tmp_path / "bad.zarr", grid, (4, 5, 20), {})
    (tmp_path / "bad.zarr" / arrays.TOTAL / "c" / "1" / "1" / "0").write_bytes(b"junk")
    group(tmp_path / "none.zarr", grid, (4, 5, 20), {})
    shutil.rmtree(tmp_path / "none.zarr" / arrays.TOTAL)
    (tmp_path / "void.zarr").mkdir()
    got = {r.task_id: r for r in arrays.read_groups(spark, str(tmp_path)).collect()}
    want = grid.astype(float)
    want[:4, :5] = 0
    assert np.array_equal(np.array(got["hole"].density).reshape(grid.shape), want)
    assert all(got[k].error and got[k].density is None for k in ("bad", "none", "void"))
    assert arrays.read_groups(spark, str(tmp_path), "task_id string").count() == 4


def test_ids_and_pruning(spark, tmp_path, grid):
    for i in range(4):
        group(tmp_path / f"g{i}.zarr", grid, (4, 5, 20), {"metadata": {"task_id": f"mp-{i}"}})
    (tmp_path / "g2.zarr" / arrays.TOTAL / "c" / "1" / "1" / "0").write_bytes(b"junk")
    wanted = arrays.read_groups(spark, str(tmp_path), ids=["mp-1", "mp-3"])
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchScan array_groups" in plan
    assert sorted(r.task_id for r in wanted.collect()) == ["mp-1", "mp-3"] and wanted.rdd.getNumPartitions() == 4
    names = arrays.read_groups(spark, str(tmp_path), "task_id string, chunks_read int, nx int", groups=3)
    assert {(r.chunks_read, r.nx) for r in names.collect()} == {(0, 9)} and names.rdd.getNumPartitions() == 2  # the damaged chunk is never opened
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [names.where(c).count() for c in ("task_id = 'mp-0' and nx > 100", "task_id = 'mp-0'", "nx > 1 or task_id = 'x'", "true")] == [0, 1, 4, 4]  # no filter outlives its query
    assert arrays.read_groups(spark, str(tmp_path), "task_id string", ids=[]).count() == 0


def test_a_patch_opens_only_its_chunks(spark, tmp_path, grid):
    path = tmp_path / "p.zarr"
    group(path, grid, (3, 4, 5), {})
    kept = {(0, 0, 3), (2, 0, 3), (0, 2, 3), (2, 2, 3), (0, 0, 0), (2, 0, 0), (0, 2, 0), (2, 2, 0)}
    for place in np.ndindex(3, 3, 4):
        if place not in kept:
            (path / arrays.TOTAL / "c" / "/".join(map(str, place))).write_bytes(b"junk")
    want = grid.astype(float)[np.ix_(*(np.arange(o, o + 4) % n for o, n in zip((7, 10, 18), grid.shape, strict=True)))].ravel()
    row = arrays.read_groups(spark, str(tmp_path), offset="7,10,18", size="4,4,4").first()
    assert row.error is None and row.chunks_read == 8 and np.array_equal(row.density, want)
    asked = spark.createDataFrame([(str(path), [7, 10, 18]), (str(path), [8, 11, 19])], "path string, offset array<int>")
    got = {tuple(r.offset): r for r in arrays.read_patches(asked, 4).collect()}
    assert np.array_equal(got[7, 10, 18].patch, want) and got[8, 11, 19].chunks_read == 8


def test_bricks_of_a_group(spark, tmp_path, grid):
    group(tmp_path / "b.zarr", grid, (3, 4, 5), {})
    bricks = arrays.read_groups(spark, str(tmp_path), brick=8)
    back = np.zeros(grid.shape)
    for r in bricks.collect():
        back[r.x0 : r.x0 + r.sx, r.y0 : r.y0 + r.sy, r.z0 : r.z0 + r.sz] = np.array(r.density).reshape(r.sx, r.sy, r.sz)
    assert np.array_equal(back, grid.astype(float)) and bricks.rdd.getNumPartitions() == 2 * 2 * 3


def test_write_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", 2, 3, 4, [float(i + j) for j in range(24)], '{"a": 1}', None) for i in range(5)], "task_id string, nx int, ny int, nz int, density array<double>, structure string, metadata string")
    for version in (2, 3):
        arrays.write_groups(rows, str(tmp_path / str(version)), version=version, chunk="2,2,3")
        arrays.write_groups(rows, str(tmp_path / str(version)), version=version, chunk="2,2,3")  # again: the same files
        got = {r.task_id: (r.density, r.structure, r.chunks_read) for r in arrays.read_groups(spark, str(tmp_path / str(version))).collect()}
        assert got == {r.task_id: (r.density, r.structure, 4) for r in rows.collect()}
