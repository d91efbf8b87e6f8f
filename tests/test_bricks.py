"""Bricks with halos and pencil transforms against the same work on whole grids."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import bricks, grids, patches, pencils, transforms

SHAPES = [(5, 7, 9), (4, 4, 4), (8, 6, 3), (1, 2, 11)]


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i}", *s, rng.normal(size=s).ravel().tolist()) for i, s in enumerate(SHAPES)]
    return spark.createDataFrame(rows, "task_id string, nx int, ny int, nz int, density array<double>")


def arrays_of(rows, column="density"):
    return {r.task_id: np.array(r[column]).reshape(r.nx, r.ny, r.nz) for r in rows.collect()}


@pytest.mark.parametrize("side", [2, 3, 16])
def test_there_and_back(packed, side):
    want = arrays_of(packed)
    parts = bricks.from_packed(packed, side)
    for made in (parts, bricks.from_voxels(grids.unpack(packed), packed.select("task_id", "nx", "ny", "nz"), side)):
        assert all(np.array_equal(want[k], v) for k, v in arrays_of(bricks.to_packed(made)).items())
    assert parts.agg(F.max(F.size("brick"))).first()[0] <= side**3


@pytest.mark.parametrize("low,high", [(0, 1), (2, 3), (0, 13)])
def test_halos_wrap(packed, low, high):
    want = arrays_of(packed)
    for r in bricks.with_halo(bricks.from_packed(packed, 3), low, high).collect():
        own = bricks.sides((r.nx, r.ny, r.nz), 3, (r.bx, r.by, r.bz))
        index = np.ix_(*(np.arange(3 * b - low, 3 * b + s + high) % n for b, s, n in zip((r.bx, r.by, r.bz), own, (r.nx, r.ny, r.nz), strict=True)))
        assert np.array_equal(np.array(r.halo), want[r.task_id][index].ravel())


def test_patches_equal_those_of_rows(spark, packed, monkeypatch):
    monkeypatch.setattr(bricks, "TOGETHER", 3)
    asked = patches.random_offsets(packed.withColumn("grid", F.array("nx", "ny", "nz")), 20, seed=3)
    corners = asked.select("task_id", "k", *(F.get("offset", F.lit(i)).alias(f"o{a}") for i, a in enumerate("xyz")))
    got = {(r.task_id, r.k): r.patch for r in bricks.cut(bricks.from_packed(packed, 3), corners, 4).collect()}
    assert got == {(r.task_id, r.k): r.patch for r in patches.extract(asked, 4).collect()} and len(got) == 80


@pytest.mark.parametrize("side", [2, 4, 5])
def test_tiles_stitch_back(packed, side):
    some = packed.where("nx >= 3 and nz >= 3")
    tiles = bricks.tiled(bricks.from_packed(some, side), 3)
    back = bricks.stitched(tiles, 3, side)
    want = arrays_of(some)
    got = arrays_of(bricks.to_packed(back))
    assert set(got) == set(want) and all(np.array_equal(want[k], got[k]) for k in want)
    assert back.agg(F.max(F.size("brick"))).first()[0] <= side**3


def test_pooling(spark, packed):
    even = packed.where("task_id = 'g1'")
    down = bricks.pool(bricks.from_packed(even, 2), 2)
    want = arrays_of(even)["g1"].reshape(2, 2, 2, 2, 2, 2).mean((1, 3, 5))
    assert np.allclose(arrays_of(bricks.to_packed(down))["g1"], want)
    up = arrays_of(bricks.to_packed(bricks.upsample(down, 2)))["g1"]
    assert np.allclose(up, want.repeat(2, 0).repeat(2, 1).repeat(2, 2))
    error = bricks.relative_error(bricks.from_packed(even, 2), bricks.upsample(down, 2)).first().nmae
    full = arrays_of(even)["g1"]
    assert error == pytest.approx(np.abs(full - up).sum() / np.abs(full).sum())
    with pytest.raises(Exception, match="divide"):
        bricks.pool(bricks.from_packed(packed, 2), 2).collect()


@pytest.mark.parametrize("side", [2, 3, 16])
def test_pencils_equal_whole_transforms(packed, side):
    want = arrays_of(packed)
    spectra = pencils.spectrum(bricks.from_packed(packed, side))
    for r in spectra.collect():
        full = np.fft.rfftn(want[r.task_id])
        part = full[tuple(slice(side * b, side * (b + 1)) for b in (r.bx, r.by, r.bz))]
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), part.ravel(), atol=1e-9)
    back = arrays_of(bricks.to_packed(pencils.inverse(spectra)))
    assert all(np.allclose(back[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("fraction", [0.02, 0.25, 0.6, 1.0])
def test_lowpass_equals_the_row_form(packed, fraction):
    row = arrays_of(transforms.round_trip(transforms.Fourier(fraction), packed), "approx")
    got = arrays_of(bricks.to_packed(pencils.lowpass(bricks.from_packed(packed, 3), fraction)))
    assert all(np.allclose(got[k], row[k], atol=1e-6) for k in row)
    for k, v in arrays_of(packed).items():
        full = np.fft.rfftn(v)
        g = [np.fft.fftfreq(n, 1 / n) for n in v.shape[:2]] + [np.arange(v.shape[2] // 2 + 1)]
        order = np.argsort((g[0][:, None, None] ** 2 + g[1][:, None] ** 2 + g[2] ** 2).ravel(), kind="stable")
        kept = np.zeros(full.size, complex)
        top = order[: max(1, min(len(order), round(len(order) * fraction)))]
        kept[top] = full.ravel()[top]
        want = np.fft.irfftn(kept.reshape(full.shape), v.shape, axes=(0, 1, 2))
        assert np.allclose(arrays_of(bricks.to_packed(pencils.lowpass(bricks.from_packed(packed.where(F.col("task_id") == k), 3), fraction, single=False)))[k], want, atol=1e-9)


def test_a_grid_of_128_cubed(spark):
    n, side, p = 128, 32, 14
    at = spark.range(n**3).select(F.lit("big").alias("task_id"), *((F.floor(F.col("id") / n**k) % n).alias(f"i{a}") for k, a in ((2, "x"), (1, "y"), (0, "z"))), (F.col("id") * 7919 % 10007 / 10007).alias("rho"))
    sizes = spark.createDataFrame([("big", n, n, n)], "task_id string, nx int, ny int, nz int")
    made = bricks.from_voxels(at, sizes, side)
    made.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/bricks128")
    held = spark.read.parquet(path)
    whole = (np.arange(n**3, dtype=np.int64) * 7919 % 10007 / 10007).reshape(n, n, n)
    corners = spark.createDataFrame([("big", i, *o) for i, o in enumerate(itertools.product((0, 31, 120), repeat=3))], "task_id string, k int, ox int, oy int, oz int")
    for r in bricks.cut(held, corners, p).collect():
        index = np.ix_(*(np.arange(o, o + p) % n for o in (r.ox, r.oy, r.oz)))
        assert np.array_equal(np.reshape(r.patch, (p, p, p)), whole[index])
    back = bricks.stitched(bricks.tiled(held, p), p, side)
    assert bricks.relative_error(held, back).first().nmae == 0.0 and back.where("exists(brick, x -> isnan(x))").count() == 0
    pooled = bricks.pool(held, 4)
    assert pooled.agg(F.sum(F.aggregate("brick", F.lit(0.0), lambda s, x: s + x))).first()[0] == pytest.approx(whole.sum() / 64) and pooled.agg(F.max(F.size("brick"))).first()[0] == 512
