"""Invariants of the operators: round trips, monotony, conservation, validation, edge cases."""

import json
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.functions.quantize import LogCodec
from lattica.functions.vocabulary import Vocabulary
from lattica.operators import etl, evaluation, grids, lmq, materials, order, patches, promolecules, series, telemetry, transforms
from lattica.sources import chgcar, listings, tables, zarr
from lattica.streaming import counters


def bumps(shape=(6, 8, 10), seed=0):
    rng = np.random.default_rng(seed)
    at = np.stack(np.meshgrid(*[np.arange(n) / n for n in shape], indexing="ij"))
    out = np.zeros(shape)
    for _ in range(4):
        c, s = rng.uniform(0.2, 0.8, 3), rng.uniform(0.05, 0.15)
        d = at - c[:, None, None, None]
        d -= np.rint(d)
        out += np.exp(-(d**2).sum(0) / 2 / s**2)
    return out


def packed(spark, *fields):
    rows = [(i, *f.shape, f.ravel().tolist()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "task_id long, nx int, ny int, nz int, density array<double>")


@pytest.mark.parametrize("codec, error", [(LogCodec.three_bytes(-4, 2), 3e-6), (LogCodec.two_tokens(-4, 2), 5e-5), (LogCodec.one_token(-4, 2), 2e-3)])
def test_codec_precision_sign_zero_clamp(spark, codec, error):
    v = [0.0, -0.0, 1e-20, 1e9, -1e9, 1e-9, None, float("nan")] + [float(s * 10**e) for e in np.linspace(-3.9, 1.9, 200) for s in (1, -1)]
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", codec.round_trip(F.col("v")).alias("w"), *[c.alias(f"c{i}") for i, c in enumerate(codec.encode(F.col("v")))])
    got = df.collect()
    assert [r.w for r in got[:3]] == [0.0, 0.0, 0.0] and got[6].w is None and got[7].w is None
    assert math.isclose(got[3].w, 100, rel_tol=1e-9) and math.isclose(got[4].w, -100, rel_tol=1e-9) and got[5].w == 0.0
    for r in got[8:]:
        assert abs(r.w - r.v) <= 1.1 * error * abs(r.v) * math.log(10) * 6 / 5
        assert all(0 <= r[f"c{i}"] < n for i, n in enumerate(codec.vocab_sizes))


def test_codec_configuration_and_bad_arguments():
    c = LogCodec(-4, 2, (8, 12))
    assert LogCodec.from_json(c.to_json()) == c
    assert LogCodec.from_json(json.dumps({"channels": {"density": {"log_min": -3, "log_max": 1}}}), "density").log_min == -3
    for bad in [(-4, 2, ()), (2, 2, (8,))]:
        with pytest.raises(ValueError):
            LogCodec(*bad)


def test_cutoff_monotone_and_equals_lost_mass(spark):
    vox = grids.unpack(packed(spark, bumps())).cache()
    last = 2.0
    for f in (0.01, 0.05, 0.25, 1.0):
        kept = grids.cutoff(vox, fraction=f)
        m, e = grids.mass_captured(kept).first(), grids.error_metrics(kept.select("task_id", "rho", "approx"), ["task_id"]).first()
        assert math.isclose(e.nmae, 1 - m.mass_captured, abs_tol=1e-9) and e.nmae <= last
        last = e.nmae
    assert last == 0 and e.jsd == 0


@pytest.mark.parametrize("bad", [{}, {"k": 1, "fraction": 0.5}, {"fraction": 0.0}, {"fraction": 1.5}, {"k": 0}])
def test_cutoff_validates(spark, bad):
    with pytest.raises(ValueError):
        grids.cutoff(spark.createDataFrame([], "task_id long, flat long, rho double"), **bad)


def test_zero_grid_metrics(spark):
    pairs = spark.createDataFrame([(1, 0.0, 1.0)], "task_id long, rho double, approx double")
    e = grids.error_metrics(pairs, ["task_id"]).first()
    assert e.nmae is None and e.jsd == 0
    with pytest.raises(Exception, match="sums to zero"):
        grids.error_metrics(pairs, ["task_id"], strict=True).collect()


def test_fourier_full_basis_and_monotone(spark):
    g = bumps()
    errors = []
    for f in (0.01, 0.05, 0.25, 1.0):
        r = grids.fourier(packed(spark, g), f).first()
        errors.append(np.abs(np.array(r.approx) - g.ravel()).sum() / g.sum())
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1e-6


def test_dft_matches_numpy(spark):
    g = bumps((4, 4, 4))
    want = np.fft.rfftn(g)
    for r in grids.dft(grids.unpack(packed(spark, g)), 4, 4, 4).collect():
        assert abs(complex(r.re, r.im) - want[r.kx, r.ky, r.kz]) < 1e-9


def test_pool_conserves_and_packs(spark):
    g = bumps((4, 4, 4))
    vox = grids.unpack(packed(spark, g))
    pooled = grids.avg_pool(vox, 2)
    assert math.isclose(pooled.agg(F.sum("rho")).first()[0] * 8, g.sum())
    assert grids.pack(vox).first().density == g.ravel().tolist()
    assert grids.upsample(pooled, vox, 2).count() == 64


def samples(spark, p=2):
    g = bumps((4, 5, 6))
    df = packed(spark, g).select("task_id", "density", F.array("nx", "ny", "nz").alias("grid"), *[F.array(*map(F.lit, v)).alias(k) for k, v in {"lattice": [4.0, 5.0, 6.0, 90.0, 95.0, 120.0], "coords": [0.1, 0.2, 0.3, 0.7, 0.6, 0.5], "atoms": [6, 1]}.items()])
    return g, patches.extract(patches.random_offsets(df, 8, seed=3), p)


@pytest.mark.parametrize("short", [None, 2, 3])
def test_patch_round_trip(spark, short):
    g, s = samples(spark)
    v = Vocabulary()
    rows = patches.tokenize(s, v, default_shape=short).withColumn("input_ids", patches.pad_right(F.col("input_ids"), 120)).withColumnsRenamed({"patch": "was", "offset": "o"}).drop("grid", "lattice", "atoms", "coords", "shape")
    for r in patches.detokenize(rows, v, default_shape=short).collect():
        assert r.error is None and r.grid == [4, 5, 6] and r.atoms == [6, 1] and r["shape"] == [2, 2, 2] and len(r.input_ids) == 120
        want = np.roll(g, [-x for x in r.o], (0, 1, 2))[:2, :2, :2].ravel()
        assert np.allclose(r.was, want) and np.allclose(r.patch, want, rtol=5e-4, atol=1e-4)
        coords = np.array([0.1, 0.2, 0.3, 0.7, 0.6, 0.5])
        if short:
            coords = (coords - np.tile(np.array(r.o) / [4, 5, 6], 2)) % 1
        else:
            assert r.offset == r.o
        assert np.allclose(r.coords, coords, atol=1e-4)


def test_row_lengths_follow_the_formulas(spark):
    _, s = samples(spark)
    v = Vocabulary()
    assert {r[0] for r in patches.tokenize(s, v).select(F.size("input_ids")).collect()} == {36 + 10 * 2 + 2 * 8}
    assert {r[0] for r in patches.tokenize(s, v, default_shape=2).select(F.size("input_ids")).collect()} == {21 + 10 * 2 + 2 * 8}


def test_malformed_rows_name_their_fault(spark):
    _, s = samples(spark)
    v = Vocabulary()
    ids = patches.tokenize(s, v).first().input_ids
    hi = ids.index(v.special("HI_START")) + 1
    rows = [(0, ids), (1, ids[1:]), (2, ids[:-1]), (3, [*ids[:hi], ids[hi] + 1, *ids[hi + 1 :]]), (4, [*ids[:-4], *ids[-2:]]), (5, [])]
    got = {r.task_id: r.error for r in patches.detokenize(spark.createDataFrame(rows, "task_id long, input_ids array<int>"), v).collect()}
    assert got[0] is None and got[1] == "no BOS" and got[2] == "no EOS" and got[3] == "high corner" and got[4] == "density" and got[5]


def test_vocabularies():
    assert Vocabulary().size == 6794 and Vocabulary.ball().size == 6792
    names = Vocabulary().export()
    assert len(names) == 6794 and names["[LATTICE_END]"] == 19 and sorted(names.values()) == list(range(6794))


def test_offsets_are_uniform_and_do_not_depend_on_partitions(spark):
    df = packed(spark, np.zeros((4, 4, 4))).withColumn("grid", F.array("nx", "ny", "nz"))
    one = patches.random_offsets(df, 4000, seed=1).select("k", "offset")
    counts = [r[0] for r in one.groupBy(F.get("offset", F.lit(0))).count().select("count").collect()]
    assert len(counts) == 4 and max(counts) - min(counts) < 200
    assert {(r.k, tuple(r.offset)) for r in one.collect()} == {(r.k, tuple(r.offset)) for r in patches.random_offsets(df.repartition(3), 4000, seed=1).select("k", "offset").collect()}


@pytest.mark.parametrize("shape, p", [((4, 4, 4), 4), ((5, 4, 7), 4), ((8, 4, 9), 4)])
def test_tiles_cover_each_cell_once(spark, shape, p):
    t = patches.tiles(packed(spark, np.zeros(shape)).drop("density"), p).collect()
    hit = np.zeros(shape, int)
    for r in t:
        hit[r.ox + r.sx : r.ox + p, r.oy + r.sy : r.oy + p, r.oz + r.sz : r.oz + p] += 1
    assert (hit == 1).all()


def test_tiles_refuse_small_grids(spark):
    with pytest.raises(Exception, match="shorter than the patch"):
        patches.tiles(packed(spark, np.zeros((3, 4, 4))).drop("density"), 4).collect()


def test_ball_counts_and_round_trip(spark):
    v = formulas.shell_counts(153)
    assert [v[r] for r in (75, 86, 100, 138, 153)] == [2777, 3407, 4169, 6859, 8025]
    voc = Vocabulary.ball()
    row = spark.createDataFrame([(1, [8, 8, 8], [6], [0.1, 0.2, 0.3], 5, [1, 2, 3], [0, 1, 2, 3, 4, 5], [1.0, -2.0, 0.0])], "task_id long, grid array<int>, atoms array<int>, coords array<double>, r2_max int, center array<int>, bounds array<int>, patch array<double>")
    ids = patches.tokenize_ball(row, voc).select("task_id", "input_ids")
    r = patches.detokenize_ball(ids, voc).first()
    assert len(r.input_ids) == 29 + 10 + 6 and r.bounds == [0, 1, 2, 3, 4, 5] and r.r2_max == 5
    assert np.allclose(r.patch, [1, -2, 0], rtol=1e-3) and np.allclose(r.coords, [0.1, 0.2, 0.3], rtol=1e-3)


def test_lloyd_max(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in rng.lognormal(size=3000)], "v double")
    h = lmq.histogram(df, "v", bins=5000)
    codec = lmq.fit(h, 8, clip_max=100.0)
    assert codec.n_bins == 8 and codec.bits == 3 and codec.boundaries == sorted(codec.boundaries)
    mass = lmq.LloydMax([r.boundary for r in lmq.equal_mass(h, 8).orderBy("q").collect()], [0.0] * 8, 100.0)
    mean = {r.bin: r.recon for r in lmq.lloyd_step(h, mass.boundaries).collect()}
    mass.recon = [mean[i] for i in range(8)]
    mse = lambda c: c.encode(df, "v").agg(F.avg(F.pow(F.col("v") - c.decode(F.col("bin")), F.lit(2)))).first()[0]
    assert mse(codec) < mse(mass)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 10), min_size=1, max_size=6), st.lists(st.floats(-1, 12), min_size=1, max_size=8))
def test_assign_is_upper_binary_search(bounds, values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    bounds = sorted(bounds)
    got = [r.bin for r in lmq.assign(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").coalesce(1), "v", bounds).orderBy("i").collect()]
    assert got == np.searchsorted(bounds, values, side="right").tolist()


def test_material_columns_keep_nulls(spark):
    df = spark.createDataFrame([("a", 3, 4, 5, None), ("b", 2000, 3000, 1000, 7)], "mp_id string, nx int, ny int, nz int, n_atoms int")
    a, b = materials.with_generated(df).orderBy("mp_id").collect()
    assert a.cube_seq_p14 is None and a.ball_seq_r75 is None and a.n_voxels == 60
    assert b.n_voxels == 6_000_000_000 and b.cube_seq_p14 == 36 + 70 + 2 * 2744 and b.max_dim == 3000
    with pytest.raises(ValueError):
        materials.select_where(df, ["nope"], "true")


def test_percentile_rank_clamps_and_bootstrap_is_stable(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("x"), F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert {r.p: r.value for r in materials.nearest_rank(df, "x", [0, 50, 100]).collect()} == {0: 0, 50: 5, 100: 9}
    one, two = (evaluation.bootstrap(d, "v", "x", 50, 1, "g").first() for d in (df, df.repartition(3)))
    assert one == two and 0.5 < one.se_mean < 1.5


def test_empty_summary_is_null(spark):
    r = evaluation.summary(spark.createDataFrame([], "v double"), "v").first()
    assert r.n == 0 and r["mean"] is None and r.p99 is None


def test_category_of_empty_set_and_states(spark):
    rows = spark.createDataFrame([([],), (["Na", "Cl"],), (["O"],)], "s array<string>")
    assert [r[0] for r in rows.select(formulas.category(F.col("s"))).collect()] == ["intermetallic", "halide", "oxide"]
    assert [r[0] for r in spark.createDataFrame([(4,), (42,)], "c int").select(formulas.state_name(F.col("c"))).collect()] == ["SUCCEEDED", "UNKNOWN_42"]


def test_zarr_chgcar_listings(spark, tmp_path):
    g = bumps((4, 6, 5)).astype("<f4")
    root = tmp_path / "label" / "m1.zarr"
    array = root / "charge_density_total"
    (array / "c").mkdir(parents=True)
    (root / "zarr.json").write_text(json.dumps({"attributes": {"structure": json.dumps({"a": 1}), "metadata": json.dumps({"task_id": "mp-1"})}}))
    (array / "zarr.json").write_text(json.dumps({"shape": [4, 6, 5], "data_type": "float32", "fill_value": 0, "chunk_grid": {"configuration": {"chunk_shape": [4, 4, 5]}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]}))
    for j in range(2):
        chunk = np.zeros((4, 4, 5), "<f4")
        part = g[:, 4 * j : 4 * j + 4]
        chunk[:, : part.shape[1]] = part
        (array / "c/0").mkdir(exist_ok=True)
        (array / f"c/0/{j}").mkdir(exist_ok=True)
        (array / f"c/0/{j}/0").write_bytes(pa.compress(chunk.tobytes(), "zstd", asbytes=True))
    bad = tmp_path / "label" / "m2.zarr"
    bad.mkdir()
    (bad / "zarr.json").write_text("{}")
    got = {r.task_id: r for r in zarr.read_zarr(spark, str(tmp_path / "label")).collect()}
    assert np.allclose(got["mp-1"].density, g.ravel()) and (got["mp-1"].ny, got["mp-1"].error) == (6, None)
    assert got["m2"].error and got["m2"].density is None

    text = ["x", "2.0", "1 0 0", "0 1 0", "0 0 1", "C O", "1 1", "Direct", "0 0 0", "0.5 0.5 0.5", "", "4 6 5"] + [" ".join(map(str, row)) for row in g.ravel(order="F").reshape(-1, 5)]
    (tmp_path / "CHG").write_text("\n".join(text) + "\naugmentation occupancies\n")
    r = chgcar.read_chgcar(spark, str(tmp_path / "CHG")).first()
    assert np.allclose(r.density, g.ravel(), atol=1e-6) and r.species == ["C", "O"] and r.lattice[0] == 2.0

    (tmp_path / "ids.txt").write_text(" a \n\nb\nc\n")
    ids = listings.read_ids(spark, str(tmp_path / "ids.txt"))
    (tmp_path / "split.json").write_text(json.dumps({"val": ["2", "x9"], "train": ["0"]}))
    assert {r.id for r in listings.read_split(spark, str(tmp_path / "split.json"), "val", ids).collect()} == {"c", "x9"}
    (tmp_path / "log").write_text("I20250101 noise\nJOB STATE\n/a/b running\n/a/b again\n/c x\n")
    assert {r.job_id for r in listings.read_job_log(spark, str(tmp_path / "log")).collect()} == {"/a/b", "/c"}
    np.savez(tmp_path / "codec.npz", boundaries=[1.0, 2.0, 3.0], recon_points=[0.5, 1.5, 2.5, 3.5], clip_max=9.0)
    assert listings.read_codec(str(tmp_path / "codec.npz")).n_bins == 4
    os.makedirs(tmp_path / "res")
    (tmp_path / "res" / "step-120.json").write_text('{"nmae": 0.5}')
    (tmp_path / "res" / "step-130.json").write_text("broken")
    assert {r.step: r.nmae for r in listings.read_results(spark, str(tmp_path / "res"), "nmae double").collect()} == {120: 0.5, 130: None}


def test_manifest_history_and_shards(spark, tmp_path):
    rows = spark.createDataFrame([(3, 1.0), (None, 2.0), (1, None)], "_step long, loss double")
    m = listings.write_history(rows, str(tmp_path / "h"))
    assert tuple(m.first()) == (3, 1, 3)
    tasks = spark.range(50).select((F.col("id") % 2).alias("worker"), F.floor(F.col("id") / 7).alias("task"), "id")
    etl.write_shards(tasks, str(tmp_path / "s"), "task", rows_per_file=10)
    back = tables.shards(spark, str(tmp_path / "s"))
    assert back.count() == 50 and back.groupBy("worker", "task").agg(F.countDistinct("_metadata.file_path").alias("n")).where("n > 1").count() == 0
    assert back.groupBy("_metadata.file_path").count().where("count > 10").count() == 0
    (tmp_path / "s" / "a").mkdir(), (tmp_path / "s" / "b").mkdir()
    (tmp_path / "s" / "a" / "x.bin").write_text("1"), (tmp_path / "s" / "b" / "x.bin").write_text("2")
    paths = [r.path for r in listings.file_manifest(spark, str(tmp_path / "s")).where("path like '%.bin'").orderBy("path").collect()]
    assert paths == ["a/x.bin", "b/x.bin"]
    assert "| a |" in telemetry.markdown(spark.createDataFrame([(1,)], "a int"))


def test_stream_equals_batch_over_several_triggers(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "click", float((i * 7) % 11), "{}") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    for n in range(3):
        df.where((F.col("event_id") >= 10 * n) & (F.col("event_id") < 10 * n + 10)).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    os.makedirs(tmp_path / "all")
    for n in range(3):
        (src,) = (p for p in os.listdir(tmp_path / f"in{n}") if p.endswith("parquet"))
        os.rename(tmp_path / f"in{n}" / src, tmp_path / "all" / f"{n}.parquet")
    out = counters.run_to_table(counters.counter_deltas(counters.events_stream(spark, str(tmp_path / "all"), "*.parquet")), "update", "t")
    for u in range(3):
        v = [r[4] for r in rows if r[2] == u]
        got = [(r.poll, r.total, r.delta) for r in out.where(F.col("user_id") == u).orderBy("poll").collect()]
        assert got == [(i + 1, x, max(0.0, x - v[i - 1]) if i else 0.0) for i, x in enumerate(v)]
    assert out.where("poll = 1 and per_hour <> 0").count() == 0


def test_integrity_scan_and_tree(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "bad.parquet").write_bytes(b"PAR1 not a file")
    got = {r.path: r for r in series.parquet_integrity(spark, str(tmp_path / "p")).collect()}
    assert got["bad.parquet"].error and got["bad.parquet"].rows == 0
    assert sum(r.rows for r in got.values()) == 10 and all(r.bad_groups == 0 for r in got.values())
    doc = json.dumps({"name": "a", "children": [{"name": "b"}, {"name": "c", "children": [{"name": "d"}]}]})
    rows = series.walk_tree(spark.createDataFrame([(1, doc), (2, None)], "key long, doc string"), "doc").collect()
    assert [(r.depth, r.name, r.leaf) for r in rows] == [(0, "a", False), (1, "b", True), (1, "c", False), (2, "d", True)]


def test_gaps_are_clamped_at_the_ends(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])], "s int, i int, v double")
    assert [r.filled for r in series.fill_gaps(df, "s", "i", "v").orderBy("i").collect()] == [2, 2, 3, 4, 5, 5]


def test_numbered_equals_a_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("k")).repartition(7)
    want = {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, -r.id)))}
    assert {r.id: r.place for r in order.numbered(df, "k", -F.col("id")).collect()} == want
    assert order.numbered(df.limit(0), "k").count() == 0


def test_shards_never_split_a_task(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 200).tolist()
    rows = spark.createDataFrame([(t % 3, t) for t, n in enumerate(sizes) for _ in range(n)], "worker long, task long")
    for worker in ("worker", None):
        got = etl.shard_bins(rows, "task", 100, worker).collect()
        assert {(r.task, r.rows) for r in got} == set(enumerate(sizes))
        fill = {}
        for r in got:
            fill[r[0], r.shard] = fill.get((r[0], r.shard), 0) + r.rows
        assert max(fill.values()) <= 100


def test_published_versions_are_new(spark, tmp_path):
    df = spark.range(3)
    assert tables.publish(df, str(tmp_path), "mats", 2, dry_run=True) == f"{tmp_path}/mats/v2" and not (tmp_path / "mats").exists()
    path = tables.publish(df, str(tmp_path), "mats", 2)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="exists"):
        tables.publish(df, str(tmp_path), "mats", 2)
    with pytest.raises(ValueError):
        tables.publish_path("x", "y", 0)


def test_exactly_one_match(spark):
    runs = spark.createDataFrame([("train-a",), ("train-b",)], "name string")
    assert tables.one_match(runs, "name", "-b").first().name == "train-b"
    for part in ("train", "none"):
        with pytest.raises(ValueError):
            tables.one_match(runs, "name", part)


def test_csv_lines_and_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 2.5), (2, None, None)], "k long, s string, v double")
    assert [r.value for r in tables.csv_lines(df, ["k", "v"]).collect()] == ["1,2.5", "2,"]
    tables.write_csv(df, str(tmp_path / "c"), ["v", "s", "k"])
    back = tables.read_csv(spark, str(tmp_path / "c"), "v double, s string, k long").orderBy("k").collect()
    assert [tuple(r) for r in back] == [(2.5, 'a "b", c', 1), (None, None, 2)]


def test_slater_screening_of_oxygen(spark):
    got = {(r.n, r.l): (r.electrons, r.z_eff) for r in promolecules.screened(promolecules.shells(spark)).where("z = 8").collect()}
    assert got == {(1, 0): (2, pytest.approx(7.70)), (2, 0): (2, pytest.approx(4.55)), (2, 1): (4, pytest.approx(4.55))}
    iron = {(r.n, r.l): r.z_eff for r in promolecules.screened(promolecules.shells(spark)).where("z = 26").collect()}
    assert iron[3, 2] == pytest.approx(6.25) and iron[4, 0] == pytest.approx(3.75)


def test_transforms_compose(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 4, 4, 2, rng.lognormal(size=32).tolist(), rng.lognormal(size=32).tolist()) for i in range(5)]
    grids = spark.createDataFrame(rows, "task_id long, nx int, ny int, nz int, density array<double>, baseline array<double>")
    codec = LogCodec(-6.0, 4.0, (8, 12))
    error = lambda t: max(r[0] for r in transforms.round_trip(t, grids).select(transforms.relative_error(grids)).collect())
    assert error(transforms.Direct()) < 1e-6 and error(transforms.Fourier(1.0)) < 1e-5 and error(transforms.Cutoff(1.0)) == 0
    assert error(transforms.Coded(codec)) < 1e-4 and error(transforms.Delta(transforms.Coded(codec))) < 2e-4
    assert error(transforms.Delta(transforms.Fourier(1.0, codec), atoms=2)) < 1e-3
    pooled = transforms.round_trip(transforms.Pooled(transforms.Delta(transforms.Direct()), 2), grids.withColumn("baseline", F.array_repeat(F.lit(1.0), 4))).collect()
    for r in pooled:
        want = np.array(r.density).reshape(2, 2, 2, 2, 1, 2).mean(axis=(1, 3, 5)).repeat(2, 0).repeat(2, 1).repeat(2, 2).ravel()
        assert np.allclose(r.approx, want, rtol=1e-5) and (r.nx, r.ny, r.nz) == (4, 4, 2)
    assert transforms.Delta(transforms.Pooled(transforms.Direct(), 2)).name == "delta-down2-direct"
    with pytest.raises(Exception, match="divisible"):
        transforms.round_trip(transforms.Pooled(transforms.Direct(), 3), grids).collect()


def test_density_loss_rejects_other_modes(spark):
    frame = spark.createDataFrame([(1, 0, 0, 0.0)], "seq long, pos long, token long, logit double")
    for bad in ({"mode": "x"}, {"kind": "l2"}):
        with pytest.raises(ValueError):
            evaluation.density_aware_loss(frame, frame, ["seq"], lambda b: b, 0, 1, weight=1.0, penalty=0.0, **bad)
