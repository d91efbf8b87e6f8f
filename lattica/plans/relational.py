"""Queries on the materials table, patches, preparation, evaluation and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.functions.vocabulary import Vocabulary, lattice_fits
from lattica.operators import etl, grids as G, materials, patches
from lattica.operators.selection import quantiles
from lattica.plans.registry import VOX, grids, query, r6, sql_bin, sql_r6, sql_unbin, table

# ---- materials: parts as materials -------------------------------------------------------------

_MATS = """mats AS (SELECT CAST(p_partkey AS VARCHAR) AS mp_id, CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(40 + p_partkey % 60 AS BIGINT) AS nx, CAST(40 + p_partkey % 70 AS BIGINT) AS ny,
 CAST(40 + p_partkey % 90 AS BIGINT) AS nz, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS n_atoms FROM part)"""


def _mats(spark, d):
    k = F.col("p_partkey")
    side = lambda m: (F.lit(40) + k % m).cast("long")
    return table(spark, d, "part").select(k.cast("string").alias("mp_id"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"), side(60).alias("nx"), side(70).alias("ny"), side(90).alias("nz"), F.when(k % 11 != 0, F.col("p_size").cast("long")).alias("n_atoms"))


_V = {r: v for r, v in enumerate(formulas.shell_counts(153))}


@query(f"WITH {_MATS} SELECT mp_id, nx * ny * nz AS n_voxels, greatest(nx, ny, nz) AS max_dim, 36 + 10 * n_atoms + 2 * 2744 AS cube_seq_p14, 36 + 10 * n_atoms + 2 * 6859 AS cube_seq_p19, 29 + 10 * n_atoms + 2 * {_V[100]} AS ball_seq_r100 FROM mats")
def mats_generated_cols(spark, d):
    return materials.with_generated(_mats(spark, d)).select("mp_id", "n_voxels", "max_dim", "cube_seq_p14", "cube_seq_p19", "ball_seq_r100")


@query(f"WITH {_MATS} SELECT mp_id, n_atoms, nx FROM mats WHERE n_atoms > 30 AND split = 'val'")
def mats_filter_project(spark, d):
    return materials.select_where(_mats(spark, d), ["mp_id", "n_atoms", "nx"], "n_atoms > 30 AND split = 'val'")


@query(f"WITH {_MATS} SELECT split, count(*) AS n, CAST(coalesce(max(n_atoms), 0) AS BIGINT) AS most FROM mats GROUP BY 1")
def mats_group_count(spark, d):
    return _mats(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.coalesce(F.max("n_atoms"), F.lit(0)).cast("long").alias("most"))


@query(f"WITH {_MATS}, s AS (SELECT 36 + 10 * n_atoms + 5488 AS p14, 36 + 10 * n_atoms + 8192 AS p16 FROM mats) " + " UNION ALL ".join(f"SELECT 'cube_seq_p{p}' AS length, CAST({b} AS BIGINT) AS budget, count(*) FILTER (p{p} <= {b}) AS fits, {sql_r6(f'count(*) FILTER (p{p} <= {b}) / CAST(count(*) AS DOUBLE)')} AS share FROM s" for p in (14, 16) for b in (5600, 5800, 8400, 8600)))
def mats_fit_fraction(spark, d):
    rows = materials.fit_fraction(materials.with_generated(_mats(spark, d)), ["cube_seq_p14", "cube_seq_p16"], [5600, 5800, 8400, 8600])
    return rows.withColumn("share", r6(F.col("share")))


@query(f"WITH {_MATS}, r AS (SELECT n_atoms, row_number() OVER (ORDER BY n_atoms) - 1 AS i, count(*) OVER () AS n FROM mats WHERE n_atoms IS NOT NULL) SELECT CAST(p AS INTEGER) AS p, n_atoms AS value FROM r, (VALUES (0), (25), (50), (90), (99), (100)) AS q(p) WHERE i = least(n * p // 100, n - 1)")
def mats_percentile_rank(spark, d):
    return materials.nearest_rank(_mats(spark, d), "n_atoms", [0, 25, 50, 90, 99, 100])


@query(f"WITH {_MATS}, new AS (SELECT mp_id, split, nx + 1 AS nx, n_atoms FROM mats WHERE split = 'val') SELECT mp_id, split, nx, n_atoms FROM new UNION ALL SELECT mp_id, split, nx, n_atoms FROM mats WHERE mp_id NOT IN (SELECT mp_id FROM new)")
def mats_upsert(spark, d):
    current = _mats(spark, d).select("mp_id", "split", "nx", "n_atoms")
    return materials.upsert(current, current.where("split = 'val'").withColumn("nx", F.col("nx") + 1), "mp_id", replace_split="val")


@query(f"WITH {_MATS}, v AS (SELECT mp_id, CAST(nx * ny * nz AS DOUBLE) AS v FROM mats) SELECT mp_id, {sql_r6('32 * 2744 / v')} AS coverage, {sql_r6('1 - pow(1 - least(1.0, 2744 / v), 32)')} AS hit FROM v")
def coverage_table(spark, d):
    v = (F.col("nx") * F.col("ny") * F.col("nz")).cast("double")
    return _mats(spark, d).select("mp_id", r6(formulas.expected_coverage(14, v, 32)).alias("coverage"), r6(formulas.hit_chance(14, v, 32)).alias("hit"))


@query(f"WITH {_MATS}, b AS (SELECT n_atoms / CAST(sum(n_atoms) OVER () AS DOUBLE) * 32 * count(*) OVER () AS budget FROM mats) SELECT count(*) AS n, count(*) FILTER (budget < 8) AS few, count(*) FILTER (budget > 320) AS drowned, round(sum(budget), 3) AS total FROM b")
def budget_weights(spark, d):
    rows = materials.budgets(_mats(spark, d), F.col("n_atoms"), 32)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("budget") < 8).alias("few"), F.count_if(F.col("budget") > 320).alias("drowned"), F.round(F.sum("budget"), 3).alias("total"))


@query(f"""
    WITH {_MATS}, s AS (SELECT b, t, p, count(*) FILTER (36 + 10 * n_atoms + 2 * p * p * p <= b) / CAST(count(*) AS DOUBLE) AS share FROM mats, (VALUES (4096), (8192), (16384)) AS bb(b), (VALUES (0.5), (0.9)) AS tt(t), range(10, 21) AS pp(p) GROUP BY ALL),
    f AS (SELECT b, t, min(p) FILTER (share < t) AS stop FROM s GROUP BY ALL)
    SELECT CAST(b AS BIGINT) AS budget, CAST(t AS DOUBLE) AS target, CAST(max(p) FILTER (stop IS NULL OR p < stop) AS INTEGER) AS p FROM s JOIN f USING (b, t) GROUP BY b, t""")
def max_p_search(spark, d):
    return materials.largest_patch(_mats(spark, d), list(range(10, 21)), [4096, 8192, 16384], [0.5, 0.9])


@query(f"WITH {_MATS}, p AS (SELECT [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0] AS qs, quantile_cont(greatest(nx, ny, nz), [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS vs FROM mats) SELECT CAST(unnest(qs) AS DOUBLE) AS q, round(CAST(unnest(vs) AS DOUBLE), 6) + 0.0 AS max_dim FROM p")
def dim_percentiles(spark, d):
    qs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    return quantiles(_mats(spark, d), [], F.greatest("nx", "ny", "nz"), qs).select("q", r6(F.col("value")).alias("max_dim"))


@query("SELECT CAST(floor(p_retailprice / 50) * 50 AS DOUBLE) AS low, count(*) AS n FROM part GROUP BY 1")
def fixed_width_histogram(spark, d):
    return table(spark, d, "part").groupBy((F.floor(F.col("p_retailprice") / 50) * 50).cast("double").alias("low")).agg(F.count("*").alias("n"))


_BALL = "WITH a AS (SELECT unnest(range(-10, 11)) AS v), p AS (SELECT x.v AS dx, y.v AS dy, z.v AS dz, x.v * x.v + y.v * y.v + z.v * z.v AS r2 FROM a x, a y, a z)"


@query(f"{_BALL} SELECT CAST(p_partkey AS BIGINT) AS p_partkey, count(p.r2) AS points FROM part LEFT JOIN p ON p.r2 <= p_size GROUP BY 1")
def ball_counts(spark, d):
    """Lattice points in a ball for each part, whose size is the squared radius: running counts of shells, looked up."""
    from pyspark.sql import Window

    shells = patches.ball_points(spark, 100).groupBy("r2").agg(F.count("*").alias("c"))
    every = spark.range(101).select(F.col("id").alias("r2")).join(shells, "r2", "left")
    upto = every.select("r2", F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("r2").rowsBetween(Window.unboundedPreceding, 0)).alias("points"))  # a row for each squared radius
    return table(spark, d, "part").join(F.broadcast(upto), F.col("p_size") == F.col("r2")).select(F.col("p_partkey").cast("long").alias("p_partkey"), "points")


@query(f"{_BALL}, o AS (SELECT row_number() OVER (ORDER BY r2, dy, dx, dz) - 1 AS place, dx, dy, dz FROM p WHERE r2 <= 5), {VOX} SELECT task_id, place, {sql_r6('rho')} AS rho FROM o JOIN vox ON ix = 1 + dx AND iy = 2 + dy AND iz = 3 + dz")
def ball_offsets_order(spark, d):
    """The cells of a ball around a point of every grid, each with its place in the ball's order."""
    centres = grids(spark, d).select("task_id", "nx", "ny", "nz", F.lit(1).alias("cx"), F.lit(2).alias("cy"), F.lit(3).alias("cz"))
    return patches.extract_ball(G.unpack(grids(spark, d)), centres, patches.ball_points(spark, 5)).select("task_id", "place", r6(F.col("rho")).alias("rho"))


# ---- patches ------------------------------------------------------------------------------------

V = Vocabulary()
_DRAW = lambda axis: f"CAST('0x' || substr(md5('7:' || task_id || ':' || k || ':{axis}'), 1, 7) AS BIGINT) % 4"
_SAMPLES = f"""{VOX}, o AS (SELECT task_id, k, {_DRAW(0)} AS o0, {_DRAW(1)} AS o1, {_DRAW(2)} AS o2 FROM (SELECT DISTINCT task_id FROM vox), range(2) AS r(k)),
g AS (SELECT o.*, j, (o0 + j // 4) % 4 AS ix, (o1 + (j // 2) % 2) % 4 AS iy, (o2 + j % 2) % 4 AS iz FROM o, range(8) AS r(j)),
pv AS (SELECT g.*, rho FROM g JOIN vox USING (task_id, ix, iy, iz))"""


def _samples(spark, d):
    rows = grids(spark, d).withColumn("grid", F.array("nx", "ny", "nz"))
    fixed = {"lattice": [4.0, 4.1, 4.2, 90.0, 90.0, 120.0], "coords": [0.25, 0.25, 0.25, 0.75, 0.75, 0.75]}
    rows = rows.withColumns({k: F.array(*map(F.lit, v)) for k, v in fixed.items()}).withColumn("atoms", F.array(F.lit(6), F.lit(8)))
    return patches.extract(patches.random_offsets(rows, 2, seed=7), 2)


@query(f"WITH {_SAMPLES} SELECT task_id, CAST(k AS INTEGER) AS k, {sql_r6('sum(rho * (j + 1))')} AS weighted, {sql_r6('min(rho)')} AS low FROM pv GROUP BY 1, 2")
def patch_extract_pbc(spark, d):
    w = F.aggregate(F.transform("patch", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return _samples(spark, d).select("task_id", "k", r6(w).alias("weighted"), r6(F.array_min("patch")).alias("low"))


@query(f"WITH {_SAMPLES} SELECT task_id, CAST(k AS INTEGER) AS k, (o0 + 1) % 4 AS h0, (o1 + 1) % 4 AS h1, (o2 + 1) % 4 AS h2, (o0 = 3 OR o1 = 3 OR o2 = 3) AS wraps FROM o")
def hi_corner(spark, d):
    s = _samples(spark, d)
    hi = patches.high_corner(F.col("grid"), F.col("offset"), F.col("shape"))
    at = lambda c, i: F.get(c, F.lit(i))
    return s.select("task_id", "k", *[at(hi, i).cast("long").alias(f"h{i}") for i in range(3)], ((at(hi, 0) < at(F.col("offset"), 0)) | (at(hi, 1) < at(F.col("offset"), 1)) | (at(hi, 2) < at(F.col("offset"), 2))).alias("wraps"))


@query(f"WITH {_SAMPLES} SELECT task_id, CAST(k AS INTEGER) AS k, " + ", ".join(f"round((({c} - o{a} / 4.0) - floor({c} - o{a} / 4.0)), 6) + 0.0 AS f{i}" for i, (a, c) in enumerate([(0, 0.25), (1, 0.25), (2, 0.25), (0, 0.75)])) + " FROM o")
def translate_coords(spark, d):
    f = patches.to_patch_frame(F.col("coords"), F.col("grid"), F.col("offset"))
    return _samples(spark, d).select("task_id", "k", *[r6(F.get(f, F.lit(i))).alias(f"f{i}") for i in range(4)])


def _pos(v: str) -> str:
    b = f"({sql_bin(v, -4.0, 0.0, 24)})"
    return f"[1162 + (({b} >> 16) & 255), 1674 + (({b} >> 8) & 255), 1930 + ({b} & 255)]"


_DENS = f"""dn AS (SELECT task_id, k, o0, o1, o2, j, rho, {sql_bin('rho', -4.13, 4.97, 20)} AS b FROM pv),
dt AS (SELECT task_id, k, o0, o1, o2, flatten(list([2186 + ((b >> 12) & 255) + CASE WHEN rho >= 0 THEN 0 ELSE 256 END, 2698 + (b & 4095)] ORDER BY j)) AS dens FROM dn GROUP BY ALL)"""
_HEAD = "[1, 7, 142, 142, 142, 8, 18, 218, 220, 222, 588, 588, 738, 19, 3, 25, 27, 4, 5]"


@query(f"WITH {_SAMPLES}, {_DENS} SELECT task_id, CAST(k AS INTEGER) AS k, array_to_string({_HEAD}" + "".join(f" || {_pos(str(c))}" for c in (0.25,) * 3 + (0.75,) * 3) + " || [6, 9, 140, 140, 140, 10, 11, 138 + o0, 138 + o1, 138 + o2, 12, 13, 138 + (o0 + 1) % 4, 138 + (o1 + 1) % 4, 138 + (o2 + 1) % 4, 14, 15] || dens || [16, 2], ' ') AS ids FROM dt")
def tokenize_v2(spark, d):
    return patches.tokenize(_samples(spark, d), V).select("task_id", "k", F.array_join("input_ids", " ").alias("ids"))


_FRAME = lambda c, a: f"(({c} - o{a} / 4.0) - floor({c} - o{a} / 4.0))"


@query(f"WITH {_SAMPLES}, {_DENS} SELECT task_id, CAST(k AS INTEGER) AS k, array_to_string({_HEAD}" + "".join(f" || {_pos(_FRAME(c, i))}" for c in (0.25, 0.75) for i in range(3)) + " || [6, 15] || dens || [16, 2], ' ') AS ids FROM dt")
def tokenize_v3(spark, d):
    return patches.tokenize(_samples(spark, d), V, default_shape=2).select("task_id", "k", F.array_join("input_ids", " ").alias("ids"))


@query(f"""WITH {_SAMPLES}, {_DENS} SELECT task_id, CAST(k AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS error, o0, o1, o2, count(*) AS n, round(sum((j + 1) * CASE WHEN rho >= 0 THEN 1 ELSE -1 END * ({sql_unbin('b', -4.13, 4.97, 20)})), 4) AS weighted FROM dn GROUP BY ALL""")
def detokenize_roundtrip(spark, d):
    rows = patches.tokenize(_samples(spark, d), V).drop("grid", "lattice", "atoms", "coords", "shape", "patch", "offset")
    back = patches.detokenize(rows, V)
    weighted = F.aggregate(F.transform("patch", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("task_id", "k", "error", *[F.get("offset", F.lit(i)).cast("long").alias(f"o{i}") for i in range(3)], F.size("patch").cast("long").alias("n"), F.round(weighted, 4).alias("weighted"))


def _varied(spark, d):
    """Samples whose grid, cell, atoms and offset depend on the row."""
    k = F.col("vec_id")
    atoms = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: ((k * 7 + i * 31) % 94 + 1).cast("int"))
    whole = lambda *c: F.array(*[x.cast("int") for x in c])
    rows = table(spark, d, "embeddings").select(
        k.alias("task_id"), whole(k % 40 + 4, k % 7 + 5, F.lit(6)).alias("grid"), F.array((k % 5 + 3).cast("double"), *map(F.lit, [4.1, 4.2, 90.0, 90.0, 120.0])).alias("lattice"), atoms.alias("atoms"),
        whole(F.lit(2), F.lit(2), F.lit(2)).alias("shape"), whole(k % 4, k % 3, F.lit(0)).alias("offset"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("patch"),
    )
    return patches.tokenize(rows.withColumn("coords", F.array_repeat(F.lit(0.25), 3 * F.size("atoms"))), V)


@query("SELECT vec_id AS task_id, greatest(96, CAST(52 + 10 * (vec_id % 3 + 1) AS BIGINT)) AS length, greatest(0, CAST(96 - 52 - 10 * (vec_id % 3 + 1) AS BIGINT)) AS padding FROM embeddings")
def pad_right(spark, d):
    padded = patches.pad_right(F.col("input_ids"), 96)
    return _varied(spark, d).select("task_id", F.size(padded).cast("long").alias("length"), F.size(F.filter(padded, lambda x: x == 0)).cast("long").alias("padding"))


@query("""SELECT vec_id AS task_id, vec_id % 40 + 4 AS nx, vec_id % 7 + 5 AS ny, CAST(6 AS BIGINT) AS nz, vec_id % 3 + 1 AS n_atoms, CAST(list_sum(list_transform(range(0, vec_id % 3 + 1), lambda i: (vec_id * 7 + i * 31) % 94 + 1)) AS BIGINT) AS n_electrons,
    round(CAST(vec_id % 5 + 3 AS DOUBLE), 2) AS a, CAST(120.0 AS DOUBLE) AS gamma, vec_id % 4 AS ox, vec_id % 3 AS oy, CAST(0 AS BIGINT) AS oz FROM embeddings""")
def preamble_parse(spark, d):
    p = patches.preamble(_varied(spark, d), V)
    at = lambda c, i: F.get(c, F.lit(i))
    return p.select("task_id", "nx", "ny", "nz", "n_atoms", "n_electrons", F.round(at("lattice", 0), 2).alias("a"), F.round(at("lattice", 5), 2).alias("gamma"), *[at("offset", i).cast("long").alias(f"o{x}") for i, x in enumerate("xyz")])


@query(f"""
    WITH {VOX}, t AS (SELECT * FROM (VALUES (0, 0), (1, 2)) AS t(o, s)), c AS (SELECT unnest(range(0, 3)) AS v),
    cell AS (SELECT a.o + x.v AS ix, b.o + y.v AS iy, e.o + z.v AS iz FROM t a, t b, t e, c x, c y, c z WHERE x.v >= a.s AND y.v >= b.s AND z.v >= e.s)
    SELECT task_id, count(*) AS n_cells, {sql_r6('sum(rho)')} AS total FROM cell JOIN vox USING (ix, iy, iz) GROUP BY 1""")
def tile_full_coverage(spark, d):
    p = 3
    t = patches.tiles(grids(spark, d).select("task_id", "nx", "ny", "nz"), p)
    for a in "xyz":
        t = t.select("*", F.explode(F.sequence(F.col(f"s{a}"), F.lit(p - 1))).alias(f"l{a}"))
    cells = t.select("task_id", *[(F.col(f"o{a}") + F.col(f"l{a}")).cast("long").alias(f"i{a}") for a in "xyz"])
    return cells.join(G.unpack(grids(spark, d)), ["task_id", "ix", "iy", "iz"]).groupBy("task_id").agg(F.count("*").alias("n_cells"), r6(F.sum("rho")).alias("total"))


@query(f"""
    WITH {VOX}, t AS (SELECT * FROM (VALUES (0, 0), (1, 2)) AS t(o, s)), c AS (SELECT unnest(range(0, 3)) AS v),
    cell AS (SELECT a.o + x.v AS ix, b.o + y.v AS iy, e.o + z.v AS iz, count(*) AS times FROM t a, t b, t e, c x, c y, c z WHERE x.v >= a.s AND y.v >= b.s AND z.v >= e.s GROUP BY 1, 2, 3)
    SELECT task_id, count(*) AS n_cells, max(times) AS most, {sql_r6('sum(rho * (flat + 1))')} AS weighted, 0.0::DOUBLE AS nmae FROM vox JOIN cell USING (ix, iy, iz) GROUP BY 1""")
def stitch_nmae(spark, d):
    p, g = 3, grids(spark, d)
    t = patches.tiles(g.select("task_id", "nx", "ny", "nz", "density"), p)
    for a in "xyz":
        t = t.select("*", F.explode(F.sequence(F.col(f"s{a}"), F.lit(p - 1))).alias(f"l{a}"))
    flat = ((F.col("ox") + F.col("lx")) * F.col("ny") + F.col("oy") + F.col("ly")) * F.col("nz") + F.col("oz") + F.col("lz")
    cells = t.select("task_id", flat.cast("long").alias("flat"), F.get("density", flat.cast("int")).alias("rho"))
    both = patches.stitch(cells).withColumnRenamed("density", "back").join(g, "task_id")
    off = F.aggregate(F.zip_with("back", "density", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("back", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return both.select("task_id", "n_cells", "most", r6(weighted).alias("weighted"), r6(off).alias("nmae"))


@query(f"""
    WITH {VOX}, {_BALL.removeprefix('WITH ')}, c AS (SELECT task_id, 1 AS cx, 2 AS cy, 3 AS cz FROM (SELECT DISTINCT task_id FROM vox)),
    b AS (SELECT vox.* FROM c JOIN p ON r2 <= 5 JOIN vox ON vox.task_id = c.task_id AND vox.ix = cx + dx AND vox.iy = cy + dy AND vox.iz = cz + dz)
    SELECT task_id, count(*) AS n, min(ix) AS x0, max(ix) AS x1, min(iz) AS z0, max(iz) AS z1, {sql_r6('sum(rho)')} AS total FROM b GROUP BY 1""")
def ball_extract(spark, d):
    centres = grids(spark, d).select("task_id", "nx", "ny", "nz", F.lit(1).alias("cx"), F.lit(2).alias("cy"), F.lit(3).alias("cz"))
    cells = patches.extract_ball(G.unpack(grids(spark, d)), centres, patches.ball_points(spark, 5))
    return cells.groupBy("task_id").agg(F.count("*").alias("n"), F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iz").alias("z0"), F.max("iz").alias("z1"), r6(F.sum("rho")).alias("total"))


@query("""WITH s AS (SELECT * FROM (VALUES (0, 'special', 20), (1, 'atom', 118), (2, 'int', 1024), (3, 'position', 2 * (1 << 8) + (1 << 8) + (1 << 8)), (4, 'density', 2 * (1 << 8) + (1 << 12))) AS t(i, region, n)),
    r AS (SELECT region, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM s),
    t AS (SELECT (l_partkey * 37 + l_orderkey * 11 + l_linenumber) % (SELECT sum(n) FROM s) AS id FROM lineitem)
    SELECT region, count(*) AS tokens, CAST(min(id - first) AS BIGINT) AS low, CAST(max(id - first) AS BIGINT) AS high FROM t JOIN r ON id >= first AND id < first + n GROUP BY 1""")
def vocab_dim(spark, d):
    """Tokens counted by the vocabulary's regions, with the least and greatest place in each."""
    ids = table(spark, d, "lineitem").select(((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11 + F.col("l_linenumber")) % V.size).alias("token_id"))
    named = ids.groupBy("token_id").agg(F.count("*").alias("c")).join(F.broadcast(V.table(spark)), "token_id")  # a row for each token of the vocabulary
    return named.groupBy("region").agg(F.sum("c").alias("tokens"), F.min("index").alias("low"), F.max("index").alias("high"))


_NINE = " || ".join(_pos("0.25") for _ in range(3)), " || ".join(_pos("0.75") for _ in range(3))


@query(f"""WITH {_SAMPLES}, {_DENS}, b AS (SELECT task_id, CAST(k AS INTEGER) AS k, unnest([('GRID', '4 4 4'), ('ATOMS', '6 8'), ('POS', array_to_string({_NINE[0]}, ' ') || ' | ' || array_to_string({_NINE[1]}, ' ')), ('SHAPE', '2 2 2'), ('OFFSET', concat_ws(' ', o0, o1, o2)),
      ('HI', concat_ws(' ', (o0 + 1) % 4, (o1 + 1) % 4, (o2 + 1) % 4)), ('DENS', len(dens) || ': ' || array_to_string(dens[1:3], ' ') || ' .. ' || array_to_string(dens[-3:], ' ')), ('PAD', '8')]) AS x FROM dt)
    SELECT task_id, k, x[1] AS block, x[2] AS shown FROM b""")
def render_tokens(spark, d):
    rows = patches.tokenize(_samples(spark, d), V).select("task_id", "k", patches.pad_right(F.col("input_ids"), 80).alias("input_ids"))
    return patches.render_blocks(rows, V, ["task_id", "k"], ends=3)


# ---- preparation --------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT p_partkey AS task_id, CASE WHEN p_partkey % 13 = 0 THEN 'missing' WHEN 900 + p_partkey % 150 >= 1024 THEN 'oversized'
      WHEN NOT (round_even((p_retailprice / 40.0) / 0.05, 0) < 1024) THEN 'lattice' WHEN p_size * 10 + 5524 > 5900 THEN 'overflow' END AS reason FROM part)
    SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, CAST(min(task_id) AS BIGINT) AS first_id FROM r GROUP BY 1""")
def reject_routing(spark, d):
    k = F.col("p_partkey")
    side = F.col("p_retailprice") / 40.0
    ok = lattice_fits([side, F.lit(4.0), F.lit(4.0), F.lit(90.0), F.lit(90.0), F.lit(90.0)])
    reason = etl.reject_reason(k % 13 == 0, [900 + k % 150, F.lit(1)], ok, F.col("p_size") * 10 + 5524, 5900)
    rows = table(spark, d, "part").select(k.alias("task_id"), F.coalesce(reason, F.lit("accepted")).alias("reason"))
    return etl.reject_summary(rows).select("reason", "n", F.get("examples", F.lit(0)).alias("first_id"))


@query("WITH l AS (SELECT p_partkey - 1 AS idx, p_name AS id FROM part), s AS (SELECT CASE WHEN idx % 3 = 0 THEN 'val' ELSE 'train' END AS split, idx FROM (SELECT DISTINCT l_suppkey * 2 AS idx FROM lineitem)) SELECT split, count(*) AS n, min(id) AS first_name FROM s JOIN l USING (idx) GROUP BY 1")
def split_resolve_index(spark, d):
    listing = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("idx"), F.col("p_name").alias("id"))
    members = table(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("idx")).distinct().withColumn("split", F.when(F.col("idx") % 3 == 0, "val").otherwise("train"))
    return etl.resolve_split(members, listing).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first_name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 16 = 3")
def worker_stripe(spark, d):
    return etl.stripe(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 16)


@query("""
    WITH RECURSIVE s AS (SELECT c_nationkey AS worker, c_custkey AS task, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY task, n) AS r FROM s),
    f AS (SELECT worker, task, n, r, CAST(0 AS BIGINT) AS shard, n AS fill FROM i WHERE r = 1
      UNION ALL SELECT i.worker, i.task, i.n, i.r, f.shard + CASE WHEN f.fill + i.n > 100 THEN 1 ELSE 0 END, CASE WHEN f.fill + i.n > 100 THEN i.n ELSE f.fill + i.n END FROM f JOIN i ON i.worker = f.worker AND i.r = f.r + 1)
    SELECT CAST(worker AS BIGINT) AS worker, shard, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS rows FROM f GROUP BY 1, 2""")
def shard_rollover_bins(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("worker"), F.col("c_custkey").alias("task"))
    return etl.shard_bins(rows, "task", 100, "worker").groupBy("worker", "shard").agg(F.count("*").alias("tasks"), F.sum("rows").alias("rows"))


@query("SELECT l_orderkey, CAST(min(l_linenumber) AS INTEGER) AS l_linenumber FROM lineitem GROUP BY 1")
def dedupe_first_patch(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))


@query("WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT source, doc_id FROM f WHERE r <= 20 AND (r - 1) % 4 = 0")
def every_nth_shard(spark, d):
    return etl.every_nth_shard(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 20, 4).select("source", "doc_id")


@query("WITH a AS (SELECT doc_id AS path, md5(text) AS h FROM documents), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0) SELECT CASE WHEN b.path IS NULL THEN 'missing' WHEN a.h = b.h THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM a LEFT JOIN b USING (path) GROUP BY 1")
def manifest_compare(spark, d):
    local = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"))
    remote = local.where("path % 5 <> 0").withColumn("md5", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("md5")))
    return etl.compare_manifests(local, remote).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pinned_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pinned_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 25")
def seeded_sample(spark, d):
    return etl.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25, 11, by="lang")


@query("WITH b AS (SELECT DISTINCT doc_id // 16 AS block FROM documents), w AS (SELECT block, (row_number() OVER (ORDER BY md5('3:' || block), block) - 1) // 4 AS win FROM b) SELECT doc_id, doc_id // 16 AS block, win AS window_id, md5('3:row:' || doc_id) AS mark FROM documents JOIN w ON w.block = doc_id // 16")
def block_shuffle(spark, d):
    return etl.block_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", 16, 4, 3).withColumnRenamed("window", "window_id")


@query("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def key_union(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").where("c_nationkey < 5").select("c_custkey")).distinct()
