"""Queries on array groups, bricks of large grids, and exact order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import bricks as B
from lattica.operators import lmq, pencils, selection
from lattica.plans.numeric import _DFT
from lattica.plans.physics import _INVERSE
from lattica.plans.registry import VOX, grids, query, r6, sql_r6, table
from lattica.sources import arrays, chgcar, manifested
from lattica.sources.scratch import checkpointed, new_path


def _groups(spark, d, version):
    """The embeddings as array groups of 4 x 4 x 4 cells in two chunks; labels stand in the metadata, as text in one format and as an object in the other."""
    path = new_path(spark, "groups")
    about = F.to_json(F.struct(F.concat(F.lit("mp-"), F.col("task_id").cast("string")).alias("task_id"), "label"))
    rows = grids(spark, d).select(F.concat(F.lit("file"), F.col("task_id").cast("string")).alias("task_id"), "nx", "ny", "nz", "density", F.to_json(F.struct("label")).alias("structure"), about.alias("metadata"))
    arrays.write_groups(rows, path, version=version, chunk="2,4,4", codec="zstd" if version == 3 else "gzip")
    return path


_GROUP_SQL = f"""WITH {VOX} SELECT 'mp-' || task_id AS task_id, CAST(4 AS INT) AS nx, CAST(4 AS INT) AS ny, CAST(4 AS INT) AS nz, '{{"label":' || any_value(label) || '}}' AS structure, {sql_r6('sum(rho)')} AS total, {sql_r6('max(rho)')} AS high FROM vox GROUP BY task_id"""


def _scanned(spark, d, version):
    read = arrays.read_groups(spark, _groups(spark, d, version), groups=64)
    total = F.aggregate("density", F.lit(0.0), lambda s, x: s + x)
    return read.where("error is null").select("task_id", "nx", "ny", "nz", "structure", r6(total).alias("total"), r6(F.array_max("density")).alias("high"))


@query(_GROUP_SQL)
def array_group_scan(spark, d):
    return _scanned(spark, d, 3)


@query(_GROUP_SQL)
def array_group_scan_v2(spark, d):
    return _scanned(spark, d, 2)


@query(f"""WITH {VOX}, p AS (SELECT task_id, rho FROM vox WHERE ix < 2 AND iy IN (3, 0) AND iz IN (2, 3))
SELECT 'mp-' || task_id AS task_id, {sql_r6('sum(rho)')} AS total, CAST(1 AS INT) AS chunks_read FROM p GROUP BY task_id""")
def array_group_patch(spark, d):
    """A periodic 2^3 patch of every group opens one of its two chunks."""
    read = arrays.read_groups(spark, _groups(spark, d, 3), groups=64, offset="0,3,2", size="2,2,2")
    wrapped = F.aggregate("density", F.lit(0.0), lambda s, x: s + x)
    return read.select("task_id", r6(wrapped).alias("total"), "chunks_read")


@query("SELECT 'mp-' || vec_id AS task_id, len(embedding) AS cells FROM embeddings WHERE vec_id IN (3, 77, 191)")
def array_group_by_id(spark, d):
    """Ids reach the source: no chunk of another group is opened."""
    read = arrays.read_groups(spark, _groups(spark, d, 3), "task_id string, density array<double>", ids=["mp-3", "mp-77", "mp-191"], groups=64)
    return read.select("task_id", F.size("density").cast("long").alias("cells"))


# ---- bricks -----------------------------------------------------------------------------------------


def _bricks(spark, d, side=2):
    return B.from_packed(grids(spark, d), side)


@query(f"""WITH {VOX}, o AS (SELECT vec_id AS task_id, vec_id % 4 AS ox, vec_id // 4 % 4 AS oy FROM embeddings),
c AS (SELECT task_id, rho, (ix - ox + 4) % 4 AS x, (iy - oy + 4) % 4 AS y, (iz - 3 + 4) % 4 AS z FROM vox JOIN o USING (task_id))
SELECT task_id, {sql_r6('sum(rho)')} AS total, {sql_r6('sum(rho * (9 * x + 3 * y + z))')} AS moment FROM c WHERE x < 3 AND y < 3 AND z < 3 GROUP BY 1""")
def brick_patches(spark, d):
    """Periodic patches cut from bricks of two cells a side and their halos."""
    corners = table(spark, d, "embeddings").select(F.col("vec_id").alias("task_id"), (F.col("vec_id") % 4).cast("int").alias("ox"), (F.floor(F.col("vec_id") / 4) % 4).cast("int").alias("oy"), F.lit(3).alias("oz"))
    cut = B.cut(_bricks(spark, d), corners, 3)
    moment = F.aggregate(F.transform("patch", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return cut.select("task_id", r6(F.aggregate("patch", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(moment).alias("moment"))


@query(f"WITH {VOX} SELECT task_id, flat, {sql_r6('rho')} AS rho FROM vox")
def brick_stitch(spark, d):
    """Full coverage by tiles of three cells, put together again as bricks."""
    back = B.stitched(B.tiled(_bricks(spark, d), 3), 3, 2)
    return B.to_packed(back).select("task_id", F.posexplode("density").alias("flat", "rho")).select("task_id", F.col("flat").cast("long").alias("flat"), r6(F.col("rho")).alias("rho"))


@query(f"WITH {VOX} SELECT task_id, ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, {sql_r6('avg(rho)')} AS rho FROM vox GROUP BY ALL")
def brick_pool(spark, d):
    pooled = B.pool(_bricks(spark, d), 2)
    return pooled.select("task_id", *(F.col(f"b{a}").cast("long").alias(f"i{a}") for a in "xyz"), r6(F.get("brick", F.lit(0))).alias("rho"))


@query(f"WITH {_DFT}, {_INVERSE.format('l')} SELECT task_id, round(sum(abs(rho - back)) / sum(abs(rho)), 4) AS nmae FROM w GROUP BY 1")
def pencil_lowpass(spark, d):
    """The Fourier low pass of grids in bricks, axis by axis."""
    parts = _bricks(spark, d)
    return B.relative_error(parts, pencils.lowpass(parts, 0.25)).select("task_id", F.round("nmae", 4).alias("nmae"))


# ---- order statistics -------------------------------------------------------------------------------


@query(f"""WITH {_DFT}, c AS (SELECT abs(re) AS m FROM s UNION ALL SELECT abs(im) FROM s), v AS (SELECT abs(rho) AS m FROM vox WHERE abs(rho) > 0)
SELECT 'density' AS channel, round(log10(quantile_cont(m, 0.0001)) - 1, 6) AS log_min, round(log10(quantile_cont(m, 0.9999)) + 1, 6) AS log_max FROM v
UNION ALL SELECT 'fourier', round(log10(quantile_cont(m, 0.0001)) - 1, 6), round(log10(max(m)) + 1, 6) FROM c WHERE m > 1e-9""")
def channel_ranges(spark, d):
    """Ranges of the two channels of a codec: of values by quantiles, of coefficients up to their greatest, as the first one stands far above all others."""
    packed = grids(spark, d)
    spectra = pencils.spectrum(B.from_packed(packed, 4))
    parts = checkpointed(spectra.select(F.explode(F.concat("re", "im")).alias("m")))  # read by each pass
    of = lambda rows, name, **more: lmq.log_range(rows, [], "m", **more).select(F.lit(name).alias("channel"), F.round("log_min", 6).alias("log_min"), F.round("log_max", 6).alias("log_max"))
    return of(packed.select(F.explode("density").alias("m")), "density").union(of(parts, "fourier", high=1.0, least=1e-9))


@query("""WITH v AS (SELECT l_linestatus, quantile_cont(l_extendedprice, [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]) AS v FROM lineitem GROUP BY 1)
SELECT l_linestatus, CAST(unnest([0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]) AS DOUBLE) AS q, round(CAST(unnest(v) AS DOUBLE), 4) AS price FROM v""")
def price_quantiles(spark, d):
    """Exact quantiles of few large groups by narrowing brackets."""
    return selection.quantiles(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]).select("l_linestatus", "q", F.round("value", 4).alias("price"))


# ---- files with a manifest --------------------------------------------------------------------------


@query("""SELECT count(*) FILTER (o_totalprice <= 300000) AS n_rows, min(o_orderkey) FILTER (o_totalprice <= 300000) AS first, max(o_orderkey) FILTER (o_totalprice <= 300000) AS last, count(*) FILTER (o_totalprice > 300000) AS rejects,
    array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (o_totalprice > 300000)[1:50], ',') AS reject_ids, round(sum(o_totalprice) FILTER (o_totalprice <= 300000), 2) AS total FROM orders""")
def manifested_write(spark, d):
    """Orders in sorted files, those beyond a price as rejects: the manifest, and the total of what its files hold."""
    path, rows = new_path(spark, "sorted"), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    manifested.write_sorted(rows, path, "o_orderkey", reject=F.col("o_totalprice") > 300000)
    about = manifested.manifest(spark, path).select(F.col("rows").alias("n_rows"), "first", "last", "rejects", F.array_join("reject_ids", ",").alias("reject_ids"))
    held = manifested.read_sorted(spark, path, rows.schema).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return about.join(F.broadcast(held))  # one row each


# ---- text volumetric files --------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT CAST(task_id AS BIGINT) AS task_id, flat, {sql_r6('rho')} AS rho FROM vox")
def volumetric_text(spark, d):
    """Every embedding as the text of a crystal and its grid, many to a file, read back value by value."""
    path = new_path(spark, "volumes")
    head = "\n 1.0\n 4 0 0\n 0 4 0\n 0 0 4\n C O\n 1 1\nDirect\n 0 0 0\n 0.5 0.5 0.5\n\n 4 4 4\n"
    inner = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda r: F.get("density", ((r % 4) * 16 + F.floor(r / 4) % 4 * 4 + F.floor(r / 16)).cast("int")).cast("string"))
    lines = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(5)), lambda i: F.array_join(F.slice(inner, i, F.lit(5)), " "))
    grids(spark, d).select(F.concat(F.lit("volume "), F.col("task_id").cast("string"), F.lit(head), F.array_join(lines, "\n")).alias("value")).write.text(path)
    rows = chgcar.read_voxels(spark, path, title=r"^volume (\d+)$")
    return rows.select(F.col("title").cast("long").alias("task_id"), "flat", r6(F.col("rho")).alias("rho"))
