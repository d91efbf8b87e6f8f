"""Queries on atomic baselines and on encodings of grids that compose."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.quantize import LogCodec
from lattica.operators import grids as G
from lattica.operators import promolecules as P
from lattica.operators import transforms as T
from lattica.plans.numeric import _CUT, _DFT
from lattica.plans.registry import VOX, grids, query, r6, sql_bin, sql_r6, sql_unbin, table

# The outer shells of the elements up to 50 that depart from the filling rule, as (z, n, l, electrons).
_OUTER = "(24, 3, 2, 5), (24, 4, 0, 1), (29, 3, 2, 10), (29, 4, 0, 1), (41, 4, 2, 4), (41, 5, 0, 1), (42, 4, 2, 5), (42, 5, 0, 1), (44, 4, 2, 7), (44, 5, 0, 1), (45, 4, 2, 8), (45, 5, 0, 1), (46, 4, 2, 10), (46, 5, 0, 0), (47, 4, 2, 10), (47, 5, 0, 1)"
#: The shells of every element up to 50, in SQL: the rule, where no outer shell is listed.
_SHELLS = f"""sub AS (SELECT n, l, 4 * l + 2 AS room, CAST(coalesce(sum(4 * l + 2) OVER (ORDER BY n + l, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM range(1, 9) a(n), range(0, 4) b(l) WHERE l < n),
own AS (SELECT * FROM (VALUES {_OUTER}) AS t(z, n, l, e)),
shell AS (SELECT z, n, l, least(room, z - before) AS e FROM range(1, 51) c(z), sub WHERE z > before AND NOT EXISTS (SELECT 1 FROM own WHERE own.z = c.z AND own.n = sub.n AND own.l = sub.l) UNION ALL SELECT z, n, l, e FROM own WHERE e > 0),
scr AS (SELECT t.z, t.n, t.l, t.e, t.z - sum(CASE WHEN o.n > t.n THEN 0.0 WHEN o.n = t.n AND (t.l < 2 AND o.l < 2 OR t.l >= 2 AND o.l = t.l) THEN CASE WHEN t.n = 1 THEN 0.30 ELSE 0.35 END * (o.e - CASE WHEN o.l = t.l THEN 1 ELSE 0 END)
  WHEN t.l < 2 THEN CASE WHEN o.n = t.n - 1 THEN 0.85 * o.e WHEN o.n < t.n OR o.l > 1 THEN 1.0 * o.e ELSE 0.0 END WHEN o.n < t.n OR o.l < t.l THEN 1.0 * o.e ELSE 0.0 END)::DOUBLE AS zeff
  FROM shell t JOIN shell o ON o.z = t.z GROUP BY t.z, t.n, t.l, t.e),
alp AS (SELECT *, zeff / ([1.0, 2.0, 3.0, 3.7, 4.0, 4.2, 4.3][n]::DOUBLE * 0.5291772109::DOUBLE) AS alpha FROM scr)"""


@query(f"WITH {_SHELLS} SELECT z, n, l, e AS electrons, {sql_r6('zeff')} AS z_eff, {sql_r6('alpha')} AS alpha FROM alp WHERE z IN (SELECT p_size FROM part)")
def slater_screening(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_size").cast("int").alias("z")).distinct()
    rows = P.screened(P.shells(spark, 50)).join(sizes, "z", "left_semi")
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("z", "n", "l", "electrons")], r6(F.col("z_eff")).alias("z_eff"), r6(F.col("alpha")).alias("alpha"))


# A cell that is not cubic, with three atoms in it.
_CELL = [[4.0, 0.0, 0.0], [0.5, 4.0, 0.0], [0.2, 0.3, 4.5]]
_ATOMS = [(6, 0.25, 0.25, 0.25), (8, 0.7, 0.6, 0.9), (1, 0.1, 0.5, 0.4)]
_FAR = f"""atm AS (SELECT * FROM (VALUES {", ".join(map(str, _ATOMS))}) AS t(z, fx, fy, fz)),
diff AS (SELECT task_id, flat, rho, z, ix / 4.0::DOUBLE - fx::DOUBLE AS a, iy / 4.0::DOUBLE - fy::DOUBLE AS b, iz / 4.0::DOUBLE - fz::DOUBLE AS c FROM vox, atm),
near AS (SELECT task_id, flat, rho, z, a - round_even(a, 0) AS a, b - round_even(b, 0) AS b, c - round_even(c, 0) AS c FROM diff),
far AS (SELECT task_id, flat, rho, z, sqrt(pow({" + ".join(f"{v} * {row[0]}" for v, row in zip("abc", _CELL, strict=True))}, 2) + pow({" + ".join(f"{v} * {row[1]}" for v, row in zip("abc", _CELL, strict=True))}, 2) + pow({" + ".join(f"{v} * {row[2]}" for v, row in zip("abc", _CELL, strict=True))}, 2)) AS r FROM near)"""
_GAUSS, _SLATER = "z * pow(2 * pi() * 0.16, -1.5) * exp(-r * r / 0.32)", "least(z, 2) * pow(2 * (CASE WHEN z = 1 THEN 1 ELSE z - 0.3 END) / 0.5291772109, 3) / (8 * pi()) * exp(-2 * (CASE WHEN z = 1 THEN 1 ELSE z - 0.3 END) / 0.5291772109 * r) + greatest(z - 2, 0) * pow(2 * pi() * 0.25, -1.5) * exp(-r * r / 0.5)"


def _baseline(spark, d, model):
    packed = grids(spark, d)
    atoms = spark.createDataFrame(_ATOMS, "z int, fx double, fy double, fz double")
    cell = F.array(*[F.array(*map(F.lit, row)) for row in _CELL])
    placed = packed.select("task_id").crossJoin(F.broadcast(atoms))  # broadcast: three atoms
    return P.packed_baseline(packed.withColumn("cell", cell), placed, model)


def _by_voxel(rows):
    return rows.select("task_id", F.posexplode("baseline").alias("flat", "baseline")).select("task_id", F.col("flat").cast("long").alias("flat"), r6(F.col("baseline")).alias("baseline"))


@query(f"WITH {VOX}, {_FAR} SELECT task_id, flat, {sql_r6('sum(' + _GAUSS + ')')} AS baseline FROM far GROUP BY 1, 2")
def promolecule_general_cell(spark, d):
    return _by_voxel(_baseline(spark, d, P.Gaussian()))


@query(f"WITH {VOX}, {_FAR} SELECT task_id, {sql_r6('sum(b)')} AS total, {sql_r6('sum(abs(rho - b))')} AS off FROM (SELECT task_id, flat, any_value(rho) AS rho, sum({_SLATER}) AS b FROM far GROUP BY 1, 2) GROUP BY 1")
def promolecule_by_voxel(spark, d):
    """The same sums over voxel rows, for grids too large for one row."""
    packed = grids(spark, d)
    atoms = packed.select("task_id").crossJoin(F.broadcast(spark.createDataFrame(_ATOMS, "z int, fx double, fy double, fz double")))  # broadcast: three atoms
    cell = F.array(*[F.array(*map(F.lit, row)) for row in _CELL])
    rows = P.baseline(G.unpack(packed), atoms, packed.select("task_id", "nx", "ny", "nz", cell.alias("cell")), P.Slater())
    return rows.groupBy("task_id").agg(r6(F.sum("baseline")).alias("total"), r6(F.sum(F.abs(F.col("rho") - F.col("baseline")))).alias("off"))


@query(f"WITH {VOX}, {_FAR} SELECT task_id, flat, {sql_r6('sum(' + _SLATER + ')')} AS baseline FROM far GROUP BY 1, 2")
def promolecule_slater(spark, d):
    return _by_voxel(_baseline(spark, d, P.Slater()))


def _multishell(which: str) -> str:
    return f"""WITH {VOX}, {_FAR}, {_SHELLS}, use AS (SELECT *, max(n) OVER (PARTITION BY z) AS top FROM alp),
    s AS (SELECT task_id, flat, any_value(rho) AS rho, sum(e * pow(2 * alpha, 2 * n + 1) / ([2, 24, 720, 40320, 3628800, 479001600][n] * 4 * pi()) * pow(r, 2 * n - 2) * exp(-2 * alpha * r)) AS b FROM far JOIN use USING (z) {which} GROUP BY 1, 2)"""


@query(f"{_multishell('WHERE n = top')} SELECT task_id, flat, {sql_r6('b')} AS baseline FROM s")
def promolecule_multishell(spark, d):
    return _by_voxel(_baseline(spark, d, P.MultiShell()))


@query(f"{_multishell('')} SELECT task_id, {sql_r6('sum(abs(rho - b))')} AS delta_mass FROM s GROUP BY 1")
def delta_multishell(spark, d):
    off = F.aggregate(F.zip_with("density", "baseline", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return _baseline(spark, d, P.MultiShell(valence_only=False)).select("task_id", r6(off).alias("delta_mass"))


# ---- encodings --------------------------------------------------------------------------------------

_CODEC = LogCodec(-4.0, 3.0, (4, 4))


def _signed(x: str) -> str:
    """SQL of a value through the codec."""
    return f"CASE WHEN {x} >= 0 THEN 1 ELSE -1 END * ({sql_unbin(f'({sql_bin(x, -4.0, 3.0, 8)})', -4.0, 3.0, 8)})"


def _error_sql(approx: str, tokens: str, source: str) -> str:
    return f"SELECT task_id, round(sum(abs(rho - {approx})) / sum(abs(rho)), 5) AS nmae, CAST({tokens} AS BIGINT) AS tokens FROM {source} GROUP BY 1"


def _errors(spark, d, transform, packed=None):
    out = T.round_trip(transform, grids(spark, d) if packed is None else packed)
    return out.select("task_id", F.round(T.relative_error(out), 5).alias("nmae"), "tokens")


@query(f"WITH {VOX} {_error_sql('CAST(CAST(rho AS FLOAT) AS DOUBLE)', '64 * 3', 'vox')}")
def transform_direct(spark, d):
    return _errors(spark, d, T.Direct())


@query(f"WITH {VOX} {_error_sql(_signed('rho'), '64 * 2', 'vox')}")
def transform_coded(spark, d):
    return _errors(spark, d, T.Coded(_CODEC))


@query(f"WITH {_CUT} {_error_sql('CASE WHEN kept THEN rho ELSE 0 END', '16 * 6', 'k')}")
def transform_cutoff(spark, d):
    return _errors(spark, d, T.Cutoff(0.25))


@query(f"WITH {VOX}, p AS (SELECT *, avg(rho) OVER (PARTITION BY task_id, ix // 2, iy // 2, iz // 2) AS m FROM vox) {_error_sql(_signed('m'), '8 * 2', 'p')}")
def transform_pooled_coded(spark, d):
    return _errors(spark, d, T.Pooled(T.Coded(_CODEC), 2))


_INVERSE = """w AS (SELECT vox.task_id, flat, any_value(rho) AS rho, sum(CASE WHEN kz = 1 THEN 2 ELSE 1 END * (l.re * cos(2 * pi() * (kx * ix + ky * iy + kz * iz) / 4.0) - l.im * sin(2 * pi() * (kx * ix + ky * iy + kz * iz) / 4.0))) / 64 AS back
FROM vox JOIN {0} l ON l.task_id = vox.task_id WHERE l.rank <= 12 GROUP BY 1, 2)"""


@query(f"WITH {_DFT}, {_INVERSE.format('l')} SELECT task_id, round(sum(abs(rho - back)) / sum(abs(rho)), 4) AS nmae FROM w GROUP BY 1")
def fourier_lowpass(spark, d):
    out = T.round_trip(T.Fourier(0.25), grids(spark, d))
    return out.select("task_id", F.round(T.relative_error(out), 4).alias("nmae"))


_CODED = f"lc AS (SELECT task_id, kx, ky, kz, rank, {_signed('re')} AS re, {_signed('im')} AS im FROM (SELECT task_id, kx, ky, kz, rank, CAST(CAST(CASE WHEN abs(re) < 1e-13 THEN 0 ELSE re END AS FLOAT) AS DOUBLE) AS re, CAST(CAST(CASE WHEN abs(im) < 1e-13 THEN 0 ELSE im END AS FLOAT) AS DOUBLE) AS im FROM l))"


@query(f"WITH {_DFT}, {_CODED}, {_INVERSE.format('lc')} SELECT task_id, round(sum(abs(rho - back)) / sum(abs(rho)), 3) AS nmae, CAST(12 * 7 AS BIGINT) AS tokens FROM w GROUP BY 1")
def fourier_coded(spark, d):
    out = T.round_trip(T.Fourier(0.25, _CODEC), grids(spark, d))
    return out.select("task_id", F.round(T.relative_error(out), 3).alias("nmae"), "tokens")


@query(f"""{_multishell('WHERE n = top')}, p AS (SELECT task_id, rho, b * 72 AS b FROM s) SELECT task_id, round(sum(abs(rho - (b + {_signed('(rho - b)')}))) / sum(abs(rho)), 4) AS nmae, CAST(64 * 2 + 30 AS BIGINT) AS tokens FROM p GROUP BY 1""")
def transform_delta_coded(spark, d):
    cell = F.array(*[F.array(*map(F.lit, row)) for row in _CELL])
    based = _baseline(spark, d, P.MultiShell()).withColumn("baseline", F.transform("baseline", lambda x: x * P.volume(cell)))
    out = T.round_trip(T.Delta(T.Coded(_CODEC), atoms=3), based)
    return out.select("task_id", F.round(T.relative_error(out), 4).alias("nmae"), "tokens")
