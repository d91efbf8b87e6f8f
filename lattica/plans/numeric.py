"""Queries on codecs, quantizers, grids and their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.quantize import LogCodec
from lattica.operators import grids as G
from lattica.operators import lmq
from lattica.operators import promolecules as P
from lattica.operators import transforms as T
from lattica.plans.registry import VOX, grids, query, r6, sql_bin, sql_r6, sql_unbin, table

THREE, TWO, ONE = LogCodec.three_bytes(-4.0, 6.0), LogCodec.two_tokens(-4.0, 6.0), LogCodec.one_token(-4.0, 6.0)
_PRICE = "l_orderkey, l_linenumber"


@query(f"""
    WITH b AS (SELECT l_returnflag, l_extendedprice AS v, {sql_bin("l_extendedprice", -4.0, 6.0, 20)} AS b FROM lineitem),
    r AS (SELECT l_returnflag, v, {sql_unbin("b", -4.0, 6.0, 20)} AS w FROM b)
    SELECT l_returnflag, count(*) AS n, {sql_r6("sum(abs(v - w)) / sum(abs(v)) * 1000000")} AS nmae_ppm FROM r GROUP BY 1""")
def fp16_codec_roundtrip(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v")).withColumn("w", TWO.round_trip(F.col("v")))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.sum(F.abs(F.col("v") - F.col("w"))) / F.sum(F.abs("v")) * 1000000).alias("nmae_ppm"))


def _encode(codec, bits, names):
    b = sql_bin("v", -4.0, 6.0, sum(bits))
    shift, parts = sum(bits), []
    for i, (n, w) in enumerate(zip(names, bits, strict=True)):
        shift -= w
        chunk = f"((b >> {shift}) & {(1 << w) - 1})"
        parts.append(f"{chunk} + CASE WHEN v >= 0 THEN 0 ELSE {1 << w} END AS {n}" if i == 0 else f"{chunk} AS {n}")
    return f"WITH x AS (SELECT c_custkey, c_acctbal AS v FROM customer), y AS (SELECT *, {b} AS b FROM x) SELECT c_custkey, {', '.join(parts)} FROM y"


def _encoded(spark, d, codec, names):
    return table(spark, d, "customer").select("c_custkey", *[c.alias(n) for c, n in zip(codec.encode(F.col("c_acctbal")), names, strict=True)])


@query(_encode(THREE, (8, 8, 8), ["t0", "t1", "t2"]))
def fp16_encode_3byte(spark, d):
    return _encoded(spark, d, THREE, ["t0", "t1", "t2"])


@query(_encode(TWO, (8, 12), ["t0", "t1"]))
def fp16_encode_2token(spark, d):
    return _encoded(spark, d, TWO, ["t0", "t1"])


@query(_encode(ONE, (15,), ["t0"]))
def fp16_encode_1token(spark, d):
    return _encoded(spark, d, ONE, ["t0"])


@query(f"""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS v FROM lineitem), y AS (SELECT *, {sql_bin("v", -4.0, 6.0, 32)} AS b FROM x)
    SELECT {_PRICE}, (b >> 24) & 255 AS t0, (b >> 16) & 255 AS t1, (b >> 8) & 255 AS t2, b & 255 AS t3, {sql_r6(sql_unbin("b", -4.0, 6.0, 32))} AS back FROM y""")
def fp16_unsigned(spark, d):
    chunks = THREE.encode_unsigned(F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(f"t{i}") for i, c in enumerate(chunks)], r6(THREE.decode_unsigned(chunks)).alias("back"))


@query("""
    SELECT l_returnflag, round(log10(quantile_cont(abs(l_discount), 0.0001)) - 0.05, 6) AS log_min, round(log10(quantile_cont(abs(l_discount), 0.9999)) + 0.05, 6) AS log_max
    FROM lineitem WHERE abs(l_discount) > 0 GROUP BY 1""")
def fp16_range_fit(spark, d):
    return lmq.log_range(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", padding=0.05).select("l_returnflag", F.round("log_min", 6).alias("log_min"), F.round("log_max", 6).alias("log_max"))


_BINS = 4096
_HIST = f"""h0 AS (SELECT CAST(least({_BINS - 1}, floor((ln(greatest(1e-6, least(1e5, abs(l_extendedprice)))) - ln(1e-6)) / (ln(1e5) - ln(1e-6)) * {_BINS})) AS BIGINT) AS bin FROM lineitem WHERE l_extendedprice IS NOT NULL),
h AS (SELECT bin, count(*) AS n, exp(ln(1e-6) + (bin + 0.5) / {_BINS}.0 * (ln(1e5) - ln(1e-6))) AS centre FROM h0 GROUP BY 1)"""
_BOUNDS = [2000.0, 10000.0, 30000.0, 30000.0, 60000.0]
_ASSIGN = "(" + " + ".join(f"CASE WHEN centre >= {b} THEN 1 ELSE 0 END" for b in _BOUNDS) + ")"


def _hist(spark, d):
    return lmq.histogram(table(spark, d, "lineitem"), "l_extendedprice", bins=_BINS)


@query(f"WITH {_HIST} SELECT bin, n, {sql_r6('centre')} AS centre FROM h")
def lmq_fine_histogram(spark, d):
    return _hist(spark, d).select("bin", "n", r6(F.col("centre")).alias("centre"))


@query(f"""
    WITH {_HIST}, c AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM h),
    q AS (SELECT unnest(range(1, 16)) AS q)
    SELECT q, {sql_r6('min(centre)')} AS boundary FROM q JOIN c ON cdf >= q / 16.0::DOUBLE GROUP BY 1""")
def lmq_equal_mass_bounds(spark, d):
    return lmq.equal_mass(_hist(spark, d), 16).select("q", r6(F.col("boundary")).alias("boundary"))


@query(f"WITH {_HIST} SELECT CAST({_ASSIGN} AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(centre * n) / sum(n), 4) AS recon FROM h GROUP BY 1")
def lmq_one_iteration(spark, d):
    return lmq.lloyd_step(_hist(spark, d), _BOUNDS).select("bin", "n", F.round("recon", 4).alias("recon"))


@query(f"""
    WITH {_HIST}, a AS (SELECT *, CAST({_ASSIGN} AS BIGINT) AS b FROM h),
    r AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY centre ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY b) / 2.0 AS half FROM a)
    SELECT b AS bin, {sql_r6('min(centre)')} AS median FROM r WHERE run >= half GROUP BY 1""")
def lmq_bin_median(spark, d):
    return lmq.bin_medians(_hist(spark, d), _BOUNDS).select("bin", r6(F.col("median")).alias("median"))


_RECON = [1000.0, 5000.0, 20000.0, 25000.0, 45000.0, 80000.0]


@query(f"""
    WITH a AS (SELECT l_shipdate, l_extendedprice AS v, {_ASSIGN.replace('centre', 'least(90000.0, greatest(0.0, l_extendedprice))')} AS b FROM lineitem)
    SELECT CAST(b AS BIGINT) AS bin, count(*) AS n, round(sum(abs(v - [{', '.join(map(str, _RECON))}][b + 1])) / sum(abs(v)), 6) AS nmae FROM a GROUP BY 1""")
def lmq_encode_decode(spark, d):
    codec = lmq.LloydMax(_BOUNDS, _RECON, 90000.0)
    rows = codec.encode(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("l_extendedprice") - codec.decode(F.col("bin")))) / F.sum(F.abs("l_extendedprice")), 6).alias("nmae"))


@query(f"""
    WITH {_HIST}, c AS (SELECT bin, centre, lead(centre) OVER (ORDER BY bin) AS nxt, lag(centre) OVER (ORDER BY bin) AS prv, row_number() OVER (ORDER BY bin) - 1 AS i, count(*) OVER () AS k FROM h)
    SELECT bin, {sql_r6('(centre + nxt) / 2')} AS midpoint, {sql_r6('coalesce(nxt - centre, centre - prv)')} AS width, {sql_r6('i / CAST(k - 1 AS DOUBLE)')} AS rank FROM c""")
def lmq_midpoints_widths(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("bin")  # over the histogram's bins
    h = _hist(spark, d)
    return h.select("bin", r6((F.col("centre") + F.lead("centre").over(w)) / 2).alias("midpoint"), r6(F.coalesce(F.lead("centre").over(w) - F.col("centre"), F.col("centre") - F.lag("centre").over(w))).alias("width"), r6(F.percent_rank().over(w)).alias("rank"))


@query(f"WITH {VOX} SELECT task_id, flat, ix, iy, iz, {sql_r6('rho')} AS rho FROM vox")
def grid_unpack(spark, d):
    return G.unpack(grids(spark, d)).withColumn("rho", r6(F.col("rho")))


@query(f"""WITH {VOX} SELECT task_id, count(*) AS n_voxels, {sql_r6('min(rho)')} AS low, {sql_r6('max(rho)')} AS high, {sql_r6('max(rho) - min(rho)')} AS spread, {sql_r6('sum(rho)')} AS total, {sql_r6('sum(abs(rho))')} AS mass FROM vox GROUP BY 1""")
def grid_stats(spark, d):
    s = G.stats(grids(spark, d))
    return s.select("task_id", "n_voxels", *[r6(F.col(c)).alias(c) for c in ("low", "high", "spread", "total", "mass")])


@query(f"WITH {VOX} SELECT task_id, ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, {sql_r6('avg(rho)')} AS rho FROM vox GROUP BY ALL")
def avg_pool(spark, d):
    return G.avg_pool(G.unpack(grids(spark, d)), 2).withColumn("rho", r6(F.col("rho")))


@query(f"""
    WITH {VOX}, p AS (SELECT *, avg(rho) OVER (PARTITION BY task_id, ix // 2, iy // 2, iz // 2) AS approx FROM vox)
    SELECT task_id, {sql_r6('sum(abs(rho - approx)) / sum(abs(rho))')} AS nmae FROM p GROUP BY 1""")
def upsample_roundtrip(spark, d):
    vox = G.unpack(grids(spark, d))
    both = G.upsample(G.avg_pool(vox, 2), vox, 2)
    return both.groupBy("task_id").agg(r6(F.sum(F.abs(F.col("rho") - F.col("approx"))) / F.sum(F.abs("rho"))).alias("nmae"))


_CUT = f"""{VOX}, k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rho DESC, flat) <= greatest(1, least(64, CAST(round_even(64 * 0.25, 0) AS BIGINT))) AS kept FROM vox)"""


@query(f"WITH {_CUT} SELECT task_id, flat, {sql_r6('rho')} AS rho FROM k WHERE kept")
def cutoff_topk_fraction(spark, d):
    return G.cutoff(G.unpack(grids(spark, d)), fraction=0.25).where("kept").select("task_id", "flat", r6(F.col("rho")).alias("rho"))


@query(f"WITH {VOX} SELECT task_id, count(*) FILTER (rho >= 0.1) AS n_kept, {sql_r6('coalesce(sum(rho) FILTER (rho >= 0.1), 0)')} AS total FROM vox GROUP BY 1")
def cutoff_threshold(spark, d):
    rows = G.cutoff(G.unpack(grids(spark, d)), threshold=0.1)
    return rows.groupBy("task_id").agg(F.count_if("kept").alias("n_kept"), r6(F.sum("approx")).alias("total"))


@query(f"WITH {_CUT} SELECT task_id, {sql_r6('sum(abs(rho)) FILTER (kept) / sum(abs(rho))')} AS mass_captured, count(*) FILTER (kept) AS n_kept, {sql_r6('min(rho) FILTER (kept)')} AS effective_threshold FROM k GROUP BY 1")
def mass_captured(spark, d):
    m = G.mass_captured(G.cutoff(G.unpack(grids(spark, d)), fraction=0.25))
    return m.select("task_id", r6(F.col("mass_captured")).alias("mass_captured"), "n_kept", r6(F.col("effective_threshold")).alias("effective_threshold"))


_METRICS = """m AS (SELECT task_id, sum(abs(rho)) AS sp, sum(abs(approx)) AS sq, greatest(max(abs(rho)) * 1e-8, 1e-12) AS eps FROM pair GROUP BY 1),
t AS (SELECT pair.*, sp, sq, eps, abs(rho) AS p, abs(approx) AS q, abs(rho) / sp AS u, abs(approx) / sq AS v FROM pair JOIN m USING (task_id)),
x AS (SELECT task_id, sum(abs(rho - approx)) / first(sp) AS nmae, sum(pow(p - q, 2) / greatest(p, eps)) / first(sp) AS chi_sq,
  sqrt(0.5 * sum(pow(sqrt(p) - sqrt(q), 2))) / sqrt(first(sp)) AS hellinger, avg(abs(p - q) / greatest(p, eps)) AS weighted_mae,
  greatest(0, (sum(CASE WHEN u > 0 THEN u * ln(u / ((u + v) / 2)) ELSE 0 END) + sum(CASE WHEN v > 0 THEN v * ln(v / ((u + v) / 2)) ELSE 0 END)) / 2) AS jsd FROM t GROUP BY 1)
SELECT task_id, round(nmae, 5) AS nmae, round(chi_sq, 5) AS chi_sq, round(hellinger, 5) AS hellinger, round(weighted_mae, 5) AS weighted_mae, round(jsd, 5) AS jsd FROM x"""


@query(f"WITH {_CUT}, pair AS (SELECT task_id, rho, CASE WHEN kept THEN rho ELSE 0 END AS approx FROM k), {_METRICS}")
def metrics_all5(spark, d):
    out = G.packed_metrics(T.round_trip(T.Cutoff(0.25), grids(spark, d)))
    return out.select("task_id", *[F.round(c, 5).alias(c) for c in ("nmae", "chi_sq", "hellinger", "weighted_mae", "jsd")])


@query(f"WITH {_CUT}, pair AS (SELECT task_id, rho, CASE WHEN kept THEN rho ELSE 0 END AS approx FROM k), {_METRICS}")
def metrics_by_voxel(spark, d):
    m = G.error_metrics(G.cutoff(G.unpack(grids(spark, d)), fraction=0.25).select("task_id", "rho", "approx"), ["task_id"])
    return m.select("task_id", *[F.round(c, 5).alias(c) for c in ("nmae", "chi_sq", "hellinger", "weighted_mae", "jsd")])


_DFT = f"""{VOX}, f AS (SELECT vox.*, kx, ky, kz, 2 * pi() * (kx * ix / 4.0 + ky * iy / 4.0 + kz * iz / 4.0) AS ph FROM vox, range(4) a(kx), range(4) b(ky), range(3) c(kz)),
s AS (SELECT task_id, kx, ky, kz, CAST(pow(CASE WHEN kx > 2 THEN kx - 4 ELSE kx END, 2) + pow(CASE WHEN ky > 2 THEN ky - 4 ELSE ky END, 2) + kz * kz AS BIGINT) AS g2, sum(rho * cos(ph)) AS re, -sum(rho * sin(ph)) AS im FROM f GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY g2, kx, ky, kz) AS rank FROM s)"""


@query(f"WITH {_DFT} SELECT task_id, kx, ky, kz, g2, round(re * re + im * im, 4) + 0.0 AS power FROM l WHERE rank <= 8")
def dft_magnitude_lowg(spark, d):
    low = G.lowest_frequencies(G.dft(G.unpack(grids(spark, d)), 4, 4, 4), 8)
    return low.select("task_id", *[F.col(k).cast("long").alias(k) for k in ("kx", "ky", "kz")], "g2", (F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 4) + 0.0).alias("power"))


@query("""
    WITH n AS (SELECT vec_id AS task_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings), k AS (SELECT *, greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS k FROM n)
    SELECT task_id, n * 3 AS direct, k * 6 AS cutoff, k * 9 AS fourier, n * 10 AS delta FROM k""")
def token_counts(spark, d):
    from lattica.functions.formulas import token_counts as counts

    rows = grids(spark, d).select("task_id", F.size("density").cast("long").alias("n")).withColumn("k", G.kept_count(F.col("n"), 0.05))
    return rows.select("task_id", *[c.cast("long").alias(n) for n, c in counts(F.col("n"), F.col("k")).items()])


@query(f"""
    WITH {VOX}, atm AS (SELECT task_id, z, fx, fy, fz FROM (SELECT DISTINCT task_id FROM vox), (VALUES (6, 0.25, 0.25, 0.25), (8, 0.75, 0.75, 0.75)) AS t(z, fx, fy, fz)),
    dd AS (SELECT vox.task_id, flat, rho, z, ix / 4.0 - fx AS dx, iy / 4.0 - fy AS dy, iz / 4.0 - fz AS dz FROM vox JOIN atm USING (task_id)),
    r AS (SELECT task_id, flat, rho, z, pow((dx - round_even(dx, 0)) * 4, 2) + pow((dy - round_even(dy, 0)) * 4, 2) + pow((dz - round_even(dz, 0)) * 4, 2) AS r2 FROM dd)
    SELECT task_id, flat, {sql_r6('sum(z * pow(2 * pi() * 0.16, -1.5) * exp(-r2 / 0.32))')} AS baseline FROM r GROUP BY 1, 2""")
def promolecule_baseline(spark, d):
    atoms = spark.createDataFrame([(6, 0.25, 0.25, 0.25), (8, 0.75, 0.75, 0.75)], "z int, fx double, fy double, fz double")
    placed = grids(spark, d).select("task_id").crossJoin(F.broadcast(atoms))  # broadcast: two atoms
    rows = P.packed_baseline(grids(spark, d).withColumn("cell", P.cube(4.0)), placed, P.Gaussian())
    return rows.select("task_id", F.posexplode("baseline").alias("flat", "b")).select("task_id", F.col("flat").cast("long").alias("flat"), r6(F.col("b")).alias("baseline"))
