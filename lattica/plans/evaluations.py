"""Queries on next-token evaluation: embeddings are the logits of a position, 16 positions a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.quantize import LogCodec
from lattica.operators import evaluation
from lattica.operators import grids as G
from lattica.plans.registry import VOX, grids, query, r6, sql_r6, sql_unbin, table

#: Of 64 ids those from 8 to 55 are density ids; their values are half their bin.
FIRST, COUNT, PENALTY = 8, 48, 30.0
_TOK = "tok AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, (vec_id * 7 + 3) % 64 AS token, CASE WHEN vec_id % 5 = 0 THEN 0.5 END AS weight FROM embeddings), nxt AS (SELECT *, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS target FROM tok)"


def _tokens(spark, d):
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.floor(k / 16).alias("seq"), (k % 16).alias("pos"), ((k * 7 + 3) % 64).alias("token"), F.when(k % 5 == 0, 0.5).alias("weight"))


def _logits(spark, d):
    vox = G.unpack(grids(spark, d))
    return vox.select(F.floor(F.col("task_id") / 16).alias("seq"), (F.col("task_id") % 16).alias("pos"), F.col("flat").alias("token"), (F.col("rho") * 20).alias("logit"))


@query(f"WITH {_TOK} SELECT seq, pos, token, target FROM nxt")
def next_token_shift(spark, d):
    return evaluation.next_tokens(_tokens(spark, d), ["seq"]).select("seq", "pos", "token", "target")


@query(f"""
    WITH {VOX}, {_TOK}, l AS (SELECT task_id // 16 AS seq, task_id % 16 AS pos, flat - {FIRST} AS bin, exp(rho * 20 - max(rho * 20) OVER (PARTITION BY task_id)) AS e FROM vox WHERE flat >= {FIRST} AND flat < {FIRST + COUNT}),
    p AS (SELECT *, e / (sum(e) OVER (PARTITION BY seq, pos) + 1e-12) AS p FROM l)
    SELECT p.seq, p.pos, {sql_r6(f"sum(p * abs(bin * 0.5::DOUBLE - greatest(0, least({COUNT - 1}, target - {FIRST})) * 0.5::DOUBLE))")} AS emd
    FROM p JOIN nxt ON nxt.seq = p.seq AND nxt.pos = p.pos WHERE target IS NOT NULL GROUP BY 1, 2""")
def emd_per_voxel(spark, d):
    dist = evaluation.restrict(_logits(spark, d), ["seq", "pos"], FIRST, COUNT)
    out = evaluation.shifted_earth_mover(dist, _tokens(spark, d), ["seq"], lambda b: b * 0.5, FIRST, COUNT)
    return out.select("seq", "pos", r6(F.col("emd")).alias("emd"))


_A, _B, _PAIR = (0, 8), (8, 24), LogCodec(-4.0, 6.0, (2, 4))


@query(f"""
    WITH t AS (SELECT o_custkey % 97 AS seq, o_orderkey AS pos, CASE WHEN (o_orderkey * 7 + o_custkey) % 3 = 0 THEN o_custkey % 8 ELSE 8 + (o_orderkey * 5 + o_custkey) % 17 END AS token, CASE WHEN (o_orderkey + o_custkey) % 3 = 0 THEN o_orderkey % 9 ELSE 7 + o_custkey % 17 END AS pred FROM orders),
    w AS (SELECT seq, lead(token, 1) OVER o AS ta, lead(token, 2) OVER o AS tb, pred AS pa, lead(pred) OVER o AS pb FROM t WINDOW o AS (PARTITION BY seq ORDER BY pos)),
    v AS (SELECT *, pa >= 0 AND pa < 8 AND pb >= 8 AND pb < 24 AS good, ((ta % 4) << 4) | (tb - 8) AS bt, ((pa % 4) << 4) | (pb - 8) AS bp FROM w WHERE ta >= 0 AND ta < 8 AND tb >= 8 AND tb < 24),
    x AS (SELECT seq, good, CASE WHEN ta < 4 THEN 1 ELSE -1 END * ({sql_unbin("bt", -4.0, 6.0, 6)}) AS t, CASE WHEN good THEN CASE WHEN pa < 4 THEN 1 ELSE -1 END * ({sql_unbin("bp", -4.0, 6.0, 6)}) ELSE 0.0 END AS p FROM v)
    SELECT seq, count(*) AS n_voxels, round(avg(abs(t)), 4) AS mean_abs_true, {sql_r6("avg(abs(p - t)) / avg(abs(t))")} AS nmae_mean, {sql_r6("quantile_cont(abs(p - t), 0.5) / avg(abs(t))")} AS nmae_median,
      {sql_r6("quantile_cont(abs(p - t), 0.99) / avg(abs(t))")} AS nmae_p99, count(*) FILTER (NOT good) AS n_bad FROM x GROUP BY 1""")
def pair_nmae(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    token = F.when((o * 7 + c) % 3 == 0, c % 8).otherwise((o * 5 + c) % 17 + 8)
    pred = F.when((o + c) % 3 == 0, o % 9).otherwise(c % 17 + 7)
    rows = table(spark, d, "orders").select((c % 97).alias("seq"), o.alias("pos"), token.alias("token"), pred.alias("pred"))
    pairs = evaluation.voxel_pairs(rows.drop("pred"), rows.drop("token"), ["seq"], _A, _B)
    out = evaluation.pair_errors(pairs, lambda a, b: _PAIR.decode([a, b]), _A, _B, "seq")
    return out.select("seq", "n_voxels", F.round("mean_abs_true", 4).alias("mean_abs_true"), *[r6(F.col(c)).alias(c) for c in ("nmae_mean", "nmae_median", "nmae_p99")], "n_bad")


_MODES = [(mode, kind, only) for mode in ("add", "replace") for kind in ("l1", "emd") for only in (False, True)]


@query(f"""
    WITH {VOX}, {_TOK}, l AS (SELECT task_id // 16 AS seq, task_id % 16 AS pos, flat AS token, rho * 20 AS logit FROM vox),
    j AS (SELECT l.*, target, coalesce(weight, 1.0::DOUBLE) AS w, max(logit) OVER (PARTITION BY l.seq, l.pos) AS top, CASE WHEN l.token >= {FIRST} AND l.token < {FIRST + COUNT} THEN (l.token - {FIRST}) * 0.5::DOUBLE ELSE {PENALTY}::DOUBLE END AS v,
      CASE WHEN target >= {FIRST} AND target < {FIRST + COUNT} THEN (target - {FIRST}) * 0.5::DOUBLE ELSE {PENALTY}::DOUBLE END AS tv FROM l JOIN nxt ON nxt.seq = l.seq AND nxt.pos = l.pos WHERE target IS NOT NULL),
    c AS (SELECT seq, pos, any_value(w) AS w, any_value(target) >= {FIRST} AND any_value(target) < {FIRST + COUNT} AS dense, ln(sum(exp(logit - top))) + any_value(top) - max(logit) FILTER (token = target) AS ce,
      abs(sum(exp(logit - top) * v) / sum(exp(logit - top)) - any_value(tv)) AS l1, sum(exp(logit - top) * abs(v - tv)) / sum(exp(logit - top)) AS emd FROM j GROUP BY 1, 2),
    m AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{k}', {o})" for m, k, o in _MODES)}) AS t(mode, kind, density_only)),
    x AS (SELECT seq % 2 AS part, mode, kind, density_only, w, dense, (CASE WHEN density_only OR mode = 'replace' AND dense THEN 0 ELSE ce END) + 0.7 * CASE WHEN dense THEN CASE kind WHEN 'l1' THEN l1 ELSE emd END ELSE 0 END AS loss FROM c, m)
    SELECT part, mode, kind, density_only, round(sum(loss * w) / greatest(sum(CASE WHEN density_only AND NOT dense THEN 0 ELSE w END), 1), 5) AS loss, count(*) AS positions FROM x GROUP BY ALL""")
def density_aware_losses(spark, d):
    """All modes from one pass over the logits."""
    logits, tokens = _logits(spark, d).withColumn("part", F.col("seq") % 2), _tokens(spark, d).withColumn("part", F.col("seq") % 2)
    each = evaluation.position_losses(logits, tokens, ["part", "seq"], lambda b: b * 0.5, FIRST, COUNT, PENALTY)
    modes = [F.struct(F.lit(m).alias("mode"), F.lit(k).alias("kind"), F.lit(o).alias("density_only"), F.round(evaluation.mean_loss(factor=0.7, mode=m, kind=k, density_only=o), 5).alias("loss")) for m, k, o in _MODES]
    return each.groupBy("part").agg(F.array(*modes).alias("modes"), F.count("*").alias("positions")).select("part", F.inline("modes"), "positions")


@query(f"""
    WITH {VOX}, {_TOK}, l AS (SELECT task_id // 16 AS seq, task_id % 16 AS pos, flat - {FIRST} AS bin, exp(rho * 20 - max(rho * 20) OVER (PARTITION BY task_id)) AS e FROM vox WHERE flat >= {FIRST} AND flat < {FIRST + COUNT}),
    p AS (SELECT *, e / (sum(e) OVER (PARTITION BY seq, pos) + 1e-12) AS p FROM l),
    c AS (SELECT p.seq, p.pos, any_value(greatest(0, least({COUNT - 1}, target - {FIRST})) * 0.5::DOUBLE) AS t, sum(p * bin * 0.5::DOUBLE) AS m, sum(p * abs(bin * 0.5::DOUBLE - greatest(0, least({COUNT - 1}, target - {FIRST})) * 0.5::DOUBLE)) AS emd
          FROM p JOIN nxt ON nxt.seq = p.seq AND nxt.pos = p.pos WHERE target IS NOT NULL GROUP BY 1, 2)
    SELECT seq, count(*) AS n_cells, {sql_r6('avg(abs(t - m))')} AS mae, {sql_r6('avg(abs(t - m)) / greatest(avg(abs(t)), 1e-30)')} AS nmae, {sql_r6('avg(emd)')} AS mean_emd, {sql_r6('avg(emd) / greatest(avg(abs(t)), 1e-30)')} AS nemd FROM c GROUP BY 1""")
def material_errors_emd(spark, d):
    """Errors of the mean decoder and of the whole distribution, for each sequence."""
    dist = evaluation.restrict(_logits(spark, d), ["seq", "pos"], FIRST, COUNT)
    cells = evaluation.predicted_cells(dist, _tokens(spark, d), ["seq"], lambda b: b * 0.5, FIRST, COUNT)
    out = evaluation.material_errors(cells, "seq", "true", "pred", "emd")
    return out.select("seq", "n_cells", *[r6(F.col(c)).alias(c) for c in ("mae", "nmae", "mean_emd", "nemd")])
