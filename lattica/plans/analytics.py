"""Queries on sweeps, evaluation, telemetry, scalar families and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.functions.quantize import LogCodec
from lattica.operators import evaluation, grids as G, series, telemetry
from lattica.plans.registry import VOX, grids, query, r6, sql_bin, sql_r6, sql_unbin, table
from lattica.sources.scratch import new_path, rename_only_file
from lattica.streaming import counters

# ---- sweeps ---------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT CAST(p_size AS BIGINT) AS n_atoms, 40 + p_partkey % 60 AS nx FROM part), c AS (SELECT * FROM (VALUES (8, 8, 3), (8, 12, 2), (15, 0, 1)) AS t(b0, b1, k)), p AS (SELECT unnest([10, 14, 16, 19]) AS p),
    x AS (SELECT b0, b1, p, nx, 36 + 10 * n_atoms + k * p * p * p AS context FROM m, c, p)
    SELECT CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, CAST(p AS INTEGER) AS p, count(*) AS n, count(*) FILTER (context <= 8192 AND p <= nx) AS fits, CAST(max(context) AS BIGINT) AS longest FROM x GROUP BY ALL""")
def sweep_config_grid(spark, d):
    """The materials that each combination of codec and patch size fits: the length within the context, the patch within the grid."""
    codecs = spark.createDataFrame([(8, 8, 3), (8, 12, 2), (15, 0, 1)], "b0 int, b1 int, k int")
    sizes = spark.createDataFrame([(p,) for p in (10, 14, 16, 19)], "p int")
    mats = table(spark, d, "part").select(F.col("p_size").cast("long").alias("n_atoms"), (F.col("p_partkey") % 60 + 40).alias("nx"))
    rows = mats.join(F.broadcast(codecs.join(F.broadcast(sizes))))  # twelve configurations
    context = 36 + 10 * F.col("n_atoms") + (F.col("k") * F.col("p") * F.col("p") * F.col("p")).cast("long")
    return rows.groupBy("b0", "b1", "p").agg(F.count("*").alias("n"), F.count_if((context <= 8192) & (F.col("p") <= F.col("nx"))).alias("fits"), F.max(context).alias("longest"))


_FRACS = (0.05, 0.25, 1.0)
_SWEEP = f"""{VOX}, fr AS (SELECT unnest([{', '.join(map(str, _FRACS))}]) AS fraction),
kk AS (SELECT task_id, label, fraction, rho, row_number() OVER (PARTITION BY task_id, fraction ORDER BY rho DESC, flat) <= greatest(1, CAST(round_even(64 * fraction, 0) AS BIGINT)) AS kept FROM vox, fr),
sw AS (SELECT task_id, label AS category, CAST(fraction AS DOUBLE) AS fraction, 'cutoff-top' AS scheme, count(*) FILTER (kept) * 6 AS tokens, sum(CASE WHEN kept THEN 0 ELSE abs(rho) END) / sum(abs(rho)) AS nmae FROM kk GROUP BY ALL)"""


def _sweep(spark, d):
    vox = G.unpack(grids(spark, d)).join(grids(spark, d).select("task_id", "label"), "task_id")
    rows = vox.select("*", F.explode(F.array(*map(F.lit, _FRACS))).alias("fraction"))
    order = Window.partitionBy("task_id", "fraction").orderBy(F.desc("rho"), "flat")
    kept = F.row_number().over(order) <= F.greatest(F.lit(1), F.rint(F.col("fraction") * 64))
    rows = rows.withColumn("kept", kept)
    return rows.groupBy("task_id", F.col("label").alias("category"), "fraction").agg((F.count_if("kept") * 6).alias("tokens"), (F.sum(F.when(F.col("kept"), 0.0).otherwise(F.abs("rho"))) / F.sum(F.abs("rho"))).alias("nmae")).withColumn("scheme", F.lit("cutoff-top"))


@query(f"WITH {_SWEEP} SELECT scheme, fraction, count(*) AS n, {sql_r6('avg(nmae)')} AS mean, {sql_r6('median(nmae)')} AS median FROM sw GROUP BY 1, 2")
def sweep_by_config(spark, d):
    return _sweep(spark, d).groupBy("scheme", "fraction").agg(F.count("*").alias("n"), r6(F.avg("nmae")).alias("mean"), r6(F.percentile("nmae", F.lit(0.5))).alias("median"))


@query(f"WITH {_SWEEP} SELECT CAST(category AS BIGINT) AS category, count(DISTINCT task_id) AS samples, {sql_r6('avg(nmae) FILTER (fraction = 0.05)')} AS at_5, {sql_r6('avg(nmae) FILTER (fraction = 0.25)')} AS at_25 FROM sw GROUP BY 1")
def sweep_by_category_pivot(spark, d):
    s = _sweep(spark, d)
    wide = s.groupBy("category").pivot("fraction", [0.05, 0.25]).agg(F.avg("nmae"))
    n = s.groupBy("category").agg(F.countDistinct("task_id").alias("samples"))
    return n.join(wide, "category").select(F.col("category").cast("long").alias("category"), "samples", r6(F.col("`0.05`")).alias("at_5"), r6(F.col("`0.25`")).alias("at_25"))


@query(f"WITH {_SWEEP} SELECT scheme, fraction, count(*) AS n, {sql_r6('avg(tokens)')} AS mean_tokens, {sql_r6('median(nmae)')} AS median, {sql_r6('min(nmae)')} AS low, {sql_r6('max(nmae)')} AS high FROM sw WHERE isfinite(nmae) GROUP BY 1, 2")
def pareto_curves(spark, d):
    c = telemetry.curves(_sweep(spark, d), "nmae")
    return c.select("scheme", "fraction", "n", *[r6(F.col(x)).alias(x) for x in ("mean_tokens", "median", "low", "high")])


@query("""
    WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'direct' WHEN doc_id % 3 = 1 THEN 'cutoff-top-' || (doc_id % 100) || 'pct' ELSE 'fourier-lowg-0.' || (25 + doc_id % 10) || 'pct' END AS label FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(label, '^(.+?)-(\\d+(?:\\.\\d+)?)pct$') THEN regexp_extract(label, '^(.+?)-(\\d+(?:\\.\\d+)?)pct$', 1) ELSE label END AS scheme,
      round(TRY_CAST(nullif(regexp_extract(label, '^(.+?)-(\\d+(?:\\.\\d+)?)pct$', 2), '') AS DOUBLE) / 100, 8) AS fraction FROM l""")
def config_label_parse(spark, d):
    k = F.col("doc_id")
    label = F.when(k % 3 == 0, "direct").when(k % 3 == 1, F.concat(F.lit("cutoff-top-"), (k % 100).cast("string"), F.lit("pct"))).otherwise(F.concat(F.lit("fourier-lowg-0."), (25 + k % 10).cast("string"), F.lit("pct")))
    scheme, fraction = formulas.parse_config_label(label)
    return table(spark, d, "documents").select("doc_id", scheme.alias("scheme"), F.round(fraction, 8).alias("fraction"))


@query(f"WITH {_SWEEP} SELECT scheme, fraction, {sql_r6('avg(nmae)')} AS mean, {sql_r6('quantile_cont(nmae, 0.5)')} AS median, {sql_r6('min(nmae)')} AS low, {sql_r6('max(nmae)')} AS high FROM sw GROUP BY 1, 2")
def fraction_curves(spark, d):
    c = telemetry.curves(_sweep(spark, d), "nmae")
    return c.select("scheme", "fraction", *[r6(F.col(x)).alias(x) for x in ("mean", "median", "low", "high")])


@query(f"WITH {_SWEEP}, m AS (SELECT category, count(DISTINCT task_id) AS samples, quantile_cont(nmae, 0.5) AS median FROM sw WHERE fraction = 0.05 GROUP BY 1) SELECT CAST(category AS BIGINT) AS category, samples, {sql_r6('median')} AS median, row_number() OVER (ORDER BY samples DESC, category) AS place FROM m")
def category_medians(spark, d):
    m = telemetry.category_medians(_sweep(spark, d).where("fraction = 0.05"), "nmae")
    return m.select(F.col("category").cast("long").alias("category"), "samples", r6(F.col("median")).alias("median"), "place")


@query(f"""WITH {_SWEEP}, n AS (SELECT category, count(DISTINCT task_id) AS samples FROM sw GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY samples DESC, category) AS place FROM n)
    SELECT CAST(category AS BIGINT) AS category, any_value(samples) AS samples, any_value(place) AS place, scheme, fraction, {sql_r6('avg(nmae)')} AS mean_nmae, {sql_r6('avg(tokens)')} AS mean_tokens FROM sw JOIN o USING (category) GROUP BY category, scheme, fraction""")
def sweep_by_category(spark, d):
    out = telemetry.by_category(_sweep(spark, d), ["nmae", "tokens"])
    return out.select(F.col("category").cast("long").alias("category"), "samples", "place", "scheme", "fraction", r6(F.col("mean_nmae")).alias("mean_nmae"), r6(F.col("mean_tokens")).alias("mean_tokens"))


# ---- evaluation: embeddings as logits over 64 ids, of which 8 to 55 are density ids ------------------

_DIST = f"""{VOX}, l AS (SELECT task_id AS pos, flat AS token, rho * 20 AS logit FROM vox), r AS (SELECT pos, token - 8 AS bin, exp(logit - max(logit) OVER (PARTITION BY pos)) AS e FROM l WHERE token >= 8 AND token < 56),
dist AS (SELECT pos, bin, e / (sum(e) OVER (PARTITION BY pos) + 1e-12) AS p, bin * CAST(0.5 AS DOUBLE) AS recon FROM r)"""


def _dist(spark, d):
    logits = G.unpack(grids(spark, d)).select(F.col("task_id").alias("pos"), F.col("flat").alias("token"), (F.col("rho") * 20).alias("logit"))
    return logits, evaluation.restrict(logits, ["pos"], 8, 48)


@query(f"""WITH {_DIST}, c AS (SELECT *, sum(p) OVER (PARTITION BY pos ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum FROM dist)
    SELECT pos, {sql_r6('arg_max(recon, p)')} AS argmax_value, least(count(*) FILTER (cum < 0.5), 47) AS median_bin, {sql_r6('sum(p * recon)')} AS mean_value FROM c GROUP BY 1""")
def decode_argmax_mean_median(spark, d):
    _, dist = _dist(spark, d)
    out = evaluation.decode(dist, ["pos"], F.col("bin") * 0.5, 48)
    return out.select("pos", r6(F.col("argmax_value")).alias("argmax_value"), F.col("median_bin").cast("long").alias("median_bin"), r6(F.col("mean_value")).alias("mean_value"))


@query(f"""WITH {VOX}, l AS (SELECT task_id AS pos, label, flat AS token, rho * 20 AS logit FROM vox), m AS (SELECT *, max(logit) OVER (PARTITION BY pos) AS top FROM l),
    c AS (SELECT pos, label, ln(sum(exp(logit - top))) + max(top) - max(logit) FILTER (token = pos % 64) AS loss FROM m GROUP BY 1, 2)
    SELECT CAST(label AS BIGINT) AS label, round(sum(loss * w) / greatest(sum(w), 1), 5) AS loss FROM (SELECT *, CASE WHEN pos % 64 >= 8 AND pos % 64 < 56 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM c) GROUP BY 1""")
def density_loss(spark, d):
    logits, _ = _dist(spark, d)
    ce = evaluation.cross_entropy(logits.withColumn("target", F.col("pos") % 64), ["pos"]).join(grids(spark, d).select(F.col("task_id").alias("pos"), F.col("label").cast("long").alias("label")), "pos")
    w = F.when((F.col("pos") % 64).between(8, 55), 1.0).otherwise(0.0)
    return evaluation.weighted_loss(ce, F.col("loss"), w, "label").withColumn("loss", F.round("loss", 5))


_LO, _HI = -2.0, 2.0
_ERR = f"""{VOX}, b AS (SELECT *, {sql_bin('rho', _LO, _HI, 12)} AS bb FROM vox), q AS (SELECT task_id, label, rho, CASE WHEN rho >= 0 THEN 1 ELSE -1 END * {sql_unbin('bb', _LO, _HI, 12)} AS back FROM b),
err AS (SELECT task_id, label, avg(abs(rho - back)) AS mae, avg(abs(rho)) AS mean_abs, avg(abs(rho - back)) / greatest(avg(abs(rho)), 1e-30) AS nmae FROM q GROUP BY 1, 2)"""


def _errors(spark, d):
    codec = LogCodec(_LO, _HI, (12,))
    cells = G.unpack(grids(spark, d)).withColumn("back", codec.round_trip(F.col("rho")))
    return evaluation.material_errors(cells, "task_id", "rho", "back").join(grids(spark, d).select("task_id", "label"), "task_id")


@query(f"WITH {_ERR} SELECT task_id, {sql_r6('mae')} AS mae, {sql_r6('nmae')} AS nmae FROM err")
def material_errors(spark, d):
    return _errors(spark, d).select("task_id", r6(F.col("mae")).alias("mae"), r6(F.col("nmae")).alias("nmae"))


@query(f"WITH {_ERR} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {sql_r6('avg(nmae)')} AS mean, {sql_r6('quantile_cont(nmae, 0.5)')} AS median, {sql_r6('quantile_cont(nmae, 0.99)')} AS p99 FROM err GROUP BY 1")
def eval_summary(spark, d):
    s = evaluation.summary(_errors(spark, d), "nmae", "label")
    return s.select(F.col("label").cast("long").alias("label"), "n", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "p99")])


@query("""
    WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    p AS (SELECT event_type, rep, CAST('0x' || substr(md5('5:' || event_type || ':' || rep || ':' || i), 1, 7) AS BIGINT) % n AS pick FROM v, range(8) AS r(rep)),
    s AS (SELECT p.event_type, rep, avg(v.value) AS mean, quantile_cont(v.value, 0.5) AS median, quantile_cont(v.value, 0.99) AS p99 FROM p JOIN v ON v.event_type = p.event_type AND v.i = p.pick GROUP BY 1, 2)
    SELECT event_type, round(stddev_pop(mean), 5) AS se_mean, round(stddev_pop(median), 5) AS se_median, round(stddev_pop(p99), 5) AS se_p99 FROM s GROUP BY 1""")
def bootstrap_se(spark, d):
    b = evaluation.bootstrap(table(spark, d, "events"), "value", "event_id", 8, 5, "event_type")
    return b.select("event_type", *[F.round(c, 5).alias(c) for c in ("se_mean", "se_median", "se_p99")])


@query("""
    WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) / sqrt(count(value)) AS se FROM events GROUP BY 1)
    SELECT a.event_type AS a, b.event_type AS b, round(a.m - b.m, 5) AS diff, round(sqrt(a.se * a.se + b.se * b.se), 5) AS se, round((a.m - b.m) / sqrt(a.se * a.se + b.se * b.se), 4) AS z FROM s a JOIN s b ON a.event_type < b.event_type""")
def two_sample_z(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("se"))
    a, b = (s.select(F.col("event_type").alias(n), F.col("m").alias(f"m{n}"), F.col("se").alias(f"s{n}")) for n in "ab")
    t = evaluation.two_sample(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(t["diff"], 5).alias("diff"), F.round(t["se"], 5).alias("se"), F.round(t["z"], 4).alias("z"))  # one row an event type


@query("SELECT vec_id, count(*) FILTER (i < 64 AND embedding[i] >= 0 AND embedding[i + 1] < 0) AS pairs FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1")
def adjacent_pairs(spark, d):
    pairs = F.filter(F.transform("embedding", lambda x, i: (x >= 0) & (F.get("embedding", i + 1) < 0)), lambda ok: F.coalesce(ok, F.lit(False)))
    return table(spark, d, "embeddings").select("vec_id", F.size(pairs).cast("long").alias("pairs"))


# ---- telemetry: events as run histories ------------------------------------------------------------

_EV = "ev AS (SELECT *, CASE WHEN event_type = 'purchase' OR event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 97 AS BIGINT) END AS step FROM events)"


def _events(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").withColumn("step", F.when((F.col("event_type") == "purchase") | (k % 4 == 0), None).otherwise(k % 97))


@query(f"WITH {_EV} SELECT event_id AS _step, step, value FROM ev WHERE step IS NOT NULL OR value > 50 AND value IS NOT NULL")
def history_project(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("_step"), "step", F.when((F.col("value") > 50) | F.col("step").isNotNull(), F.col("value")).alias("value"))
    return telemetry.project_history(rows, ["_step", "step", "value"])


@query(f"WITH {_EV} SELECT user_id, event_id, step, max(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM ev WHERE step IS NOT NULL")
def running_max_step(spark, d):
    return telemetry.running_max(_events(spark, d), "user_id", ["ts", "event_id"], "step").select("user_id", "event_id", "step", "so_far")


@query(f"WITH {_EV}, l AS (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ev WHERE step IS NOT NULL) SELECT user_id, event_id, step, before FROM l WHERE step > before")
def preempt_jumps(spark, d):
    return telemetry.jumps(_events(spark, d), "user_id", ["ts", "event_id"], "step").select("user_id", "event_id", "step", "before")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS upto FROM events WHERE event_type = 'error'")
def event_cumcount(spark, d):
    return telemetry.running_count(table(spark, d, "events").where("event_type = 'error'"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "upto")


@query("""
    WITH e AS (SELECT user_id, event_id, ts, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events),
    p AS (SELECT *, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id), total)) AS delta, (epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 3600.0::DOUBLE AS hours FROM e)
    SELECT user_id, event_id, total, delta, round(CASE WHEN hours * 60 <= 0.5 THEN 0 ELSE total / hours END, 4) AS per_hour FROM p""")
def poll_delta_rate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    totals = telemetry.running_count(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "total")
    return telemetry.poll(totals, "user_id", ["ts", "event_id"], "total").select("user_id", "event_id", "total", "delta", F.round("per_hour", 4).alias("per_hour"))


@query("SELECT user_id, arg_max(value, ts) AS latest, epoch_us(max(ts)) AS at FROM events WHERE value IS NOT NULL GROUP BY 1")
def latest_metric(spark, d):
    return telemetry.latest(table(spark, d, "events"), "user_id", "ts", "value").select("user_id", "latest", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL) SELECT user_id, event_id AS best_step, value AS best_value FROM r WHERE r = 1")
def best_step(spark, d):
    return telemetry.best(table(spark, d, "events"), "user_id", "event_id", "value")


@query("""
    WITH e AS (SELECT user_id, event_id % 50 AS step, event_type, value FROM events), a AS (SELECT user_id, step, avg(value) AS m FROM e WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, step, avg(value) AS m FROM e WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.step, b.step) AS step, round(a.m, 6) AS nmae, round(b.m, 6) AS nemd FROM a FULL JOIN b ON a.user_id = b.user_id AND a.step = b.step""")
def nmae_nemd_full_outer(spark, d):
    e = table(spark, d, "events").withColumn("step", F.col("event_id") % 50)
    of = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id", "step").agg(F.round(F.avg("value"), 6).alias(name))
    return telemetry.by_step(of("click", "nmae"), of("view", "nemd"), ["user_id", "step"])


@query("WITH t AS (SELECT l_orderkey AS job_id, max(l_linenumber) AS p, max(l_suppkey % 7) AS f FROM lineitem WHERE l_quantity > 10 GROUP BY 1), s AS (SELECT o_orderkey AS job_id, o_orderkey % 10 AS code FROM orders) SELECT s.job_id, CASE code WHEN 1 THEN 'PENDING' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'SUCCEEDED' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'KILLED' WHEN 7 THEN 'WORKER_FAILED' WHEN 8 THEN 'UNSCHEDULABLE' ELSE 'UNKNOWN_' || code END AS state, CAST(coalesce(p, 0) AS BIGINT) AS preemptions, CAST(coalesce(f, 0) AS BIGINT) AS failures FROM s LEFT JOIN t USING (job_id)")
def jobs_left_join_groupby(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 10).cast("int").alias("state"))
    tasks = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("preemption_count"), (F.col("l_suppkey") % 7).alias("failure_count"))
    return telemetry.job_table(jobs, tasks)


@query("WITH r AS (SELECT c_custkey, 'run-' || c_custkey AS name FROM customer), j AS (SELECT '/team/run-' || o_custkey AS job, max(o_orderstatus) AS state FROM orders GROUP BY 1) SELECT c_custkey, state FROM r LEFT JOIN j ON j.job = '/team/' || r.name")
def run_state_lookup(spark, d):
    runs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("name"))
    jobs = table(spark, d, "orders").groupBy(F.concat(F.lit("/team/run-"), F.col("o_custkey").cast("string")).alias("job")).agg(F.max("o_orderstatus").alias("state"))
    return runs.join(jobs, F.concat(F.lit("/team/"), F.col("name")) == F.col("job"), "left").select("c_custkey", "state")


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) // 4 AS block FROM events)
    SELECT user_id, event_type, CAST(block AS INTEGER) AS block, array_to_string(list(event_id ORDER BY event_id), ',') AS steps, count(value) AS n FROM r GROUP BY 1, 2, 3""")
def trajectory_arrays(spark, d):
    """Arrays in blocks of four steps."""
    t = telemetry.trajectories(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"], size=4)
    return t.select("user_id", "event_type", "block", F.array_join("event_ids", ",").alias("steps"), F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n"))


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, 0 AS depth, 'user-' || user_id AS name, false AS leaf, count(*) AS n FROM k GROUP BY 1
    UNION ALL SELECT user_id, 1, event_type, false, 1 FROM k UNION ALL SELECT user_id, 2, 'e' || event_id, true, 1 FROM events""")
def tree_walk(spark, d):
    """Each user's events as a JSON tree of kinds and events, walked node by node; ``n`` counts the children of the root."""
    e = table(spark, d, "events")
    kinds = e.groupBy("user_id", "event_type").agg(F.collect_list(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"))).alias("children"))
    docs = kinds.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), "children")).alias("children"))
    text = F.to_json(F.struct(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), "children"))
    nodes = series.walk_tree(docs.select(F.col("user_id").alias("key"), text.alias("doc")), "doc")
    under = nodes.where("depth = 1").groupBy("key").agg(F.count("*").alias("n"))
    return nodes.join(under, "key").select(F.col("key").alias("user_id"), "depth", "name", "leaf", F.when(F.col("depth") == 0, F.col("n")).otherwise(1).alias("n"))


@query("WITH j AS (SELECT 'v6e-' || (1 << (p_partkey % 5 + 2)) AS chip, p_size / 4.0 AS hours, p_partkey % 2 = 0 AS pre FROM part) SELECT chip, round(sum(CAST(regexp_extract(chip, 'v6e-(\\d+)', 1) AS INTEGER) * hours * CASE WHEN pre THEN 1.15 ELSE 2.83 END), 3) AS cost FROM j GROUP BY 1")
def chip_cost(spark, d):
    chip = F.concat(F.lit("v6e-"), F.pow(F.lit(2), F.col("p_partkey") % 5 + 2).cast("int").cast("string"))
    rows = table(spark, d, "part").select(chip.alias("chip"), (F.col("p_size") / 4.0).alias("hours"), (F.col("p_partkey") % 2 == 0).alias("pre"))
    chips = F.regexp_extract("chip", r"v6e-(\d+)", 1).cast("int")
    return rows.groupBy("chip").agg(F.round(F.sum(telemetry.cost(chips, F.col("hours"), F.col("pre"))), 3).alias("cost"))


# ---- scalar families ---------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(url) - length(replace(url, '/', '')) AS depth, starts_with(url, 'https') AS secure, upper(substr(url, 1, 4)) AS scheme FROM pages")
def regex_family(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))).cast("long").alias("depth"), F.startswith(u, F.lit("https")).alias("secure"), F.upper(F.substring(u, 1, 4)).alias("scheme"))


@query("SELECT event_id, CASE WHEN event_type LIKE '%click%' THEN 'ui' WHEN event_type LIKE '%error%' THEN 'fault' WHEN contains(event_type, 'p') THEN 'pay' ELSE 'other' END AS label FROM events")
def compute_label_case(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when(e.contains("click"), "ui").when(e.contains("error"), "fault").when(e.contains("p"), "pay").otherwise("other").alias("label"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 3600000000 AS hour FROM events")
def iso_epoch_family(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.floor(F.unix_millis(ts) / 3600000).alias("hour"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ['Na', 'Cl'] WHEN 1 THEN ['Cs', 'Pb', 'I'] WHEN 2 THEN ['O', 'Ti'] WHEN 3 THEN ['Fe'] WHEN 4 THEN ['S', 'O'] WHEN 5 THEN ['N'] WHEN 6 THEN ['Cl', 'O', 'Na'] ELSE ['Zn', 'S'] END AS e FROM part)
    SELECT CASE WHEN NOT list_has_any(e, ['H', 'He', 'B', 'C', 'N', 'O', 'F', 'Ne', 'Si', 'P', 'S', 'Cl', 'Ar', 'Ge', 'As', 'Se', 'Br', 'Kr', 'Sb', 'Te', 'I', 'Xe', 'At', 'Rn', 'Ts', 'Og']) THEN 'intermetallic'
      WHEN list_has_any(e, ['F', 'Cl', 'Br', 'I']) THEN CASE WHEN list_contains(e, 'O') THEN 'oxyhalide' ELSE 'halide' END
      WHEN list_has_any(e, ['S', 'Se', 'Te']) THEN CASE WHEN list_contains(e, 'O') THEN 'oxychalcogenide' ELSE 'chalcogenide' END
      WHEN list_contains(e, 'O') THEN 'oxide' ELSE 'other' END AS category, count(*) AS n FROM s GROUP BY 1""")
def category_rules(spark, d):
    sets = ["Na,Cl", "Cs,Pb,I", "O,Ti", "Fe", "S,O", "N", "Cl,O,Na", "Zn,S"]
    symbols = F.split(F.get(F.array(*map(F.lit, sets)), (F.col("p_partkey") % 8).cast("int")), ",")
    return table(spark, d, "part").groupBy(formulas.category(symbols).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_valid(props) AS ok FROM events")
def json_family(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$").isNotNull().alias("ok"))


# ---- streams ------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS hours, lag(value) OVER w AS before, row_number() OVER w AS poll FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, poll, event_id, value AS total, round(greatest(0, value - coalesce(before, value)), 6) AS delta, round(CASE WHEN hours * 60 > 0.5 THEN value / hours ELSE 0 END, 5) AS per_hour FROM e""")
def stream_counter_deltas(spark, d):
    out = counters.run_to_table(counters.counter_deltas(counters.events_stream(spark, d)), "update", "deltas")
    return out.select("user_id", "poll", "event_id", "total", F.round("delta", 6).alias("delta"), F.round("per_hour", 5).alias("per_hour"))


@query("SELECT user_id, event_type, event_id % 20 AS step, arg_max(value, event_id) AS value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def stream_late_points(spark, d):
    points = counters.events_stream(spark, d).where("value is not null").select("user_id", "event_type", (F.col("event_id") % 20).alias("step"), "event_id", "value")
    out = counters.run_to_table(points.repartition(3, "event_id"), "append", "points")
    return counters.late_points(out, ["user_id", "event_type", "step"], "event_id", "value")


@query("SELECT event_id % 6 AS step, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_new_results(spark, d):
    folder = new_path(spark, "results")
    rows = table(spark, d, "events").select((F.col("event_id") % 6).alias("step"), "event_id", "value")
    for step in range(6):
        part = f"{folder}/parts/{step}"
        rows.where(F.col("step") == step).drop("step").coalesce(1).write.option("ignoreNullFields", "false").json(part)
        rename_only_file(spark, part, ".json", f"{folder}/inbox/step-{step}.json")
    out = counters.run_to_table(counters.new_results(spark, f"{folder}/inbox", "event_id long, value double"), "append", "harvest")
    return out.groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    out = counters.run_to_table(counters.windowed_counts(counters.events_stream(spark, d)), "update", "windows")
    latest = Window.partitionBy("window", "event_type").orderBy(F.desc("batch"))
    return out.withColumn("r", F.row_number().over(latest)).where("r = 1").select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n")
