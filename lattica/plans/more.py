"""Further queries: series, scalar families, baselines, coded transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lattica.operators import lmq, series
from lattica.operators import promolecules as P
from lattica.plans.numeric import _HIST, _hist
from lattica.plans.registry import VOX, grids, query, r6, sql_r6, table
from lattica.sources.listings import first_seen


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS starts, count(*) FILTER (event_type = 'error') AS faults, count(DISTINCT event_id % 20) AS steps FROM events GROUP BY 1")
def event_counts(spark, d):
    e = table(spark, d, "events")
    counts = series.status_counts(e, ["user_id"], {"starts": F.col("event_type") == "signup", "faults": F.col("event_type") == "error"})
    return counts.join(e.groupBy("user_id").agg(F.countDistinct(F.col("event_id") % 20).alias("steps")), "user_id")


@query("SELECT event_type, round(arg_max(value, event_id), 6) AS final, round(ln(6794), 6) AS baseline FROM events WHERE value IS NOT NULL GROUP BY 1")
def final_value_baseline(spark, d):
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(F.max_by("value", "event_id"), 6).alias("final"), F.lit(round(math.log(6794), 6)).alias("baseline"))


@query("""
    WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events),
    w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS x1, last_value(v IGNORE NULLS) OVER b AS y0, first_value(v IGNORE NULLS) OVER a AS y1
      FROM e WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, event_id, round(coalesce(v, y0 + (y1 - y0) * ((event_id - x0) / nullif(CAST(x1 - x0 AS DOUBLE), 0)), y0, y1), 9) AS filled FROM w""")
def gap_fill(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return series.fill_gaps(e, "user_id", "event_id", "v").select("user_id", "event_id", F.round("filled", 9).alias("filled"))


@query(f"""
    WITH {_HIST}, c AS (SELECT bin, centre, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM h),
    s AS (SELECT *, lag(cdf) OVER (ORDER BY bin) AS cdf0, lag(centre) OVER (ORDER BY bin) AS x0 FROM c), q AS (SELECT CAST(unnest([0.001, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS q)
    SELECT q, round(CASE WHEN cdf0 IS NULL THEN centre ELSE x0 + (centre - x0) * (q - cdf0) / (cdf - cdf0) END, 4) AS value FROM s, q WHERE q <= cdf AND coalesce(cdf0, -1) < q""")
def lmq_interpolated_bounds(spark, d):
    return series.interpolate_quantiles(_hist(spark, d), [0.001, 0.25, 0.5, 0.75, 1.0]).select("q", F.round("value", 4).alias("value"))


@query(f"WITH {_HIST} SELECT CAST(greatest(0, least(19, floor((log10(centre) - 0) / 0.3))) AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS weight FROM h GROUP BY 1")
def weighted_log_histogram(spark, d):
    at, w = series.log_histogram(F.col("centre"), F.col("n"), 0.0, 6.0, 20)
    return _hist(spark, d).select(at.alias("bin"), w.alias("w")).groupBy("bin").agg(F.sum("w").alias("weight"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE))), 5) AS head, round(list_sum(list_transform(embedding[62:64], lambda x: CAST(x AS DOUBLE))), 5) AS tail FROM embeddings")
def head_tail_preview(spark, d):
    head, tail = series.ends(F.transform("embedding", lambda x: x.cast("double")), 3)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    return table(spark, d, "embeddings").select("vec_id", total(head).alias("head"), total(tail).alias("tail"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) SELECT doc_id, r <= 128 AS held_out FROM r")
def holdout_split(spark, d):
    return series.holdout(table(spark, d, "documents").select("doc_id"), "doc_id", 128)


@query("WITH s AS (SELECT l_orderkey, l_linenumber, 'job: failures=' || l_linenumber || '  preemptions=' || CAST(l_quantity AS BIGINT) AS line FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(regexp_extract(line, 'failures=(\\d+)\\s+preemptions=(\\d+)', 1) AS BIGINT) AS failures, CAST(regexp_extract(line, 'failures=(\\d+)\\s+preemptions=(\\d+)', 2) AS BIGINT) AS preemptions FROM s")
def summary_line_parse(spark, d):
    line = F.concat(F.lit("job: failures="), F.col("l_linenumber").cast("string"), F.lit("  preemptions="), F.col("l_quantity").cast("long").cast("string"))
    part = lambda i: F.regexp_extract(line, r"failures=(\d+)\s+preemptions=(\d+)", i).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", part(1).alias("failures"), part(2).alias("preemptions"))


@query("WITH u AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'gs://data-eu-west4/x' ELSE 'gs://data-us-central2/y' END AS u FROM nation) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, replace(regexp_extract(u, 'gs://data-([^/]+)/', 1), 'eu-', 'europe-') AS region FROM u")
def region_parse(spark, d):
    u = F.when(F.col("n_nationkey") % 2 == 0, "gs://data-eu-west4/x").otherwise("gs://data-us-central2/y")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.replace(F.regexp_extract(u, "gs://data-([^/]+)/", 1), F.lit("eu-"), F.lit("europe-")).alias("region"))


@query("SELECT doc_id, md5(text) AS digest, base64(unhex(md5(text))) AS packed FROM documents")
def digest_encodings(spark, d):
    digest = F.md5(F.col("text").cast("binary"))
    back = F.lower(F.hex(F.unbase64(F.base64(F.unhex(digest)))))
    return table(spark, d, "documents").select("doc_id", back.alias("digest"), F.base64(F.unhex(digest)).alias("packed"))


@query("WITH f AS (SELECT source, min(doc_id) AS seen FROM documents GROUP BY 1) SELECT source, row_number() OVER (ORDER BY seen) AS place FROM f")
def first_seen_order(spark, d):
    return first_seen(table(spark, d, "documents"), "source", "doc_id").select("source", F.col("place").cast("long").alias("place"))


@query("SELECT c_nationkey % 4 AS worker, count(DISTINCT c_custkey) AS materials, count(*) AS total_rows, round(sum(o_totalprice), 2) AS bytes FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def dataset_totals(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy((F.col("c_nationkey") % 4).alias("worker")).agg(F.countDistinct("c_custkey").alias("materials"), F.count("*").alias("total_rows"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, min(n_chars) AS low, max(n_chars) AS high, array_to_string((list_sort(list(DISTINCT source)))[1:3], ',') AS first_three FROM documents")
def volume_inspect(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 3), ",").alias("first_three"))


@query(f"""
    WITH {VOX}, atm AS (SELECT task_id, 6 AS z, 0.5 AS f FROM (SELECT DISTINCT task_id FROM vox)),
    r AS (SELECT vox.task_id, flat, rho, z * pow(2 * pi() * 0.16, -1.5) * exp(-(pow((ix / 4.0 - f - round_even(ix / 4.0 - f, 0)) * 4, 2) + pow((iy / 4.0 - f - round_even(iy / 4.0 - f, 0)) * 4, 2) + pow((iz / 4.0 - f - round_even(iz / 4.0 - f, 0)) * 4, 2)) / 0.32) AS base FROM vox JOIN atm USING (task_id))
    SELECT task_id, {sql_r6('sum(abs(rho - base))')} AS delta_mass, {sql_r6('sum(rho - base)')} AS delta_total FROM r GROUP BY 1""")
def delta_density(spark, d):
    atoms = spark.createDataFrame([(6, 0.5, 0.5, 0.5)], "z int, fx double, fy double, fz double")
    rows = P.packed_baseline(grids(spark, d).withColumn("cell", P.cube(4.0)), grids(spark, d).select("task_id").crossJoin(F.broadcast(atoms)), P.Gaussian())  # broadcast: one atom
    delta = F.zip_with("density", "baseline", lambda a, b: a - b)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return rows.select("task_id", r6(add(F.transform(delta, F.abs))).alias("delta_mass"), r6(add(delta)).alias("delta_total"))


@query("SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n, round(avg(CASE WHEN CAST(floor((ln(greatest(1e-6, least(1e5, l_extendedprice))) - ln(1e-6)) / (ln(1e5) - ln(1e-6)) * 100) AS BIGINT) > 95 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def fine_bin_share(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), lmq.fine_bin(F.col("l_extendedprice"), bins=100).alias("b"))
    return rows.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg((F.col("b") > 95).cast("double")), 6).alias("share"))
