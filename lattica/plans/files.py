"""Queries on text tables, shards, listings, filters and labels: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.operators import etl, lmq, materials, order, patches, series
from lattica.plans.numeric import _HIST, _hist
from lattica.plans.registry import query, r6, sql_r6, table
from lattica.sources import tables as S
from lattica.sources.scratch import new_path


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    S.write_csv(table(spark, d, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    return S.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_nationkey long").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 > 2")
def csv_malformed_dropped(spark, d):
    k, c = (F.col(x).cast("string") for x in ("o_orderkey", "o_custkey"))
    kind = F.col("o_orderkey") % 7
    line = F.when(kind == 0, k).when(kind == 1, F.concat_ws(",", k, c, F.lit("more"))).when(kind == 2, F.concat_ws(",", F.lit("x"), c)).otherwise(F.concat_ws(",", k, c))
    path = new_path(spark, "lines")
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return S.read_csv(spark, path, "o_orderkey long, o_custkey long", header=False)


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 9 <> 4")
def json_lines(spark, d):
    body = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 9 == 4, F.when(F.col("event_id") % 2 == 0, "  ").otherwise("no json")).otherwise(body)
    path = new_path(spark, "jsonl")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return S.read_json_lines(spark, path, "event_id long, event_type string, value double")


@query("SELECT p_partkey % 4 AS worker, count(*) AS n, sum(p_size) AS size FROM part GROUP BY 1")
def shard_glob(spark, d):
    path = new_path(spark, "shards")
    etl.write_shards(table(spark, d, "part").select((F.col("p_partkey") % 4).alias("worker"), F.col("p_partkey").alias("task"), "p_size"), path, "task", rows_per_file=100)
    return S.shards(spark, path).groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT DISTINCT 'brand-' || replace(p_brand, '#', '') AS name FROM part")
def directory_listing(spark, d):
    path = new_path(spark, "listing")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("brand-"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".zarr")).alias("entry"))
    rows.write.partitionBy("entry").parquet(path)
    return S.stems(spark, path, r"\.zarr").select(F.regexp_replace("name", "^entry=", "").alias("name"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def tolerant_scan(spark, d):
    path = new_path(spark, "tolerant")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").write.parquet(f"{path}/good")
    spark.range(3).select(F.lit("not a table").alias("value")).write.text(f"{path}/bad")
    return S.read_tolerant(spark, path, "n_nationkey long, n_name string")


@query("SELECT CAST(c_nationkey AS BIGINT) AS run, c_mktsegment AS split, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1, 2")
def results_by_key(spark, d):
    path = new_path(spark, "results")
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("run"), F.col("c_mktsegment").alias("split")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    S.write_results(rows, path, ["run", "split"])
    return spark.read.schema("n long, mean double, run long, split string").json(path)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, s_nationkey * 10 AS bytes FROM supplier")
def copy_report(spark, d):
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_nationkey") * 10).alias("size"))
    copied = files.where("path % 10 <> 0").withColumn("size", F.when(F.col("path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return S.copy_report(files, copied).withColumnRenamed("path", "s_suppkey")


@query("""WITH j AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/team/job-' || p_partkey WHEN p_partkey % 3 = 1 THEN '/team/job-' || p_partkey || '/0' ELSE '/other/job' END AS path, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE 'p' END AS parent FROM part)
    SELECT p_partkey, regexp_matches(path, 'job-\\d*7(/|$)') AS seven FROM j WHERE path LIKE '/team/%' AND (parent IS NULL OR parent = '') AND length(path) - length(replace(path, '/', '')) <= 2""")
def job_filters(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/team/job-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/team/job-"), k.cast("string"), F.lit("/0"))).otherwise("/other/job")
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"), F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise("p").alias("parent"))
    return rows.where(S.top_jobs(F.col("path"), F.col("parent"), "team")).select("p_partkey", F.col("path").rlike(r"job-\d*7(/|$)").alias("seven"))


@query("WITH p AS (SELECT s_suppkey, s_name, s_nationkey % 4 AS ready, CASE WHEN s_suppkey % 3 = 0 THEN 'available' ELSE 'busy' END AS status FROM supplier) SELECT s_suppkey, row_number() OVER (ORDER BY status <> 'available', -ready, s_name) AS place FROM p WHERE contains(s_name, '1') AND (ready > 0 OR status <> 'available')")
def pool_table(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 4).alias("ready"), F.when(F.col("s_suppkey") % 3 == 0, "available").otherwise("busy").alias("status"))
    rows = rows.where(F.col("s_name").contains("1") & S.interesting(F.col("ready"), F.col("status")))
    return order.numbered(rows, F.col("status") != "available", -F.col("ready"), "s_name").select("s_suppkey", "place")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END, -s_acctbal, s_name) AS place FROM supplier")
def multi_key_order(spark, d):
    first = F.when(F.col("s_nationkey") % 2 == 0, 0).otherwise(1)
    return order.numbered(table(spark, d, "supplier"), first, -F.col("s_acctbal"), "s_name").select("s_suppkey", "place")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 100")
def range_of_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(100).limit(200)


@query("WITH m AS (SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey) AS longest FROM lineitem) SELECT l_orderkey, l_linenumber FROM m WHERE longest <= 40")
def whole_material_overflow(spark, d):
    return etl.fitting(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), 40).select("l_orderkey", "l_linenumber")


@query("WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM s) SELECT user_id, event_id FROM r WHERE before IS DISTINCT FROM event_type")
def segment_starts(spark, d):
    rows = series.segments(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.where("starts").select("user_id", "event_id")


@query("WITH s AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS starts FROM events), g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM s) SELECT user_id, CAST(segment AS BIGINT) AS segment, any_value(event_type) AS kind, count(*) AS n FROM g GROUP BY 1, 2")
def segment_runs(spark, d):
    rows = series.segments(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "segment").agg(F.first("event_type").alias("kind"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey, 40 + p_size AS nx, 60 + p_partkey % 30 AS ny, 20 + p_partkey % 50 AS nz FROM part), v AS (SELECT nx * ny * nz AS v, (nx // 14) * (ny // 14) * (nz // 14) AS dm, greatest(nx - 13, 0) * greatest(ny - 13, 0) * greatest(nz - 13, 0) AS am FROM s)
    SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS voxels, round(avg(v), 4) AS mean, quantile_cont(v, 0.5) AS median, max(v) AS largest, CAST(sum(dm) AS BIGINT) AS disjoint, max(dm) AS most_disjoint, CAST(sum(am) AS BIGINT) AS offsets, max(am) AS most_offsets, round(avg(CASE WHEN 2744 >= v THEN 1.0 ELSE 0.0 END), 6) AS small FROM v""")
def corpus_totals(spark, d):
    k = F.col("p_partkey")
    shapes = table(spark, d, "part").select((F.col("p_size") + 40).cast("long").alias("nx"), (k % 30 + 60).alias("ny"), (k % 50 + 20).alias("nz"))
    return materials.corpus_totals(shapes, 14).withColumn("mean", F.round("mean", 4)).withColumn("small", F.round("small", 6))


@query("SELECT CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber = 1 THEN 'train-' || l_orderkey WHEN l_linenumber = 2 THEN 'base-run' ELSE 'base-run-' || l_partkey END AS label, printf('cutoff-top-%gpct', l_discount * 100) AS config FROM lineitem")
def label_expansion(spark, d):
    short = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("train-"), F.col("l_orderkey").cast("string"))).when(F.col("l_linenumber") == 2, "plain").otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_quantity").cast("long").alias("q"), formulas.expand_label(short, "base-run", "plain").alias("label"), formulas.config_label("cutoff-top", F.col("l_discount")).alias("config"))


def _md5_draw(*parts: str, n: int) -> str:
    return f"CAST('0x' || substr(md5({(chr(32) + '|| chr(58) ||' + chr(32)).join(parts)}), 1, 7) AS BIGINT) % {n}"


@query(f"SELECT p_partkey AS task_id, k, {_md5_draw(chr(39) + '9' + chr(39), 'p_partkey', 'k', chr(39) + 'x' + chr(39), n=24)} AS cx, {_md5_draw(chr(39) + '9' + chr(39), 'p_partkey', 'k', chr(39) + 'y' + chr(39), n=30)} AS cy, {_md5_draw(chr(39) + '9' + chr(39), 'p_partkey', 'k', chr(39) + 'z' + chr(39), n=36)} AS cz FROM part, range(4) AS r(k)")
def random_centres(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.lit(24).alias("nx"), F.lit(30).alias("ny"), F.lit(36).alias("nz"))
    return patches.random_centres(rows, 4, 9).select("task_id", "k", "cx", "cy", "cz")


def _lloyd_sql(rounds: int, n: int) -> str:
    """Lloyd's iterations in SQL: boundaries as a list, one step after another."""
    interp = "CASE WHEN q <= first(cdf ORDER BY cdf) THEN first(centre ORDER BY cdf) ELSE max(x0 + (centre - x0) * (q - c0) / (cdf - c0)) FILTER (c0 < q AND q <= cdf) END"
    steps = [f"b0 AS (SELECT list(x ORDER BY q) AS b FROM (SELECT q, {interp} AS x FROM (SELECT *, lag(cdf) OVER (ORDER BY bin) AS c0, lag(centre) OVER (ORDER BY bin) AS x0 FROM c), (SELECT i / {n}.0::DOUBLE AS q FROM range(1, {n}) t(i)) GROUP BY q))"]
    for i in range(rounds):
        steps.append(f"r{i} AS (SELECT spot, sum(centre * n) / sum(n) AS p FROM (SELECT centre, n, len(list_filter(b, lambda x: x < centre)) AS spot FROM h, b{i}) GROUP BY 1)")
        steps.append(f"b{i + 1} AS (SELECT list(m ORDER BY spot) AS b FROM (SELECT spot, (p + lead(p) OVER (ORDER BY spot)) / 2 AS m FROM r{i}) WHERE m IS NOT NULL)")
    return ", ".join(steps)


@query(f"""
    WITH {_HIST}, c AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM h), {_lloyd_sql(3, 8)},
    a AS (SELECT centre, n, len(list_filter(b, lambda x: x < centre)) AS spot FROM h, b3),
    m AS (SELECT spot, min(centre) AS med FROM (SELECT *, sum(n) OVER (PARTITION BY spot ORDER BY centre ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY spot) / 2.0 AS half FROM a) WHERE run >= half GROUP BY 1),
    s AS (SELECT spot, sum(n) AS n, sum(centre * n) / sum(n) AS mean FROM a GROUP BY 1),
    e AS (SELECT sum(abs(centre - mean) * a.n) / sum(a.n) AS mae, sum(abs(centre - med) * a.n) / sum(a.n) AS mae_median, sum(centre * a.n) / sum(a.n) AS rho FROM a JOIN s USING (spot) JOIN m USING (spot))
    SELECT s.spot AS bin, CAST(s.n AS BIGINT) AS n, round(mean, 3) AS mean, round(med, 3) AS median, round(mae, 3) AS mae, round(mae_median, 3) AS mae_median, {sql_r6('mae / rho')} AS nmae FROM s JOIN m USING (spot), e""")
def lmq_fit_report(spark, d):
    points, totals = lmq.fit_report(_hist(spark, d), 8, 100_000.0, iterations=3)
    return points.select("bin", "n", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), *[F.lit(round(totals[k], 3)).alias(k) for k in ("mae", "mae_median")], r6(F.lit(totals["nmae"])).alias("nmae"))


@query(f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM h),
    b AS (SELECT list(x ORDER BY q) AS b FROM (SELECT q, min(centre) AS x FROM range(1, 16) t(q) JOIN c ON cdf >= q / 16.0::DOUBLE GROUP BY 1)),
    a AS (SELECT centre, n, len(list_filter(b, lambda x: x <= centre)) AS spot FROM h, b), s AS (SELECT spot, sum(centre * n) / sum(n) AS p FROM a GROUP BY 1)
    SELECT round(sum(abs(centre - p) * n) / sum(n), 3) AS mae, round(sqrt(sum(pow(centre - p, 2) * n) / sum(n)), 3) AS rmse FROM a JOIN s USING (spot)""")
def equal_mass_errors(spark, d):
    h = _hist(spark, d)
    return lmq.quantizer_errors(h, [r.boundary for r in lmq.equal_mass(h, 16).orderBy("q").collect()]).select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))  # 15 boundaries

