"""Queries on listings, databases, codec files, logs, published versions, reports and ball tokens: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions.vocabulary import Vocabulary
from lattica.operators import lmq, patches, series, telemetry
from lattica.operators.order import numbered
from lattica.plans.numeric import _HIST, _hist
from lattica.plans.registry import query, r6, sql_bin, sql_r6, sql_unbin, table
from lattica.plans.relational import _DENS, _SAMPLES, V, _samples
from lattica.sources import listings, sqlite
from lattica.sources import tables as S
from lattica.sources.scratch import new_path, rename_only_file


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, 'mp-' || o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0")
def id_listing(spark, d):
    """Ids in the order of a listing of several files, some of whose lines are blank."""
    path, k = new_path(spark, "ids"), F.col("o_orderkey")
    lines = table(spark, d, "orders").orderBy(k).select(F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" mp-"), k.cast("string"))).alias("value"))
    lines.write.text(path)
    return listings.read_ids(spark, path)


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 10 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') AND p_name IS NOT NULL")
def sqlite_scan(spark, d):
    """Parts in SQLite databases, one for each task that wrote; the condition is answered by SQLite."""
    path = new_path(spark, "catalogue")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("long").alias("p_size"))
    sqlite.write_table(rows.repartition(4, "p_partkey"), path, "mats")
    fields = "p_partkey long, p_name string, price double, p_size long"
    return sqlite.read_table(spark, path, "mats", fields, "p_size > 10 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') AND p_name IS NOT NULL", rows=200)


@query(f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cdf FROM h),
    b AS (SELECT list(x ORDER BY q) AS b FROM (SELECT q, min(centre) AS x FROM range(1, 12) t(q) JOIN c ON cdf >= q / 12.0::DOUBLE GROUP BY 1)),
    r AS (SELECT len(list_filter(b, lambda x: x <= centre)) AS spot, sum(centre * n) / sum(n) AS p FROM h, b GROUP BY 1),
    v AS (SELECT l_extendedprice AS v, len(list_filter(b, lambda x: x <= least(1e5, greatest(0.0, l_extendedprice)))) AS spot FROM lineitem, b)
    SELECT CAST(spot AS BIGINT) AS bin, count(*) AS n, {sql_r6('sum(abs(v - p)) / sum(v)')} AS nmae, CAST(12 AS INT) AS n_bins, CAST(4 AS INT) AS bits FROM v JOIN r USING (spot) GROUP BY 1""")
def codec_archive(spark, d):
    """A quantizer of twelve bins stored as an archive, read back, and applied to every price."""
    hist, path = _hist(spark, d), f"{new_path(spark, 'codec')}/codec.npz"
    bounds = [r.boundary for r in lmq.equal_mass(hist, 12).orderBy("q").collect()]  # eleven
    listings.write_codec(lmq.LloydMax(bounds, [r.recon for r in lmq.lloyd_step(hist, bounds).orderBy("bin").collect()], 1e5), path)
    codec = listings.read_codec(path)
    rows = codec.encode(table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v")), "v")
    error = F.sum(F.abs(F.col("v") - codec.decode(F.col("bin")))) / F.sum("v")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), r6(error).alias("nmae")).select("*", F.lit(codec.n_bins).alias("n_bins"), F.lit(codec.bits).alias("bits"))


@query("SELECT DISTINCT '/team/job-' || (event_id % 97) || '/' || event_type AS job_id FROM events WHERE event_id % 5 <> 0")
def job_log(spark, d):
    """Job ids in a log with noise, headers and blank lines."""
    path, k = new_path(spark, "log"), F.col("event_id")
    job = F.concat(F.lit("  /team/job-"), (k % 97).cast("string"), F.lit("/"), F.col("event_type"), F.lit("\tRUNNING  "), k.cast("string"))
    noise = F.when(k % 3 == 0, "I20250101 12:00:00 connecting").when(k % 3 == 1, "JOB  STATE").otherwise("   ")
    table(spark, d, "events").select(F.when(k % 5 == 0, noise).otherwise(job).alias("value")).write.text(path)
    return listings.read_job_log(spark, path)


@query("SELECT CAST(2 AS INT) AS version, c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def published_versions(spark, d):
    """Two versions of a table, then a dry run of a third: readers take the second."""
    root, rows = new_path(spark, "published"), table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    S.publish(rows.where("c_nationkey < 5"), root, "customers", 1)
    S.publish(rows, root, "customers", 2)
    S.publish(rows, root, "customers", 3, dry_run=True)
    last = S.latest_version(spark, root, "customers")
    return spark.read.parquet(S.publish_path(root, "customers", last)).select(F.lit(last).alias("version"), "c_custkey", "c_nationkey")


_STEPS = "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 0 ELSE event_id END"


@query(f"WITH s AS (SELECT {_STEPS} AS step FROM events) SELECT row_number() OVER (ORDER BY coalesce(nullif(step, 0), -1)) AS place, coalesce(step, 0) AS step, count(*) OVER () AS n_rows, max(step) OVER () AS last FROM s")
def history_order(spark, d):
    """Steps in the order of the files of a history: null and zero steps first."""
    path = new_path(spark, "history")
    about = listings.write_history(table(spark, d, "events").select(F.expr(_STEPS).cast("long").alias("_step")), path)
    rows = spark.read.parquet(path).select(F.coalesce("_step", F.lit(0)).alias("step"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return numbered(rows, "file", "at").select("place", "step").join(F.broadcast(about.select(F.col("rows").alias("n_rows"), "last")))  # one row


@query("SELECT 'part-' || (p_partkey % 4) || '.parquet' AS path, count(*) AS n_rows, CAST(0 AS INT) AS bad_groups, false AS broken FROM part GROUP BY 1 UNION ALL SELECT 'part-x.parquet', 0, 0, true")
def parquet_scan(spark, d):
    """Every Parquet file of a folder read in full; one is no Parquet."""
    path, rows = new_path(spark, "integrity"), table(spark, d, "part")
    for n in range(4):
        rows.where(F.col("p_partkey") % 4 == n).repartition(1).write.parquet(f"{path}/writing/{n}")
        rename_only_file(spark, f"{path}/writing/{n}", ".parquet", f"{path}/files/part-{n}.parquet")
    spark.range(1).coalesce(1).select(F.lit("no table").alias("value")).write.text(f"{path}/writing/x")
    rename_only_file(spark, f"{path}/writing/x", ".txt", f"{path}/files/part-x.parquet")
    return series.parquet_integrity(spark, f"{path}/files").select("path", F.col("rows").alias("n_rows"), "bad_groups", F.col("error").isNotNull().alias("broken"))


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE contains(s_name, '#000000007')")
def exactly_one(spark, d):
    """The one supplier whose name holds a part; none or several would be an error."""
    return S.one_match(table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")), "s_name", "#000000007")


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE 'a|b' || chr(10) || ' c' END AS note FROM customer GROUP BY 1, 2)
SELECT '| ' || CAST(c_nationkey AS VARCHAR) || ' | ' || c_mktsegment || ' | ' || CAST(n AS VARCHAR) || ' | ' || CASE WHEN note IS NULL THEN '' ELSE 'a\\|b c' END || ' |' AS line FROM g""")
def report_lines(spark, d):
    """A report as lines of a pipe table, with nulls, bars and line ends in its cells."""
    note = F.when(F.col("c_nationkey") % 6 == 0, None).otherwise(F.lit("a|b\n c"))
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return telemetry.markdown_lines(rows.withColumn("note", note))


@query("""SELECT CAST(user_id % 40 AS BIGINT) AS run, count(*) AS n, CAST(min(event_id) AS BIGINT) AS first, CAST(max(event_id) AS BIGINT) AS last, max_by(event_type, event_id) AS state, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def run_export(spark, d):
    """The history of each run as CSV in a folder of its own, read back, with a summary row for each run."""
    path = new_path(spark, "runs")
    rows = table(spark, d, "events").select((F.col("user_id") % 40).cast("long").alias("run"), F.col("event_id").cast("long").alias("event_id"), "event_type", "value")
    rows.write.partitionBy("run").option("header", True).csv(path)
    back = spark.read.schema("event_id long, event_type string, value double, run long").option("header", True).csv(path)
    return back.groupBy("run").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("state"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_SAMPLES}, {_DENS} SELECT task_id, CAST(k AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS error, CAST(2 AS BIGINT) AS side, count(*) AS n, round(sum((j + 1) * CASE WHEN rho >= 0 THEN 1 ELSE -1 END * ({sql_unbin('b', -4.13, 4.97, 20)})), 4) AS weighted FROM dn GROUP BY ALL""")
def detokenize_short(spark, d):
    """The short layout, whose shape is named only where it differs from the usual one."""
    rows = patches.tokenize(_samples(spark, d), V, default_shape=2).select("task_id", "k", "input_ids")
    back = patches.detokenize(rows, V, default_shape=2)
    weighted = F.aggregate(F.transform("patch", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("task_id", "k", "error", F.get("shape", F.lit(0)).cast("long").alias("side"), F.size("patch").cast("long").alias("n"), F.round(weighted, 4).alias("weighted"))


_BALLS = Vocabulary.ball()


@query(f"""WITH e AS (SELECT vec_id, unnest(range(0, vec_id % 9 + 1)) AS j, embedding FROM embeddings), v AS (SELECT vec_id, j, CAST(embedding[j + 1] AS DOUBLE) AS rho FROM e), b AS (SELECT *, {sql_bin('rho', -4.13, 4.97, 20)} AS b FROM v)
SELECT vec_id AS task_id, CASE WHEN vec_id % 10 = 3 THEN 'no EOS' WHEN vec_id % 10 = 7 THEN 'bounds' END AS error, CAST(vec_id % 5 AS BIGINT) AS r2_max, CAST(vec_id % 4 AS BIGINT) AS cx, CASE WHEN vec_id % 10 = 7 THEN 1 ELSE 6 END AS n_bounds,
count(*) AS n, round(sum((j + 1) * CASE WHEN rho >= 0 THEN 1 ELSE -1 END * ({sql_unbin('b', -4.13, 4.97, 20)})), 4) AS weighted FROM b GROUP BY ALL""")
def ball_tokens(spark, d):
    """Token rows of balls and back: some rows lose their end, some their bounds, and say so."""
    k = F.col("vec_id")
    ints = lambda *c: F.array(*[x.cast("int") for x in c])
    bounds = F.when(k % 10 == 7, ints(k % 2)).otherwise(ints(*[k % (i + 2) for i in range(6)]))
    rows = table(spark, d, "embeddings").select(
        k.alias("task_id"), ints(F.lit(8), F.lit(9), F.lit(10)).alias("grid"), ints(k % 90 + 1, F.lit(8)).alias("atoms"), F.array_repeat(F.lit(0.25), 6).alias("coords"), (k % 5).cast("int").alias("r2_max"),
        ints(k % 4, F.lit(2), F.lit(3)).alias("center"), bounds.alias("bounds"), F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (k % 9 + 1).cast("int")).alias("patch"),
    )
    ids = patches.tokenize_ball(rows, _BALLS).select("task_id", F.when(F.col("task_id") % 10 == 3, F.slice("input_ids", F.lit(1), F.size("input_ids") - 1)).otherwise(patches.pad_right(F.col("input_ids"), 120)).alias("input_ids"))
    back = patches.detokenize_ball(ids, _BALLS)
    weighted = F.aggregate(F.transform("patch", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("task_id", "error", F.col("r2_max").cast("long").alias("r2_max"), F.get("center", F.lit(0)).cast("long").alias("cx"), F.size("bounds").alias("n_bounds"), F.size("patch").cast("long").alias("n"), F.round(weighted, 4).alias("weighted"))
