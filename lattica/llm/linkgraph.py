"""URL filter by the link graph of hosts: rules where they fit, else trust and distrust spread along links.

Hosts that the rules allow are seeds of trust, which follows links from host to host as a personalised
PageRank; hosts that they block are seeds of distrust, which runs against the links, to the hosts that
lead there. All joins are of host tables; edges are counted before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import lower_ascii, settle, store

#: Damping and rounds of the propagation, as is usual for trust on link graphs.
DAMPING, ROUNDS = 0.85, 20
#: A host is blocked if its distrust is at least this and more than its trust.
LEAST = 0.01
#: A table of hosts is broadcast to the pages if it has at most so many rows and rules; else the join is one that adaptive execution can split at a host with very many pages.
BROADCAST = 100_000
#: Rounds between two checkpoints.
STRIDE = 5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, rule_verdict) of (``host/path``, ``allow`` or ``block``) pairs."""
    rows = [(rule, *rule.split("/", 1), verdict) for rule, verdict in rules]
    return spark.createDataFrame([(r, h, "/" + p, v) for r, h, p, v in rows], "rule string, rule_host string, rule_path string, rule_verdict string")


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) for hosts to which rules apply, the rules of each from the longest to the shortest, ties by their text; a group holds a host's rules alone."""
    fits = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host")).join(rules.dropDuplicates(["rule"]), "rule_host")
    entry = F.struct((-F.char_length("rule")).alias("rank"), "rule", "rule_path", "rule_verdict")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from the pages of one host to another, absolute or without a scheme, and two links between a host and the host one label above it, where both have pages.

    Links inside a host are no edges. Counts form in each task before the shuffle.
    """
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.col("link"))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link")).select("src", host_of(target).alias("dst"))
    known = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    above = known.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).join(known.select(F.col("host").alias("dst")), "dst", "left_semi")
    both = above.select("src", "dst").union(above.select("dst", "src"))
    return links.where("src <> '' and dst <> '' and src <> dst").union(both).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host in ``seeds`` (host, trusted, blocked: shares from 0 to 1) or ``edges`` (src, dst, n).

    Each round gives every host its seed times ``1 - damping`` and ``damping`` times what its neighbours
    hand on in proportion to their links: trust along edges, distrust against them. Hosts without links
    hand on nothing. Stops early once a stride of rounds changes nothing.
    """
    directed = edges.select(F.lit(0).alias("kind"), "src", "dst", "n").union(edges.select(F.lit(1), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = directed.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    share = settle(directed.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("trusted").alias("seed")).union(seeds.select(F.lit(1), "host", "blocked")).where("seed > 0")
    start = settle(start.withColumn("given", (1 - damping) * F.col("seed")).drop("seed"))
    score = start.withColumnRenamed("given", "score")
    for done in range(0, rounds, STRIDE):
        before = score
        for _ in range(min(STRIDE, rounds - done)):
            passed = share.join(score, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("part"))
            score = passed.union(start.select("kind", "host", "given")).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        score = settle(score)
        moved = score.join(before.withColumnRenamed("score", "old"), ["kind", "host"], "left").where("old is null or abs(score - old) > 1e-12")
        if moved.isEmpty():
            break
    sides = [F.coalesce(F.round(F.sum(F.when(F.col("kind") == k, F.col("score"))), 9), F.lit(0.0)).alias(name) for k, name in enumerate(("trust", "distrust"))]
    return score.groupBy("host").agg(*sides)


def _with_hosts(pages: DataFrame, hosts: DataFrame, weight: Column) -> DataFrame:
    """``pages`` left-joined with what is known of their hosts; the size of a broadcast table is counted first."""
    hosts = settle(hosts)
    small = (hosts.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST
    return pages.join(F.broadcast(hosts) if small else hosts.hint("merge"), "host", "left")


def judge(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule fits its host and all domains below it where the url's path starts with the rule's; the
    longest wins, equal ones by their text. Pages without a rule are judged by their host: blocked if its
    distrust is at least ``least`` and above its trust, else allowed. A host's seeds are the shares of
    its pages that rules allow and block. Null urls, and urls without ``://``, have an empty host, which
    is no seed and is allowed. A null html has no links. Repeated rows give repeated results and count
    each time. Empty tables give no rows; extra columns are not read.
    """
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = rules_of_hosts(placed.where("host <> ''").select("host").distinct(), rules)
    hit = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    ruled, _ = store(_with_hosts(placed, listed, F.size("rules")).select("page_id", "host", "path", F.get(hit, F.lit(0)).alias("hit")).select("page_id", "host", "path", "hit.rule", "hit.rule_verdict"), "urls")
    of = lambda verdict: F.coalesce(F.avg(F.coalesce((F.col("rule_verdict") == verdict).cast("double"), F.lit(0.0))), F.lit(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(of("allow").alias("trusted"), of("block").alias("blocked"))
    scores = propagate(seeds, host_edges(pages), damping, rounds)
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust >= least) & (distrust > trust), "block").otherwise("allow")
    return _with_hosts(ruled, scores, F.lit(1)).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
