"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chosenpath, compactwindows, conversations, decontaminate, licenses, linkgraph, packing, periodic, sharding, suffixes, topk, toxicity, warc
from lattica.llm.common import shared_folder, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_frame(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end=2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}", shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    return warc.page_rows(warc.records(spark, archive)).drop("url")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compactwindows.substring_duplicates(table(spark, sf_dir, "documents"), words=50, k=5, threshold=0.8)
    return found.select("doc_id", "class_id", "n_links", compactwindows.covered_words(F.col("spans")).cast("long").alias("n_repeated_words"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_bytes(table(spark, sf_dir, "documents"), width=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_rows(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=20)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, k=5).drop("digest")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.find_runs(table(spark, sf_dir, "documents"), repeat=True))


#: The rules of op12, fixed by its contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"), linkgraph.rule_table(spark, URL_RULES)).drop("trust", "distrust")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), known=rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The words of ``text`` in DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HOST = lambda url: f"translate(regexp_extract(substr({url}, instr({url}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}', '{verdict}')" for rule, verdict in URL_RULES)
_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, {k}, '{words}')" for i, label, base, k, words in licenses.listed())

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op5_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM bw WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, w[s : s + 9] AS g FROM bs), sizes AS (SELECT DISTINCT len(g) AS n FROM win),
        ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n),
        occ AS (SELECT d.doc_id, d.s, d.n, win.item_id FROM (SELECT doc_id, s, n, w[s : s + n - 1] AS g FROM ds) d JOIN win ON d.g = win.g),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS t FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w) AS score FROM e q JOIN e c ON q.t = c.t AND q.vec_id <> c.vec_id
              WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20""",
    "op9_licenses": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(template, label, base, k, words)),
        tp AS (SELECT template, label, base, k, string_split(words, ' ') AS w FROM t),
        tg AS (SELECT template, label, base, k, len(w) - k + 1 AS pairs, p - 1 AS place, w[p : p + k - 1] AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM tp)),
        dg AS (SELECT doc_id, k, p - 1 AS spot, w[p : p + k - 1] AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
        v AS (SELECT doc_id, template, label, base, k, pairs, place, spot, unnest(CASE WHEN base THEN [0] ELSE range(-{licenses.DRIFT}, {licenses.DRIFT} + 1) END) AS shift FROM dg JOIN tg USING (k, gram)),
        f AS (SELECT doc_id, template, label, base, k, pairs, spot - place + shift AS diagonal, place, min(spot) AS spot FROM v GROUP BY ALL),
        o AS (SELECT *, coalesce(max(spot) OVER (PARTITION BY doc_id, template, diagonal ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS behind FROM f),
        s AS (SELECT doc_id, template, label, base, k, pairs, diagonal, count(*) AS matched, min(spot) AS start, max(spot + k) AS fin FROM o WHERE spot > behind GROUP BY ALL),
        m AS (SELECT doc_id, template, label, base, k, pairs, start, max({{'matched': matched, 'neg': -fin}}) AS m FROM s
              WHERE CASE WHEN base THEN matched = pairs ELSE round(matched / CAST(pairs AS DOUBLE), 6) >= {licenses.COVER} END GROUP BY ALL),
        b AS (SELECT doc_id, template, label, base, k, pairs, start, -m.neg AS fin, round(m.matched / CAST(pairs AS DOUBLE), 6) AS share FROM m),
        g AS (SELECT * FROM b WHERE base OR NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND NOT o.base AND o.start < b.fin AND b.start < o.fin
              AND (o.k > b.k OR o.k = b.k AND (o.share > b.share OR o.share = b.share AND (o.pairs > b.pairs OR o.pairs = b.pairs AND (o.template < b.template OR o.template = b.template AND o.start < b.start)))))),
        a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM g GROUP BY 1)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM dw LEFT JOIN a USING (doc_id)""",
    "op12_url_filter": f"""
        WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN {_HOST("url")} ELSE '' END AS host,
                                    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
        rules AS (SELECT * FROM (VALUES {_RULES}) AS r(rule, rule_host, rule_path, rule_verdict)),
        urls AS (SELECT host, path, max({{'n': length(rule), 'rule': rule, 'verdict': rule_verdict}}) AS hit FROM (SELECT DISTINCT host, path FROM p) u
                 JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
        ruled AS (SELECT p.page_id, p.host, p.path, hit.rule AS rule, hit.verdict AS verdict FROM p LEFT JOIN urls USING (host, path)),
        links AS (SELECT host, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link
                  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)) AS link FROM p)),
        away AS (SELECT host AS src, {_HOST("link")} AS dst FROM links WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://')),
        known AS (SELECT DISTINCT host FROM p WHERE host <> ''),
        above AS (SELECT a.host AS low, b.host AS high FROM known a JOIN known b ON b.host = regexp_extract(a.host, '^[^.]+\\.(.+)$', 1)),
        edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM away WHERE src <> '' AND dst <> '' AND src <> dst
                  UNION ALL SELECT low, high FROM above UNION ALL SELECT high, low FROM above) GROUP BY ALL),
        shares AS (SELECT 0 AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
        seeds AS (SELECT k.kind, host, {1 - linkgraph.DAMPING} * avg(CASE WHEN ruled.verdict = k.verdict THEN 1.0 ELSE 0.0 END) AS given
                  FROM ruled, (VALUES (0, 'allow'), (1, 'block')) AS k(kind, verdict) WHERE host <> '' GROUP BY ALL),
        score AS (SELECT 0 AS i, kind, host, given AS score FROM seeds
                  UNION ALL SELECT i, kind, host, sum(part) FROM (
                      SELECT s.i + 1 AS i, s.kind, e.dst AS host, {linkgraph.DAMPING} * e.share * s.score AS part FROM score s JOIN shares e ON e.kind = s.kind AND e.src = s.host WHERE s.i < {linkgraph.ROUNDS}
                      UNION ALL SELECT r.i, d.kind, d.host, d.given FROM seeds d, (SELECT DISTINCT i + 1 AS i FROM score WHERE i < {linkgraph.ROUNDS}) r) GROUP BY ALL),
        sides AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 0), 0), 9) AS trust, round(coalesce(sum(score) FILTER (kind = 1), 0), 9) AS distrust FROM score WHERE i = {linkgraph.ROUNDS} GROUP BY 1)
        SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN s.distrust >= {linkgraph.LEAST} AND s.distrust > s.trust THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled r LEFT JOIN sides s USING (host)""",
}
