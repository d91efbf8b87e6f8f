"""Periodic runs, url filters by the link graph and conversation repair against brute force and on edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import conversations, linkgraph, periodic, queries, warc
from lattica.llm.common import table

SMALL = "/root/testdata/sf0.001"


# ---- 11 periodic runs


def brute_runs(words, least=24, repeats=3):
    n, found = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                s, e = i, j + q
                if not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                    found.add((s, e - s, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def test_runs_against_brute_force():
    rng = random.Random(5)
    for trial in range(250):
        n, letters = rng.randrange(0, 260), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(n)]
        if trial % 2 and n:
            at, p = rng.randrange(n), rng.randrange(1, 30)
            words[at : at + p * 5] = (words[at : at + p] * 5)[: len(words[at : at + p * 5])]
        assert periodic.periodic_runs(np.array(words, np.int64)) == brute_runs(words)


@pytest.mark.parametrize("least,repeats", [(24, 3), (4, 2), (10, 4)])
def test_runs_inside_runs(least, repeats):
    rng = random.Random(7)
    for _ in range(60):
        unit = [rng.randrange(2)] * rng.randrange(5, 40) + [rng.randrange(3) for _ in range(rng.randrange(4))]
        words = unit * rng.randrange(1, 7) + [9] + unit[: len(unit) // 2] * 4
        assert periodic.periodic_runs(np.array(words, np.int64), least, repeats) == brute_runs(words, least, repeats)


def test_lags_are_counted_exactly():
    rng = np.random.default_rng(3)
    for n in (30, 500, 6000):
        ids = np.minimum(rng.geometric(0.2, n), 40)
        longest = n // 3
        assert periodic.lag_counts(ids, longest)[1:].tolist() == [int((ids[q:] == ids[:-q]).sum()) for q in range(1, longest + 1)]


def test_islands_in_long_texts():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 5, 30_000)
    ids[4_000:4_300] = np.resize(ids[4_000:4_070], 300)
    ids[29_000:] = np.resize(ids[29_000:29_300], 1000)
    runs = periodic.periodic_runs(ids)
    full = [(s, m) for q in (70, 300) for s, m in periodic.islands(ids, q, 2 * q)]
    assert {(s, m) for s, m, q in runs if q == 70} == {(s, m + 70) for s, m in full[:1]} and any(q == 300 for _, _, q in runs)
    assert len(runs) == len({(s, m) for s, m, _ in runs})
    # One word through and through: multiples of the period are explained and need no scan.
    assert periodic.periodic_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_run_query_against_brute_force(spark):
    small = table(spark, SMALL, "documents").where(F.length("text") < 2500)
    got = {tuple(r) for r in periodic.run_report(periodic.find_runs(small, repeat=True)).collect()}
    assert got == {brute_report(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()}
    assert sum(r[1] > 0 for r in got) > 5
    assert queries.op11_periodic_runs(spark, SMALL).count() == table(spark, SMALL, "documents").count()


def test_run_edges(spark, edge_docs, no_docs):
    got = Counter(tuple(r) for r in periodic.run_report(periodic.find_runs(edge_docs.where("doc_id is null or doc_id not in (7, 8)"), repeat=True)).collect())
    assert got == Counter(brute_report(r.doc_id, r.text) for r in edge_docs.where("doc_id is null or doc_id not in (7, 8)").collect())
    assert periodic.find_runs(edge_docs).count() == edge_docs.count() and periodic.find_runs(no_docs).count() == 0
    text = "a\u00a0b\u0085c \x1cx " * 30  # only ASCII blanks part words
    row = periodic.find_runs(spark.createDataFrame([("k", text)], "doc_id string, text string")).first()
    assert row.n_words == 60 and [tuple(r) for r in row.runs] == [(0, 60, 2)] and bytes(row.collapsed).decode() == "a\u00a0b\u0085c \x1cx"


# ---- 12 url filters


def brute_judge(pages, rules):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def ruled(host, path):
        fit = [(-len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return min(fit)[1:] if fit else (None, None)

    rows = [(p, *split(u), html) for p, u, html in pages]
    hosts, edges = {h for _, h, _, _ in rows if h}, Counter()
    for _, h, _, html in rows:
        for link in re.findall(linkgraph.LINK, html or ""):
            link = "http:" + link if link.startswith("//") else link
            dst = split(link)[0] if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", link) else ""
            if h and dst and dst != h:
                edges[h, dst] += 1
    for h in hosts:
        up = h.split(".", 1)[1] if "." in h else ""
        if up in hosts:
            edges[h, up] += 1
            edges[up, h] += 1
    marks = defaultdict(list)
    for _, h, path, _ in rows:
        if h:
            marks[h].append(ruled(h, path)[1])
    side = {}
    for name, verdict, flip in (("trust", "allow", False), ("distrust", "block", True)):
        e = {((b, a) if flip else (a, b)): n for (a, b), n in edges.items()}
        total = Counter()
        for (a, _), n in e.items():
            total[a] += n
        seed = {h: 0.15 * sum(x == verdict for x in v) / len(v) for h, v in marks.items()}
        score = dict(seed)
        for _ in range(20):
            new = Counter(seed)
            for (a, b), n in e.items():
                new[b] += 0.85 * score.get(a, 0) * n / total[a]
            score = new
        side[name] = {h: round(x, 9) for h, x in score.items()}
    out = []
    for p, h, path, _ in rows:
        rule, verdict = ruled(h, path)
        t, d = side["trust"].get(h, 0), side["distrust"].get(h, 0)
        out.append((p, h, path, rule, verdict or ("block" if d >= 0.01 and d > t else "allow")))
    return Counter(out)


PAGES = "page_id long, url string, html string, host string, rule string, verdict string"


def judged(spark, pages):
    rows = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], PAGES)
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(rows, linkgraph.rule_table(spark, queries.URL_RULES)).collect())


def test_links_decide_hosts_without_rules(spark):
    link = lambda *hosts: " ".join(f'<A class=x HREF="https://{h}/p">x</A>' for h in hosts)
    pages = [
        (1, "http://bad.example.com/de/1", link("hub.net")), (2, "http://good.org/", link("nice.net", "nice.net", "//odd")), (3, "http://nice.net/a?b://c", "<a href='//good.org/x'>"),
        (4, "http://farm.net/x#y", link("bad.example.com", "bad.example.com")), (5, "http://FARM.net", link("other.io")), (6, "http://feeder.net/", link("farm.net")),
        (7, "https://example.org/es/q", None), (8, "https://a.example.org/en/153?x", ""), (9, "https://example.org/en/2", "<a href=/local>"), (10, "http://x.com/fr/", None),
        (11, None, link("bad.example.com")), (12, "mailto:me", None), (13, "", "x"), (14, "http://", None), (15, "x://y?z", None), (15, "x://y?z", None), (None, "http://sub.farm.net/", None), (16, "http://notorg/de/", "<a href='http://\u00c9.org'>"),
    ]
    got = judged(spark, pages)
    assert got == brute_judge(pages, queries.URL_RULES)
    verdict = {k[0]: k[4] for k in got}
    assert verdict[4] == verdict[6] == "block" and verdict[3] == verdict[2] == "allow" and verdict[7] == verdict[8] == "block" and verdict[9] == verdict[11] == verdict[12] == "allow"
    assert judged(spark, []) == Counter()


def by_sql(pages):
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    cursor = c.execute(queries.ORACLE_SQL["op12_url_filter"])
    return Counter(cursor.fetchall())


@pytest.mark.parametrize("limit", [0, linkgraph.BROADCAST])
def test_random_graphs(spark, monkeypatch, limit):
    monkeypatch.setattr(linkgraph, "BROADCAST", limit)
    rng = random.Random(2)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.") for b in ("one", "two", "example", "three") for c in ("org", "com", "net", "de")]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randrange(300)}", " ".join(f'<a href="http://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))) for i in range(150)]
    assert judged(spark, pages) == brute_judge(pages, queries.URL_RULES) == by_sql(pages)


def test_url_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "pages").select("page_id", "url", "html").collect()]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op12_url_filter(spark, SMALL).collect())
    assert got == brute_judge(rows, queries.URL_RULES)


# ---- 13 conversation repair


def dijkstra(rows):
    """rows: (role, text, fault). Least cost and audit over all edits, with the repaired lines."""
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        steps = []
        for r, name in (("u", "user"), ("a", "assistant")):
            steps.append(("I", 3, i, r, (f"{name}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps.append(("K", more, i + 1, role[:1], (f"{role}:{text}",)))
                steps += [("R", 3 + more, i + 1, r, (f"{name}:{text}",)) for r, name in (("u", "user"), ("a", "assistant"))]
        for letter, price, j, r, line in steps:
            if (state, r) in nxt:
                heapq.heappush(heap, (cost + price, audit + letter, j, nxt[state, r], lines + line))


def brute_repair(table_rows, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in table_rows:
        convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20 if damage else 19
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, named = [t for t, _, _ in rows if t is not None], set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            named.append((role, text, fault))
        n = Counter(f for _, _, f in named)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(named, named[1:]))
        cost, audit, text = dijkstra(named)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def random_rows(rng, convs, longest):
    roles = ["user", "assistant", "system", "User", "", None, "tool", "u", "été"]
    texts = ["Yes.", "No!", "cut", "", "  \n", None, "\u00a0", "a b.\x0b", "Long? no", "x.\u00a0", "same."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None, t // 2]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts)))
    return rows


CONV = "conv_id long, turn long, role string, text string, fault string, digest string"


@pytest.mark.parametrize("damage", [True, False])
def test_repair_against_brute_force(spark, damage):
    rows = random_rows(random.Random(11), 120, 9)
    df = spark.createDataFrame([(*r, "f", "d") for r in rows], CONV)
    got = conversations.repair(conversations.damaged(df) if damage else df, known=df)
    assert Counter(tuple(r) for r in got.collect()) == brute_repair(rows, damage)


def test_long_conversations_go_block_by_block(spark, monkeypatch):
    rng = random.Random(12)
    for block in (1, 2, 5):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(60):
            rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!"]), rng.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(rng.randrange(14))]
            state = conversations.Repair()
            for i, (role, text, fault) in enumerate(rows):
                state.add(i, fault, role.encode(), text.encode())
            cost, audit, text = dijkstra(rows)
            assert state.result()[5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
    monkeypatch.undo()
    big = conversations.Repair()
    for i in range(20_000):
        big.add(i, "", (b"user", b"assistant")[i % 2 if i < 10_000 else 1 - i % 2], b"%d." % i)
    assert big.result()[5] == 6 and big.rows == []  # an assistant and a user turn are put in, or the like


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_conversation_repair(spark, SMALL).collect()) == brute_repair(rows)


def test_repair_edges(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversations.repair(conversations.damaged(empty), known=empty).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "f", "d")], CONV)
    assert tuple(conversations.repair(conversations.damaged(df), known=df).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    strings = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    assert tuple(conversations.repair(strings).first())[:8] == ("c", 0, 0, 0, 0, 0, 0, "KK")


# ---- 4 archive: line ends in urls, ids of other types, damaged files


LINE_ENDS = ["\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029", "\x0b", "\x0c", "\x00"]


def test_urls_cannot_forge_headers(spark, tmp_path):
    body = "x" * 200
    pages = [(i, f"http://a{end}WARC-Payload-Digest: sha256:abc{end}WARC-Refers-To: <urn:page:7>{end}WARC-Type: revisit{end}WARC-Record-ID: <urn:page:99>{end}Content-Length: 1", f"{i}{body}") for i, end in enumerate(LINE_ENDS)]
    pages += [(50, "http://\u00e9/%41", body), (51, None, body), (None, "u", body), (52, "", None)]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = {r.page_id: r for r in warc.page_rows(warc.records(spark, str(tmp_path / "a"))).collect()}
    for i, url, html in pages:
        r = got[i]
        assert r.payload_digest == hashlib.sha256((html or "").encode()).hexdigest() and r.payload_bytes == len(html or "")
        assert (r.record_type, r.refers_to) == (("revisit", 50) if i in (51, None) else ("response", None))
        assert not re.search(warc.BREAKS, r.url)
    assert got[50].url == "http://\u00e9/%41" and got[51].url == "" and got[3].url.startswith("http://a%C2%85WARC")
    warc.export_warc(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    back = {r.page_id: r for r in warc.page_rows(warc.read_warc(spark, str(tmp_path / "w") + "/part-*")).collect()}
    assert {i: (r.payload_digest, r.record_type, r.refers_to) for i, r in back.items()} == {i: (r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()}


def test_ids_of_other_types(spark, tmp_path):
    body = "y" * 150
    ids = ["b>\r\n", "a b", "\u00e9", "7", ""]
    warc.write_archive(spark.createDataFrame([(i, "u", body) for i in ids], "page_id string, url string, html string"), str(tmp_path / "s"))
    rows = warc.page_rows(warc.records(spark, str(tmp_path / "s")), "string").collect()
    assert {r.page_id: r.refers_to for r in rows} == {i: None if i == "" else "" for i in ids}


def test_damaged_warc_files(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    (tmp_path / "ok").write_bytes(head + b"hello\r\n\r\n")
    (tmp_path / "none").write_bytes(b"")
    assert [bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [b"hello"]
    for broken in (head + b"he", head.replace(b"Content-Length", b"Length") + b"hello\r\n\r\n"):
        (tmp_path / "bad").write_bytes(broken)
        with pytest.raises(Exception, match="ValueError"):
            warc.read_warc(spark, str(tmp_path / "bad")).collect()
