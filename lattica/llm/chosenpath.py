"""Similarity join on word shingles by chosen paths.

Documents with equal shingle sets form one class.  Each class is embedded as 64 min-hash tokens.  A
run walks a random tree: at a node, which is a path of tokens chosen so far, each token is sampled with
probability 1 / (threshold * 64) by a hash of the path, and a class goes down to every sampled token it
has.  Nodes with few classes are compared by brute force on short sketches; larger ones are split
again.  Runs repeat until a pair at the threshold is met with the target probability.  Candidates are
then verified exactly: the classes of one candidate component are compared in blocks on their full
sets, so links are counted without a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, settle
from lattica.llm.groups import components, forest, matrix, whole_groups
from lattica.llm.rolling import U64, chunks, mix, portions, shingle_sets

TOKENS = 64
SKETCHED = "doc_id long, digest long, n int, s1 long, s2 long, tokens binary, sketch binary"


def runs_needed(threshold: float, target: float, levels: int) -> int:
    """Runs after which a pair at the threshold has met in one node at the deepest of ``levels`` splits with probability ``target``.

    Each of its shared tokens is sampled with probability 1 / (threshold * 64), so a path that lives
    one level more must find a child that lives all the rest.
    """
    shared, lives = threshold * TOKENS, 1.0
    for _ in range(levels):
        lives = 1 - (1 - lives / shared) ** shared
    return math.ceil(math.log(1 - target) / math.log(1 - lives))


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, digest, n, s1, s2, tokens, sketch): hash of the text, size and two 64-bit sums of its shingle set, 64 min-hashes, and one byte of each."""
    rng = np.random.default_rng(7)
    factors = (rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            n, s1, s2 = np.zeros(len(texts), np.int32), np.zeros(len(texts), U64), np.zeros(len(texts), U64)
            tokens = np.zeros((len(texts), TOKENS), np.uint32)
            for i, j in chunks(texts):
                sets, at = shingle_sets(texts[i:j], k)
                full = np.flatnonzero(np.diff(at))
                n[i:j] = np.diff(at)
                if not len(full):
                    continue
                starts = at[:-1][full]
                mixed = mix(sets)
                s1[i + full], s2[i + full] = np.add.reduceat(mixed, starts), np.add.reduceat(mix(mixed ^ U64(0x5BD1E995)), starts)
                short = (mixed >> U64(32)).astype(np.uint32)
                for t in range(TOKENS):
                    x = short * factors[0][t]
                    x += factors[1][t]
                    x ^= x >> np.uint32(15)
                    tokens[i + full, t] = np.minimum.reduceat(x, starts)
            low = (tokens * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            rows = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), rows(tokens), rows(low)], names=["doc_id", "digest", "n", "s1", "s2", "tokens", "sketch"])

    return map_batches(identified(docs), run, SKETCHED)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text): an id may stand for several texts, so both together name a document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text")


def id_key(doc_id: Column) -> Column:
    """An id as text, empty for a null, so that joins on it and what follows share one shuffle."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def text_digest(text: Column) -> Column:
    """64-bit hash of a text; a null counts as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _descend(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Children (path, rep, n, sketch) of nodes: of the ``runs`` roots, or of each row's own ``path`` where it has one."""
    limit = U64(int((1 << 64) / (threshold * TOKENS)))
    deeper = "path" in classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(TOKENS, dtype=U64) + U64(1))
        for b in batches:
            t = pa.Table.from_batches([b])
            own = mix((matrix(t.column("tokens"), "<u4", TOKENS).astype(U64) << U64(8)) ^ place)
            roots = [t.column("path").to_numpy().view(U64)[:, None]] if deeper else [mix(np.array([[r + 1]], U64)) for r in range(runs)]
            for root in roots:
                child = mix(own ^ root)
                row, token = np.nonzero(child < limit)
                path = mix(child[row, token] ^ U64(0xA5A5A5A5))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(b.column(b.schema.get_field_index(c)).take(take) for c in ("rep", "n", "sketch"))], names=["path", "rep", "n", "sketch"])

    return map_batches(classes, run, "path long, rep long, n int, sketch binary")


def _bucket_pairs(buckets: DataFrame, threshold: float, slack: float = 0.18, few: int = 12) -> DataFrame:
    """Edges (a, b) within nodes whose sizes and sketches allow the threshold; large nodes give a spanning forest of them."""
    least = math.floor((threshold - slack) * TOKENS)

    def like(n, m, same):
        return (np.minimum(n, m) >= threshold * np.maximum(n, m)) & (same >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["path"]):
            reps, n, sk = t.column("rep").to_numpy(), t.column("n").to_numpy(), matrix(t.column("sketch"), "u1", TOKENS)
            size = np.diff(np.append(starts, len(t)))
            group = np.repeat(np.arange(len(starts)), size)
            small = size[group] <= few
            a, b = [], []
            for d in range(1, few):
                at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(t) > d else np.zeros(0, int)
                if not len(at):
                    break
                ok = at[like(n[at], n[at + d], (sk[at] == sk[at + d]).sum(axis=1))]
                a.append(reps[ok])
                b.append(reps[ok + d])
            for g in np.flatnonzero(size > few):
                i, j = starts[g], starts[g] + size[g]
                near = lambda x, others, i=i: like(n[i + x], n[i + others], (sk[i + others] == sk[i + x]).sum(axis=1))
                a.append(reps[i:j])
                b.append(reps[i + forest(j - i, near)])
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["a", "b"])

    return map_batches(buckets, run, "a long, b long").where("a <> b").distinct()


def _dealt(nodes: DataFrame) -> DataFrame:
    """The nodes with each one's rows together and in order.

    Dealt by a hash of the path: a repartition by the path itself would be dropped behind a join on it,
    and adaptive execution may then read that join's rows in other partitions than the path's.
    """
    return nodes.withColumn("dealt", F.xxhash64("path")).repartition("dealt").sortWithinPartitions("path").drop("dealt")


#: Up to so many keys, which were counted, go to every executor in place of a shuffle of what they are joined to.
SENT = 2_000_000


def candidates(classes: DataFrame, threshold: float = 0.8, target: float = 0.999, bucket: int = 4096, levels: int = 3) -> DataFrame:
    """Candidate edges (a, b) between classes (rep, n, tokens, sketch).

    Nodes of more than ``bucket`` classes are split again, ``levels`` splits in all; what is larger
    still is dealt into blocks, and all blocks of such a node are compared with each other. A pair at
    the threshold meets with probability ``target``, and passes the sketches with 0.9998.
    """
    runs = runs_needed(threshold, target, levels)
    nodes, found = _descend(classes.select("rep", "n", "tokens", "sketch"), runs, threshold), []
    for level in range(1, levels + 1):
        large = settle(nodes.groupBy("path").agg(F.count("*").alias("held")).where(F.col("held") > bucket))
        if large.isEmpty():
            found.append(_bucket_pairs(_dealt(nodes), threshold))
            break
        large = F.broadcast(large) if large.count() <= SENT else large  # at most one in ``bucket`` rows of the nodes, which are so shuffled once, by ``_dealt``
        found.append(_bucket_pairs(_dealt(nodes.join(large, "path", "left_anti")), threshold))
        rest = nodes.join(large, "path")
        if level == levels:
            blocks = F.ceil(F.col("held") / (bucket // 2))
            own = F.pmod(F.xxhash64("rep"), blocks)
            pair = lambda c: F.xxhash64("path", F.least(own, c), F.greatest(own, c))
            dealt = rest.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), pair)).alias("path"), "rep", "n", "sketch")
            found.append(_bucket_pairs(_dealt(dealt), threshold))
        else:
            nodes = settle(_descend(rest.select("path", "rep").join(classes, "rep").select("path", "rep", "n", "tokens", "sketch"), runs, threshold))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def verify(docs: DataFrame, members: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Exact links among the classes of each candidate component: (rep, links, root).

    ``members``: (rep, doc_id, digest, copies, component, blocks), the second and third naming a document that has the
    class's set. Every pair of a component is compared once, in the task of
    its pair of blocks; ``links`` adds up, over a rep's rows, the documents it is linked to, and
    (rep, root) are edges that join the linked classes.
    """
    over, under = round(threshold * 1000), 1000

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            for i, j in chunks(texts):
                found, at = shingle_sets(texts[i:j], k)
                rows = pa.array([found[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[1:]), rows], names=["rep", "copies", "component", "blocks", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["component", "b1", "b2"]):
            reps, copies, own, b1, b2 = (t.column(c).to_numpy() for c in ("rep", "copies", "own", "b1", "b2"))
            tokens = t.column("tokens")
            out: list[list[np.ndarray]] = [[], [], []]
            for i, j in zip(starts, [*starts[1:], len(t)], strict=True):
                held = [np.frombuffer(x.as_buffer(), "<u8") for x in tokens[i:j]]
                linked = _linked(held, over, under) & (reps[i:j, None] != reps[None, i:j])
                if b1[i] != b2[i]:
                    linked &= own[i:j, None] != own[None, i:j]
                first = forest(j - i, lambda x, others, linked=linked: linked[x, others])
                for o, x in zip(out, (reps[i:j], linked @ copies[i:j], reps[i + first]), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["rep", "links", "root"])

    members = settle(members.withColumn("key", id_key(F.col("doc_id"))).drop("doc_id"))
    texts, name = identified(docs).withColumn("key", id_key(F.col("doc_id"))), F.xxhash64("key", "digest").alias("name")
    if members.count() <= SENT:  # other texts are left out before the shuffle
        texts = texts.withColumn("name", name).join(F.broadcast(members.select(name)), "name", "left_semi").drop("name")
    found = texts.join(members, ["key", "digest"]).dropDuplicates(["key", "digest"])
    rows = map_batches(found.select("text", "rep", "copies", "component", "blocks"), sets, "rep long, copies long, component long, blocks long, tokens binary")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("rep", "copies", "component", "own", "tokens", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    keys = ["component", "b1", "b2"]
    return map_batches(rows.repartition(*keys).sortWithinPartitions(*keys, "rep"), compare, "rep long, links long, root long")


def _linked(held: list[np.ndarray], over: int, under: int, width: int = 4096) -> np.ndarray:
    """Which sets have a Jaccard similarity of at least over / under; exact, in integers."""
    m = len(held)
    size = np.array([len(h) for h in held], np.int64)
    common = np.zeros((m, m), np.int64)
    flat, of = np.concatenate(held), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    name = np.cumsum(new) - 1
    shared = np.bincount(name)[name] > 1
    of, name = of[shared], name[shared]
    if len(name):
        name = np.cumsum(np.concatenate(([True], name[1:] != name[:-1]))) - 1
        for low in range(0, int(name[-1]) + 1, width):
            i, j = np.searchsorted(name, (low, low + width))
            hit = np.zeros((m, min(width, int(name[-1]) + 1 - low)), np.float32)
            hit[of[i:j], name[i:j] - low] = 1
            common += np.rint(hit @ hit.T).astype(np.int64)
    linked = under * common >= over * (size[:, None] + size[None] - common)
    np.fill_diagonal(linked, False)
    return linked


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, target: float = 0.999, block: int = 384, shingles: int = 250_000) -> DataFrame:
    """One row per document: doc_id, digest, class_id, set_id, n_copies, n_links, first.

    ``set_id``: smallest doc_id with the same shingle set, of which there are ``n_copies``.
    ``n_links``: other documents, copies included, whose sets have at least the threshold.
    ``class_id``: smallest doc_id of the component that these links make. ``first``: whether the
    document is the one of its class with the smallest doc_id, and among texts that share that id the
    smallest ``digest``.

    A text of fewer than ``k`` words has one shingle; null texts and those without words stand alone,
    with no links. A doc_id may repeat, with one text or several: every row counts as a document, and
    texts are linked by what they hold, not by their id. Null ids come after all others; a class of
    such rows alone has a null class_id. An empty table gives no rows; other columns are not read.

    Blocks of a component hold about ``block`` classes or ``shingles`` shingles, which bounds a task's memory.
    """
    each = settle(sketch(docs, k))
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    classes = settle(
        each.where("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min(name).alias("name"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
        .withColumn("rep", F.xxhash64("s1", "s2"))
    )
    parts = components(candidates(classes, threshold, target))
    own = classes.select("rep", "name.doc_id", "name.digest", "copies", "n")
    of = parts.join(own, parts["node"] == F.col("rep")).select("rep", "doc_id", "digest", "copies", "n", "component")
    size = of.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / shingles)).alias("blocks"))
    links = settle(verify(docs, of.drop("n").join(size, "component"), threshold, k))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, F.col("rep") == roots["node"], "left").select("rep", "links", "component")
    linked = classes.select("s1", "s2", "rep", "name", "copies").join(counted, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = linked.groupBy("component").agg(F.min("name").alias("head"))
    known = linked.join(heads, "component").select("s1", "s2", "name", "copies", F.coalesce("links", F.lit(0)).alias("links"), "head")
    alone = F.col("n") == 0
    return each.select("doc_id", "digest", "n", "s1", "s2").join(known, ["s1", "s2"], "left").select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("set_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest")))).alias("first"),
    )
