"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights.  A task holds one block of queries and one block of
candidates; for each term it walks the term's posting list and scatters query weight times posting
weight into dense score arrays, then selects each query's k best by partition.  The winners of all
candidate blocks are merged per query.  Every query meets every block once, which is what exhaustive
search asks for; blocks are of fixed size, so memory does not grow, and a task scores 128 queries at
a time.  Sums are exact: 32-bit where they fit, else 64-bit, else Python's integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_row long, query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integer_rows(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, terms array<int>, weights array<double>): floor(scale * x) of each component, zeros left out.

    The weights are whole numbers; as doubles they hold any that a component can give.  Vectors that
    are null, hold a null or a non-finite component, or have a null id take no part; a repeated row
    stays as often as it is there; other columns are not read.
    """
    v = F.col(vector)
    whole = F.transform(v, lambda x: x.cast("double") * scale)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() gives a long, so it serves only where that holds the number; larger doubles are whole already.
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    entries = F.filter(F.transform(whole, lambda x, i: F.struct(i.alias("t"), floor(x).alias("w"))), lambda e: e["w"] != 0)
    return vectors.where(sound).select(F.col(id_col).alias("vec_id"), entries.alias("e")).select("vec_id", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


def _integers(weights: np.ndarray, kind) -> np.ndarray:
    return weights.astype(kind) if kind is not object else np.array([int(w) for w in weights], object)


def _scores(q_terms, q_weights, c_terms, c_weights) -> np.ndarray:
    """Dense score arrays, one for each query row, over the candidates."""
    q_of, c_of = (np.repeat(np.arange(len(t)), [len(x) for x in t]) for t in (q_terms, c_terms))
    q_t, c_t = (np.concatenate(x).astype(np.int64) for x in (q_terms, c_terms))
    q_w, c_w = (np.concatenate(x).astype(float) for x in (q_weights, c_weights))
    terms = int(max(q_t.max(initial=-1), c_t.max(initial=-1))) + 1
    largest = int(np.abs(q_w).max(initial=0)) * int(np.abs(c_w).max(initial=0)) * terms
    kind = np.int32 if largest < 1 << 31 else np.int64 if largest < 1 << 63 else object
    q_w, c_w = _integers(q_w, kind), _integers(c_w, kind)
    scores = np.zeros((len(q_terms), len(c_terms)), kind)
    c_order, q_order = np.argsort(c_t, kind="stable"), np.argsort(q_t, kind="stable")
    held = np.intersect1d(c_t, q_t)
    c_from, c_to = (np.searchsorted(c_t[c_order], held, side=s) for s in ("left", "right"))
    q_from, q_to = (np.searchsorted(q_t[q_order], held, side=s) for s in ("left", "right"))
    for a, b, x, y in zip(c_from, c_to, q_from, q_to, strict=True):
        post, ask = c_order[a:b], q_order[x:y]
        rows, weights = c_of[post], c_w[post]
        if 2 * len(rows) >= scores.shape[1]:  # a dense list: spread its weights once, then add whole arrays
            spread = np.zeros(scores.shape[1], kind)
            spread[rows] = weights
            for q, w in zip(q_of[ask], q_w[ask], strict=True):
                scores[q] += w * spread
        else:
            for q, w in zip(q_of[ask], q_w[ask], strict=True):
                scores[q, rows] += w * weights
    return scores


def _best(scores: np.ndarray, own: slice, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores outside ``own``, best first, ties by place."""
    place = np.delete(np.arange(len(scores)), own)
    s = np.delete(scores, own)
    if len(s) > k and s.dtype != object:  # all above the k-th highest score, and of those equal to it the first ones
        least = np.partition(s, len(s) - k)[len(s) - k]
        high, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
        take = np.concatenate((high, equal[: k - len(high)]))
        place, s = place[take], s[take]
    order = sorted(range(len(s)), key=lambda i: (-int(s[i]), place[i]))
    return place[order[:k]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 4096, candidate_block: int = 4096) -> DataFrame:
    """The ``k`` candidates of highest score for each query: (query_id, rank from 1, vec_id, score).

    Both inputs are as ``integer_rows`` gives them.  Ties go to the smaller vec_id; candidates with
    the query's own id are left out; a query with fewer candidates has fewer rows, one with none has
    no row.  Repeated ids among the candidates count each for itself; query rows that share an id are
    queries of their own, with ranks of their own.  Empty tables give no rows.  A score among the
    best that a long cannot hold stops the search.
    """
    n_q, n_c = max(1, math.ceil(queries.count() / query_block)), max(1, math.ceil(candidates.count() / candidate_block))
    block = lambda name, n: F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n)).cast("int").alias(name)
    all_of = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    numbered = queries.select(F.monotonically_increasing_id().alias("query_row"), "vec_id", "terms", "weights")
    q = numbered.select("*", block("qb", n_q)).select("*", all_of("cb", n_c))
    c = candidates.select("vec_id", "terms", "weights", block("cb", n_c)).select("*", all_of("qb", n_q))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a side without rows may come without columns
            return pa.table([pa.array([], pa.int64())] * 4, names=["query_row", "query_id", "vec_id", "score"])
        right = right.sort_by("vec_id")
        q_ids, c_ids = (t.column("vec_id").to_numpy() for t in (left, right))
        numbers = left.column("query_row").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(q_ids) and len(c_ids):
            lists = lambda t, name: t.column(name).combine_chunks()
            cut = lambda a: np.split(a.flatten().to_numpy(), a.offsets.to_numpy()[1:-1] - a.offsets[0].as_py())
            c_terms, c_weights = (cut(lists(right, n)) for n in ("terms", "weights"))
            q_terms, q_weights = (cut(lists(left, n)) for n in ("terms", "weights"))
            first, last = np.searchsorted(c_ids, q_ids), np.searchsorted(c_ids, q_ids, side="right")
            for i in range(0, len(q_ids), 128):
                scores = _scores(q_terms[i : i + 128], q_weights[i : i + 128], c_terms, c_weights)
                for row, s in enumerate(scores, start=i):
                    at = _best(s, slice(first[row], last[row]), k)
                    if s.dtype == object and not all(LEAST <= x <= MOST for x in s[at]):
                        raise OverflowError(f"a score of query {q_ids[row]} leaves the range of a long")
                    for o, x in zip(out, (np.full(len(at), numbers[row]), np.full(len(at), q_ids[row]), c_ids[at], s[at].astype(np.int64)), strict=True):
                        o.append(x)
        columns = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in out]
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], names=["query_row", "query_id", "vec_id", "score"])

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
