"""Streaming over sorted partitions, and connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, settle


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of a partition sorted by integer ``keys``, with the start of each group.

    Memory: a batch and the group that it cuts.
    """
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        starts = cuts(t)
        if len(starts) > 1:
            last = int(starts[-1])
            yield t.slice(0, last), starts[:-1]
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cuts(t)


def matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    a = column.combine_chunks()
    if not len(a):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(a), width)


def forest(m: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``m`` rows the first row of its component.

    ``linked(x, others)`` says which others row x is linked to. A row that is reached is not asked for
    again, so rows that hang together cost few calls; memory grows with ``m`` alone.
    """
    root, unseen = np.arange(m), np.arange(m)
    while len(unseen):
        first, unseen = int(unseen[0]), unseen[1:]
        queue = [first]
        while queue and len(unseen):
            hit = linked(queue.pop(), unseen)
            root[unseen[hit]] = first
            queue += unseen[hit].tolist()
            unseen = unseen[~hit]
    return root


def contract(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component so far) after the rows a and b are linked."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]


def _stars(edges: DataFrame, hold: int = 500_000) -> DataFrame:
    """The same components by fewer edges (u, v): each task links what it holds to the smallest node of each component that it sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, b = np.concatenate(held, axis=1)
            held.clear()
            nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = contract(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
            far = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(x.shape[1] for x in held) > hold:
                yield flush()
        if held:
            yield flush()

    return map_batches(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); a component is named by its smallest node.

    Alternating large and small stars: each round is joins and aggregations of the edges alone, and
    their number never grows. Loops and repeated edges are harmless; no edges give no rows.
    """
    pairs = settle(_stars(edges.where("a <> b")).distinct())
    before, tasks = None, 0
    while True:
        state = tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        tasks = tasks or max(8, state[0] // 50_000)  # edges of a task; their number never grows
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        before = state
        both = pairs.union(pairs.select("v", "u"))
        # Written, so that the join shuffles both sides and a node with very many neighbours can be split.
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = settle(large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct().coalesce(tasks))
