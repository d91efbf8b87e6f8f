"""Removal of repeated byte strings by hashed samples of suffixes.

A string of ``width`` bytes is repeated if it also starts earlier.  A suffix order of every byte would
move some thirty times the (compressed) texts, so no suffix array is built: in every window of
``width`` bytes the 32-byte word of smallest hash marks one place, so equal windows mark the same
place, as local minima do in induced sorting.  Each sample carries a tuple (hash of its word, hash of
its context, document, first and last window that it stands for); Spark's spilling sort brings equal
words together.  Where whole contexts agree all their windows are settled at once, and only where
contexts of one word differ are the windows themselves compared, byte by byte.

Every task drops what it can decide alone (a later copy of something it holds) before the shuffle,
so a passage in a third of all documents costs one tuple a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.llm.common import map_batches, settle
from lattica.llm.groups import whole_groups
from lattica.llm.rolling import BASE, INVERSE, U64, buffer_of, chunks, mix, portions, powers

#: Bytes of the word at a sample, and contexts of one name that are compared in one group; the windows of more go in groups of their own.
WORD_BYTES, TOGETHER = 32, 512
#: Longer texts are read in parts of so many bytes, which overlap so that each window lies in one part.
PART = 1 << 22
#: The lower bits of a sample's key hold its place, the upper ones its hash, whatever the size of the batch: words that tie
#: there mark the first of them in every copy alike.
PLACE = U64((1 << 32) - 1)
_BYTE = mix(np.arange(256, dtype=U64) + U64(0x1234567))


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate(([U64(0)], np.cumsum(_BYTE[data] * powers(BASE, len(data)))))


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(U64))


def samples(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(index of text, first window, last window, name of word, name of context) of each sample."""
    data, starts = buffer_of(texts)
    n = len(data)
    span = width - WORD_BYTES + 1  # words in a window
    if n < width:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    h, size = _BYTE[data], 1
    while size < WORD_BYTES:
        h = h[: n - 2 * size + 1] * U64(pow(BASE, size, 1 << 64)) + h[size : n - size + 1]
        size *= 2
    h = mix(h)
    key = (h & ~PLACE) | np.arange(len(h), dtype=U64)
    low, size = key, 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    lengths = np.diff(np.append(starts, n)) - 1
    valid = np.flatnonzero(np.arange(len(low)) + width <= np.repeat(starts + lengths, lengths + 1)[: len(low)])
    if not len(valid):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    at = (low[valid] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(valid) != 1))))
    first, last, at = valid[new], valid[np.append(new[1:], len(valid)) - 1], at[new]
    of = np.searchsorted(starts, first, side="right") - 1
    return of, first - starts[of], last - starts[of], h[at], _hash(_prefix_sums(data), first, last + width)


def _later(names: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries have an earlier (document, start) with equal names."""
    order = np.lexsort((start, doc, *names[::-1]))
    same = np.ones(len(order), bool)
    for x in names:
        v = x[order]
        same[1:] &= v[1:] == v[:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    later = np.zeros(len(order), bool)
    later[order] = same & ((d != d[head]) | (s != s[head]))
    return later


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each document, with those that touch joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    base = np.cumsum(change) * (int(end.max()) + 1)  # documents in ranges of their own, so that one running maximum serves all
    reach = np.maximum.accumulate(end + base)
    new = np.flatnonzero(np.concatenate(([True], start[1:] + base[1:] > reach[:-1])) | change)
    return doc[new], start[new], (reach - base)[np.append(new[1:], len(doc)) - 1]


TUPLES = "cut boolean, key long, context long, doc_id long, first int, last int"


def _sampled(docs: DataFrame, width: int, hold: int = 250_000) -> DataFrame:
    """Tuples of the samples that are first in their task, and intervals [first, last) to cut (``cut``) of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, first, last, word, context = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            later = _later([word, context], doc, first)
            d, a, z = _merged(doc[later], first[later], last[later] + width)
            keep = ~later
            columns = [
                (np.ones(len(d), bool), np.zeros(keep.sum(), bool)),
                (mix(d.view(U64)).view(np.int64), word[keep].view(np.int64)),
                (np.zeros(len(d), np.int64), context[keep].view(np.int64)),
                (d, doc[keep]),
                (a.astype(np.int32), first[keep].astype(np.int32)),
                (z.astype(np.int32), last[keep].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["cut", "key", "context", "doc_id", "first", "last"])

        for b in portions(batches, "text"):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            parts = [(i, at, t[at : at + PART + width - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - width + 1), PART)]
            which, base = (np.array([p[c] for p in parts], np.int64) for c in (0, 1))
            ids = b.column(0).to_numpy(zero_copy_only=False)[which]
            bodies = [p[2] for p in parts]
            for i, j in chunks(bodies, 1 << 18):
                of, first, last, word, context = samples(bodies[i:j], width)
                if len(of):
                    held.append((ids[i:j][of], first + base[i:j][of], last + base[i:j][of], word, context))
                if sum(len(x[0]) for x in held) > hold:
                    yield from flush()
        if held:
            yield from flush()

    return map_batches(docs, run, TUPLES)


def _same_bytes(data: np.ndarray, width: int, group: np.ndarray, place: np.ndarray, name: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows also start earlier in their group: equal in name to the first of that name, and byte for byte."""
    order = np.lexsort((start, doc, name, group))
    same = np.zeros(len(order), bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (name[order][1:] == name[order][:-1])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    x, y = order[same], head[same]
    later = (doc[x] != doc[y]) | (start[x] != start[y])
    x, y = x[later], y[later]
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    found = np.zeros(len(order), bool)
    for low in range(0, len(x), 1 << 16):
        p, q = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
        found[p] = (views[place[p]] == views[place[q]]).all(axis=1)
    return found


def _induce(tuples: DataFrame, width: int) -> DataFrame:
    """Over tuples sorted by name: cuts of contexts that also start earlier, and, where one name has several contexts, each one's first for comparison (``held``: how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["key"]):
            cut, key, context, doc, first, last = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cut", "key", "context", "doc_id", "first", "last"))
            s = np.flatnonzero(~cut)
            k, c, d, f = key[s], context[s], doc[s], first[s]
            new_key = np.concatenate(([True], k[1:] != k[:-1]))[: len(s)]
            new = new_key | np.concatenate(([True], c[1:] != c[:-1]))[: len(s)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            later = ~new & ((d != d[head]) | (f != f[head]))
            group = np.cumsum(new_key) - 1
            held = np.bincount(group[new], minlength=group[-1] + 1 if len(s) else 0)[group]
            heads = s[new & (held > 1)]
            gone = s[later]
            rows = np.concatenate((np.flatnonzero(cut), gone, heads))
            ends = np.concatenate((last[cut], last[gone] + width, last[heads]))
            counts = np.concatenate((np.zeros(len(rows) - len(heads), np.int64), held[new & (held > 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (counts, key[rows], doc[rows], first[rows], ends.astype(np.int32))], names=["held", "key", "doc_id", "first", "last"])

    ordered = tuples.repartition("key").sortWithinPartitions("key", "context", "doc_id", "first")
    return map_batches(ordered, run, "held long, key long, doc_id long, first int, last int")


CONTEXTS = "cut boolean, key long, doc_id long, first int, last int, bytes binary"


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """The bytes of the contexts to compare. Where one name has very many, their windows go each under its own hash, and those that come later in the task are cut at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            out: list[tuple] = []
            many: list[tuple] = []
            for doc, text, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = (text or "").encode()
                for h in heads:
                    if h["held"] <= TOGETHER:
                        out.append((False, h["key"], doc, h["first"], h["last"], body[h["first"] : h["last"] + width]))
                    else:
                        many.append((doc, h["first"], h["last"], body[h["first"] : h["last"] + width]))
            if many:
                data, starts = buffer_of([m[3] for m in many])
                count = np.array([m[2] - m[1] + 1 for m in many])
                of = np.repeat(np.arange(len(many)), count)
                shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                at = starts[of] + shift
                name = _hash(_prefix_sums(data), at, at + width)
                doc, first = np.array([m[0] for m in many])[of], np.array([m[1] for m in many])[of] + shift
                later = _same_bytes(data, width, np.zeros(len(of), np.int64), at, name, doc, first)
                out += [(True, int(d), int(d), int(a), int(z), b"") for d, a, z in zip(*_merged(doc[later], first[later], first[later] + width), strict=True)]
                for x in np.flatnonzero(~later):
                    out.append((False, int(name[x].view(np.int64)), int(doc[x]), int(first[x]), int(first[x]), many[of[x]][3][shift[x] : shift[x] + width]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cut", "key", "doc_id", "first", "last", "bytes"])

    return map_batches(rows, run, CONTEXTS)


def _compare(contexts: DataFrame, width: int) -> DataFrame:
    """Cuts (doc_id, first, last) of the windows that some earlier context of the same name holds, verified byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts_of in whole_groups(batches, ["key"]):
            cut, doc, first, last = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cut", "doc_id", "first", "last"))
            group = np.repeat(np.arange(len(starts_of)), np.diff(np.append(starts_of, len(t))))
            kept = [(doc[cut], first[cut].astype(np.int64), last[cut].astype(np.int64))]
            rows = np.flatnonzero(~cut)
            bodies = t.column("bytes").to_pylist()
            at = 0  # about 256 KB at once, cut only between groups
            while at < len(rows):
                end, total = at, 0
                while end < len(rows) and (total < 1 << 18 or group[rows[end]] == group[rows[end - 1]]):
                    total += len(bodies[rows[end]])
                    end += 1
                r = rows[at:end]
                at = end
                data, starts = buffer_of([bodies[x] for x in r])
                count = (last[r] - first[r] + 1).astype(np.int64)
                of = np.repeat(np.arange(len(r)), count)
                shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                place = starts[of] + shift
                name, g, d, s = _hash(_prefix_sums(data), place, place + width), group[r][of], doc[r][of], first[r][of] + shift
                ok = _same_bytes(data, width, g, place, name, d, s)
                kept.append((d[ok], s[ok], s[ok] + width))
            d, a, z = _merged(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["doc_id", "first", "last"])

    ordered = contexts.repartition("key").sortWithinPartitions("key", "doc_id", "first")
    return map_batches(ordered, run, "doc_id long, first int, last int")


CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:int,last:int>>, kept binary, kept_text string"


def repeated_bytes(docs: DataFrame, width: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed runs, [first, last) in bytes), kept (the other bytes),
    kept_text (those as text, without characters of which a part was cut; null for a null text), and the columns in ``keep``.

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document of
    smaller doc_id or at an earlier place of the same one. Strings never cross documents and are
    judged on the input. Whole contexts of one word are equal if their 64-bit hashes are, all else is
    compared byte by byte. Null texts count as empty; texts of fewer than ``width`` bytes stay whole.
    Rows that repeat a doc_id and its text count as one document, so a repeated row does not remove
    itself, and each row is returned. Rows with a null doc_id, or one that stands for several texts,
    have no place in the order: they stay whole and remove nothing. An empty table gives no rows;
    other columns are not read.
    """
    # Without a cast where none is needed: a renamed column would keep the two scans of `known` from sharing a shuffle.
    is_long = dict(docs.dtypes)["doc_id"] == "bigint"
    texts = docs.select("doc_id", "text", *keep) if is_long else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    known, alone = texts.where("doc_id is not null"), texts.where("doc_id is null")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    several = known.groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a <> b").select("doc_id")
    if not several.isEmpty():
        alone = alone.union(known.join(several, "doc_id", "left_semi").select(texts.columns))
        known = known.join(several, "doc_id", "left_anti").select(texts.columns)
    found = settle(_induce(_sampled(known.select("doc_id", "text"), width), width))
    heads = found.where("held > 0").groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "last", "held")).alias("heads"))
    # `known` meets `heads` and `spans` with the same columns, so its rows are shuffled once for both.
    compared = _compare(_contexts(known.join(heads, "doc_id").select("doc_id", "text", "heads", *keep), width), width)
    cuts = found.where("held = 0").select("doc_id", "first", "last").union(compared)
    spans = cuts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("cuts"))
    schema = StructType.fromDDL(CUT)
    kept_fields = [f for f in texts.schema.fields if f.name in keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            rows = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body, merged = (text or "").encode(), []
                for c in cuts or []:
                    if merged and c["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c["last"])
                    else:
                        merged.append([c["first"], c["last"]])
                edges = [0, *(x for m in merged for x in m), len(body)]
                pieces = [body[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(pieces)
                rows.append((len(body), len(body) - len(kept), [{"first": a, "last": z} for a, z in merged], kept, None if text is None else "".join(x.decode(errors="ignore") for x in pieces)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *b.columns[3:]], names=[*schema.names, *(f.name for f in kept_fields)])

    rest = alone.withColumn("cuts", F.lit(None).cast("array<struct<first:int,last:int>>"))
    rows = known.join(spans, "doc_id", "left").unionByName(rest).select("doc_id", "text", "cuts", *(f.name for f in kept_fields))
    return map_batches(rows, cut, StructType([*schema.fields, *kept_fields]))
