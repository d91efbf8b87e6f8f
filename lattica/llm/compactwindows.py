"""Near-duplicate passages by compact windows.

Tokens are word shingles.  Under one hash function a Cartesian tree over a document's token hashes
says, for each token, the widest window in which it is the minimum: all subsequences of that window
which hold the token share it as their min-hash, so one compact window stands for all of them.  Only
windows at least as wide as the shortest passage matter.

Windows of equal signature have equal tokens at their centres, so their intervals are joined around
it: each carries the hashes of the tokens of its interval, and two passages match where the intervals
overlap by the shortest passage and enough of its tokens agree.  Verbatim passages of a group are found
by hashing, near ones by comparing what shares a run; neither makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, partitions, remove_folder, settle, store
from lattica.llm.groups import components, contract, whole_groups
from lattica.llm.rolling import BASE, INVERSE, U64, chunks, mix, portions, powers, shingles

#: Hash functions, one of which must agree on a passage; at a similarity of 0.8 that happens with probability 0.992, for a verbatim one always.
FUNCTIONS = 3
#: Lower bits of a token's key hold its place, so that equal upper bits tie alike in every batch.
PLACE = U64((1 << 32) - 1)
#: A signature of over twice so many windows is a crowd: its different intervals stand once, in blocks of this size, any two of which meet in a task.
CROWD = 8192
#: Runs shared by at most so many rows are compared in all pairs at once; groups with larger ones are matched by hashes around a gap.
FEW = 24
#: Kept for callers that set it; a crowd's tasks need no common windows any more.
COMMON = 1024
#: Values of the bytes of a token's hash in an interval.
BYTES = np.array([1, 1 << 8, 1 << 16], np.uint32)
#: A near passage shares a run of twice so many tokens at the same distance from the centre.
STEP = 6


def _valued(h: np.ndarray, f) -> np.ndarray:
    """The order of tokens under function ``f``."""
    return mix(h ^ (U64(0x9E37) * np.asarray(f + 1).astype(U64))) | U64(1 << 63)


def compact_windows(texts: list[bytes], width: int, k: int, extents: bool = True) -> tuple[np.ndarray, ...]:
    """(index of text, function, signature, left, centre, right) of every compact window of at least ``width`` shingles; without ``extents`` left and right are the centre."""
    h, doc, _ = shingles(texts, k)
    count = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(count + 1) - count  # one empty place before each text, smaller than all hashes
    place = np.arange(len(h)) + doc + 1
    n = len(h) + len(texts) + 1
    parts: list[tuple[np.ndarray, ...]] = []
    longest = int(count.max(initial=0))
    if longest < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, np.int64, np.int64, np.int64))
    level = width.bit_length() - 1
    for f in range(FUNCTIONS):
        v = np.zeros(n, U64)
        v[place] = _valued(h, f)
        key = (v & ~PLACE) | np.arange(n, dtype=U64)
        tables = [key]  # minima of runs of 1, 2, 4 ... places
        while len(tables) <= level or extents and (1 << len(tables)) <= longest + 1:
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][: len(tables[-1]) - half], tables[-1][half:]))
        low = np.minimum(tables[level][: n - width + 1], tables[level][width - (1 << level) : width - (1 << level) + n - width + 1])
        centre = (low[low >= U64(1 << 63)] & PLACE).astype(np.int64)  # they never fall from one place to the next
        centre = centre[np.concatenate(([True], centre[1:] != centre[:-1]))[: len(centre)]]
        own = key[centre]
        right, left = centre + 1, centre - 1
        for j in range(len(tables) - 1, -1, -1) if extents else ():
            t, step = tables[j], 1 << j
            ok = right + step <= n
            ok &= t[np.where(ok, right, 0)] > own
            right = right + step * ok
            ok = left - step + 1 >= 0
            ok &= t[np.where(ok, left - step + 1, 0)] > own
            left = left - step * ok
        of = np.searchsorted(starts, centre, side="right") - 1
        base = starts[of]
        parts.append((of, np.full(len(of), f), (v[centre] & ~U64(7)) | U64(f), left + 1 - base, centre - base, right - 1 - base))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


WINDOWS = "key long, doc long, at int"


def windows(texts: DataFrame, words: int = 50, k: int = 5) -> DataFrame:
    """(key, doc, at) of (doc_id, tid, text): signature, text and centre of every compact window; a task signs equal texts once.

    The last three bits of a key name the function. Texts of enough words also have a row whose key
    names the whole text (last bits 7), with the document and the number of words.
    """
    width = words - k + 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size: dict[int, int] = {}
        for b in portions(batches, "text"):
            ids, tids = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = [i for i, t in enumerate(tids.tolist()) if t not in size and size.setdefault(t, 0) == 0]
            bodies = [t.encode() for t in b.column(2).take(pa.array(new, pa.int64())).to_pylist()]
            for i, j in chunks(bodies):
                of, _, signature, _, centre, _ = compact_windows(bodies[i:j], width, k, extents=False)
                n = shingles(bodies[i:j], k)[2]
                size.update(zip(tids[new[i:j]].tolist(), n.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(tids[new[i:j]][of]), pa.array(centre.astype(np.int32))], names=["key", "doc", "at"])
            n = np.array([size[t] for t in tids.tolist()], np.int32)
            whole = n >= words
            yield pa.RecordBatch.from_arrays([pa.array(tids[whole] | 7), pa.array(ids[whole]), pa.array(n[whole])], names=["key", "doc", "at"])

    return map_batches(texts.select("doc_id", "tid", "text"), sign, WINDOWS)


def shared(signed: DataFrame) -> DataFrame:
    """The rows (key, doc, at) whose key has more than one doc, and whether it has over ``2 * CROWD`` rows (``crowd``). A task holds up to that many rows of the key that a batch cuts, and one doc's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)], None  # the last key's rows, and that key once it is known to be a crowd

        def cut(rows: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
            nonlocal held, open_key
            key, doc, at = rows
            if not len(key):
                return None
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))
            key, doc, at = key[new], doc[new], at[new]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            several = doc[start] != doc[start + size - 1]
            several[0] |= key[0] == open_key
            crowd = several & (size > 2 * CROWD)
            crowd[0] |= key[0] == open_key
            open_key = key[-1] if crowd[-1] else None
            n = len(key) if last or crowd[-1] else int(start[-1])
            held = [x[n:] for x in (key, doc, at)]
            keep = np.repeat(several, size)[:n]
            return pa.RecordBatch.from_arrays([pa.array(x[:n][keep]) for x in (key, doc, at, np.repeat(crowd, size))], names=["key", "doc", "at", "crowd"])

        for b in batches:
            out = cut([np.concatenate(x) for x in zip(held, (c.to_numpy() for c in b.columns), strict=True)], False)
            if out is not None:
                yield out
        out = cut(held, True)
        if out is not None:
            yield out

    return map_batches(signed.repartition("key").sortWithinPartitions("key", "doc", "at"), run, f"{WINDOWS}, crowd boolean")


INTERVALS = "key long, task int, doc long, at int, low int, tokens binary"


def intervals(marked: DataFrame, words: int, k: int) -> DataFrame:
    """The interval of every marked window of (doc, text, marks): from ``low``, counted from the centre, the first 24 bits of each token's hash."""
    reach = words - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            texts = [t.encode() for t in b.column(1).to_pylist()]
            ids = b.column(0).to_numpy()
            for i, j in chunks(texts, 1 << 17):
                h, doc, _ = shingles(texts[i:j], k)
                count = np.bincount(doc, minlength=j - i)
                base = np.cumsum(count) - count
                lists = b.column(2).slice(i, j - i)
                marks = lists.flatten()
                of = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                columns = {f: marks.field(f) for f in ("key", "task", "at")}
                key, at = columns["key"].to_numpy(), columns["at"].to_numpy().astype(np.int64)
                for x in range(0, len(key), 8_000):
                    y = slice(x, x + 8_000)
                    place = at[y, None] + np.arange(-reach, reach + 1)
                    inside = (place >= 0) & (place < count[of[y], None])
                    token = h[np.where(inside, place, 0) + base[of[y], None]]
                    value = _valued(token, (key[y] & 7)[:, None]) >> U64(32)
                    centre = value[:, reach : reach + 1]
                    right = np.logical_and.accumulate(inside[:, reach:] & (value[:, reach:] >= centre), axis=1)
                    left = np.logical_and.accumulate(inside[:, reach - 1 :: -1] & (value[:, reach - 1 :: -1] > centre), axis=1)[:, ::-1]
                    own = np.concatenate((left, right), axis=1)
                    offsets = np.concatenate(([0], np.cumsum(own.sum(axis=1) * 3))).astype(np.int32)
                    body = np.ascontiguousarray((token[own] >> U64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
                    tokens = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
                    low = pa.array(-left.sum(axis=1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([columns["key"][y], columns["task"][y], pa.array(ids[i:j][of[y]]), columns["at"][y], low, tokens], names=["key", "task", "doc", "at", "low", "tokens"])

    return map_batches(marked, run, INTERVALS)


#: kind 0: docs a and b share a passage; 1: words [start, end) of a do (of a crowd: of every holder of the interval b, counted from its centre).
FOUND = "kind int, a long, b long, start int, end int"


def _runs(group: np.ndarray, names: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows ordered by hashed group and name, start of each run of equal ones)."""
    rows = np.flatnonzero(valid)
    name = names[rows] + group[rows]
    order = np.argsort(name)
    name = name[order]
    return rows[order], np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))[: len(name)]


def _by_gap(m: np.ndarray, whole: np.ndarray, group: np.ndarray, owner: np.ndarray, width: int, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, a first row that each matches, window) in groups, hashed, of many rows, without comparing pairs.

    Two windows in which one stretch differs agree in what stands left of it and in what stands right of
    it. So each window is hashed once for every place of a gap of ``width - need`` tokens, or of one
    less, as the other text has it if a word more or less caused it; and once for each way to leave the
    gap's tokens out at both edges.
    """
    n, gap = len(m), width - need
    value = mix(m.astype(U64) + U64(0x51ED270B))
    sums = np.zeros((n, m.shape[1] + 1), U64)
    np.cumsum(value * powers(BASE, m.shape[1]), axis=1, out=sums[:, 1:])
    back = powers(INVERSE, m.shape[1] + 1)
    for s in range(width):
        rows = np.flatnonzero(whole[:, s + width] - whole[:, s] == width)
        if len(rows) < 2:
            continue
        own = sums[rows]
        seed = group[rows]
        twice, who = np.concatenate((rows, rows)), owner[np.concatenate((rows, rows))]
        for a in range(need + gap):
            if a > need:  # differences at both edges
                cut = s + a - need
                names = [(own[:, cut + need] - own[:, cut]) * back[cut] + seed] * 2
            else:
                left = (own[:, s + a] - own[:, s]) * back[s]
                left = left * U64(0xD6E8FEB86659FD93) + seed
                names = [left + (own[:, s + a + g + need - a] - own[:, s + a + g]) * back[s + a + g] for g in (gap, gap - 1)]
            name = np.concatenate(names)
            order = np.argsort(name)
            name = name[order]
            new = np.concatenate(([True], name[1:] != name[:-1]))
            start = np.flatnonzero(new)
            if len(start) == len(name):
                continue
            place = np.cumsum(new) - 1
            other = who[order] != who[order[start]][place]
            several = np.logical_or.reduceat(other, start)[place]
            if several.any():
                p, q = twice[order[several]], twice[order[start]][place[several]]
                keep = p != q
                if keep.any():
                    yield p[keep], q[keep], s


def match(group: np.ndarray, doc: np.ndarray, low: np.ndarray, tokens: list[np.ndarray], width: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Match the intervals of each group.

    Returns linked rows (x, y), which of a row's windows of ``width`` tokens (by start, from
    ``width - 1`` before the centre) were matched with another document. Windows match if ``need`` of
    their tokens agree at the same distance from the centre or one beside it; where many rows share a run, those
    that differ must also stand together, or at the edges. In the end every two rows of a group that
    match are linked, if not to each other, then through others.
    """
    n, span = len(doc), 2 * width - 1
    size = np.array([len(t) for t in tokens], np.int64)
    first = width - 1 + low.astype(np.int64)
    m, held = np.zeros((n, span), np.uint32), np.zeros((n, span), bool)
    at = np.arange(span)
    held[:] = (at >= first[:, None]) & (at < (first + size)[:, None])
    if n:
        m[held] = np.concatenate(tokens)
    sums = np.zeros((n, span + 1), U64)
    np.cumsum(mix(m.astype(U64) ^ mix(at.astype(U64) + U64(99))), axis=1, out=sums[:, 1:])
    whole = np.cumsum(np.concatenate((np.zeros((n, 1), np.int16), held), axis=1), axis=1, dtype=np.int16)
    valid = whole[:, width:] - whole[:, :-width] == width
    name = np.where(valid, mix(sums[:, width:] - sums[:, :-width] + np.arange(width).astype(U64)), U64(0))
    matched, x, y, label = np.zeros((n, width), bool), [], [], np.arange(n)
    hashed = mix(group.astype(U64) + U64(1))
    for s in range(width):  # verbatim: equal hashes of a window
        rows, start = _runs(hashed, name[:, s], valid[:, s])
        if not len(rows):
            continue
        head = np.repeat(rows[start], np.diff(np.append(start, len(rows))))
        several = np.logical_or.reduceat(doc[rows] != doc[head], start)
        shared = np.repeat(several, np.diff(np.append(start, len(rows))))
        matched[rows[shared], s] = True
        new = shared & (label[rows] != label[head])
        if new.any():
            x.append(rows[new])
            y.append(head[new])
            label = contract(label, rows[new], head[new])

    # Near: rows of equal tokens stand as one, and only those that share a run of 2 * STEP tokens are compared.
    _, one, of = np.unique(mix(sums[:, -1] ^ hashed) + first.astype(U64), return_index=True, return_inverse=True)
    alone = np.minimum.reduceat(doc[np.argsort(of, kind="stable")], np.searchsorted(np.sort(of), np.arange(len(one)))) if n else doc
    alone = alone == np.maximum.reduceat(doc[np.argsort(of, kind="stable")], np.searchsorted(np.sort(of), np.arange(len(one)))) if n else alone
    owner = np.where(alone, doc[one], -1 - np.arange(len(one)))  # no document where several have the row

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which windows of the rows i and j match, pair by pair."""
        out = np.zeros((len(j), width), bool)
        for c in range(0, len(j), 2048):
            p, q = i if len(i) == 1 else i[c : c + 2048], j[c : c + 2048]
            mine, theirs, ok = m[p], m[q], held[q]
            same = (theirs == mine) & ok
            same[:, 1:] |= (theirs[:, :-1] == mine[:, 1:]) & ok[:, :-1]
            same[:, :-1] |= (theirs[:, 1:] == mine[:, :-1]) & ok[:, 1:]
            same &= held[p]
            some = np.flatnonzero(same.sum(axis=1) >= need)
            hits = np.cumsum(np.pad(same[some], ((0, 0), (1, 0))), axis=1, dtype=np.int16)
            both = valid[q[some]] & (valid[p] if len(p) == 1 else valid[p[some]])
            out[c + some] = (hits[:, width:] - hits[:, :-width] >= need) & both
        return out

    def link(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Labels after the pairs are linked; of pairs that hang together already nothing is kept."""
        apart = label[i] != label[j]
        if not apart.any():
            return label
        x.append(i[apart])
        y.append(j[apart])
        return contract(label, i[apart], j[apart])

    steps = [(s, *_runs(hashed[one], (sums[one, s + 2 * STEP] - sums[one, s]), whole[one, s + 2 * STEP] - whole[one, s] == 2 * STEP)) for s in range(0, span - 2 * STEP + 1, STEP)]
    pairs, large = [np.zeros(0, np.int64)], []
    for _, rows, start in steps:
        size_of = np.diff(np.append(start, len(rows)))
        run_of = np.repeat(np.arange(len(start)), size_of)
        small = size_of[run_of] <= FEW
        for d in range(1, min(FEW, len(rows))):
            k = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:]))
            if not len(k):
                break
            i, j = np.minimum(rows[k], rows[k + d]), np.maximum(rows[k], rows[k + d])
            ask = (label[one[i]] != label[one[j]]) & (owner[i] != owner[j])
            pairs.append(i[ask] * len(one) + j[ask])
        mixed = np.flatnonzero(size_of > FEW)
        large += [rows[a : a + c] for a, c in zip(start[mixed], size_of[mixed], strict=True) if (label[one[rows[a : a + c]]] != label[one[rows[a]]]).any()]
    i, j = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(one)))
    for c in range(0, len(i), 16384):
        p, q = one[i[c : c + 16384]], one[j[c : c + 16384]]
        hit = near(p, q)
        some = np.flatnonzero(hit.any(axis=1))
        np.logical_or.at(matched, p[some], hit[some])
        np.logical_or.at(matched, q[some], hit[some])
        label = link(p[some], q[some])
    crowded = np.unique(np.concatenate([*large, np.zeros(0, np.int64)]).astype(np.int64))
    rows = one[crowded]
    for p, q, w in _by_gap(m[rows], whole[rows], hashed[rows], owner[crowded], width, need):
        matched[rows[p], w] = matched[rows[q], w] = True
        label = link(rows[p], rows[q])
    if n:
        matched |= matched[one][of]
    cat = lambda v: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64)
    return cat(x), cat(y), matched


def matches(rows: DataFrame, words: int, k: int, threshold: float) -> DataFrame:
    """Links and repeated stretches of words (FOUND)."""
    width = words - k + 1
    need = int(np.ceil(2 * threshold / (1 + threshold) * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["key", "task"]):
            size = np.diff(np.append(starts, len(t)))
            ends = np.cumsum(size)
            a = 0
            while a < len(starts):  # whole groups of some thousand rows together
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 8192, side="right")))
                part = t.slice(int(starts[a]), int(ends[z - 1] - starts[a]))
                group = np.repeat(np.arange(z - a), size[a:z])
                a = z
                doc, at, low = (part.column(c).to_numpy() for c in ("doc", "at", "low"))
                named = part.column("name").to_numpy() if "name" in part.column_names else np.zeros(len(doc), np.int64)
                tokens = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 3) @ BYTES for x in part.column("tokens")]
                x, y, matched = match(group, doc, low, tokens, width, need)
                edge = np.unique(np.stack((np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])), axis=1), axis=0)
                step = np.diff(np.pad(matched, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, s = np.nonzero(step == 1)
                e = np.nonzero(step == -1)[1]
                first = at[r] - (width - 1)
                columns = [
                    np.repeat([0, 1], [len(edge), len(r)]).astype(np.int32),
                    np.concatenate((edge[:, 0], doc[r])),
                    np.concatenate((edge[:, 1], named[r])),
                    np.concatenate((np.zeros(len(edge)), first + s)).astype(np.int32),
                    np.concatenate((np.zeros(len(edge)), first + e - 1 + words)).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["kind", "a", "b", "start", "end"])

    return map_batches((rows.repartition(partitions(rows.sparkSession), "key", "task") if "name" in rows.columns else rows.repartition("key", "task")).sortWithinPartitions("key", "task"), run, FOUND)


def _dealt(once: DataFrame) -> DataFrame:
    """(key, name, doc, at, low, tokens, task): the tasks of each different interval of a crowd. Up to ``2 * CROWD`` of a signature share a task; more are dealt into blocks, any two of which meet."""
    held = once.groupBy("key").agg(F.count("*").alias("held"))
    blocks = F.when(F.col("held") > 2 * CROWD, F.ceil(F.col("held") / CROWD)).otherwise(1).cast("int")
    own, n = F.pmod("name", "n").cast("int"), F.col("n")
    others = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j != own), lambda j: F.least(own, j) * n + F.greatest(own, j))
    tasks = F.when(n == 1, F.array(F.lit(0))).otherwise(others)
    return once.join(held.select("key", blocks.alias("n")), "key").select(*once.columns, F.explode(tasks).alias("task"))


def _stretch(start: Column, end: Column) -> Column:
    """Words [start, end) as one number, which sorts alike: Spark hashes sets of numbers, but compares structs pair by pair."""
    return F.shiftleft(start.cast("long"), 32) + end


def _told(each: DataFrame, words: int, k: int, threshold: float) -> DataFrame:
    """(a, b, stretches) of the intervals (key, doc, at, low, tokens, name) of crowds: links from doc a to b, if not null, and repeated stretches of a, as ``_stretch`` has them.

    Equal intervals, of the same ``name``, stand as one in the comparison; where several documents hold
    one, it has no document of its own, and they are linked to its name. A text has one row for each
    interval it holds, at however many places.
    """
    least, most = F.min("doc"), F.max("doc")
    once = each.groupBy("key", "name").agg((least < most).alias("several"), F.when(least == most, least).otherwise(F.col("name")).alias("doc"), F.lit(0).alias("at"), F.first("low").alias("low"), F.first("tokens").alias("tokens"))
    once = settle(once)
    met = settle(matches(_dealt(once.drop("several")), words, k, threshold))
    near = met.where("kind = 1").groupBy(F.col("b").alias("name")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    whole = F.array(F.struct(F.col("low").alias("start"), (F.col("low") + F.octet_length("tokens") / 3 + k - 1).cast("int").alias("end")))
    known = once.join(near, "name", "left").select("name", "several", F.when(F.col("several"), whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    holders = each.groupBy("doc", "name").agg(F.collect_set("at").alias("ats"))  # a text may hold an interval at many places
    stretches = F.flatten(F.transform("ats", lambda at: F.transform("spans", lambda x: _stretch(at + x["start"], at + x["end"]))))
    told = holders.join(known, "name").select(F.col("doc").alias("a"), F.when(F.col("several"), F.col("name")).alias("b"), F.array_distinct(stretches).alias("stretches"))
    return met.where("kind = 0").select("a", "b", F.expr("cast(array() as array<bigint>)").alias("stretches")).union(told)


def _crowded(each: DataFrame, words: int, k: int, threshold: float) -> DataFrame:
    """What ``_told`` gives, as FOUND: a row for each link and each different stretch. To look at small groups; the operator keeps the lists."""
    told = _told(each, words, k, threshold)
    links = told.where("b is not null").select(F.lit(0).alias("kind"), "a", "b", F.lit(0).alias("start"), F.lit(0).alias("end")).distinct()
    spans = told.select("a", F.explode("stretches").alias("x")).distinct()
    return links.union(spans.select(F.lit(1), "a", F.lit(0).cast("long"), *_ends(F.col("x"))))


def _ends(stretch: Column) -> tuple[Column, Column]:
    """Start and end of what ``_stretch`` made."""
    return F.shiftright(stretch, 32).cast("int").alias("start"), stretch.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")


def _only(texts: DataFrame, holders: DataFrame, broadcast: int = 500_000) -> DataFrame:
    """The texts of the holders: before any shuffle where those were counted to be at most ``broadcast`` rows of two numbers, else by the join that follows."""
    return texts.join(F.broadcast(holders), ["doc_id", "tid"], "left_semi") if holders.count() <= broadcast else texts


def substring_duplicates(docs: DataFrame, words: int = 50, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, spans (start and end of repeated stretches, in words).

    Two documents are linked if passages of at least ``words`` words have the threshold's similarity,
    counted by shingles that agree in place, after at most one word more or less on either side of
    the common shingle. ``class_id``: smallest doc_id that links lead to; ``n_links``: other
    documents of that class. Verbatim passages are always found; near ones if one of ``FUNCTIONS``
    hashes agrees. In signatures with over ``2 * CROWD`` windows equal intervals stand as one, and any
    two that differ meet in a task, so the cost grows with the square of the different ones.

    A document without repeated passages is its own class. Exact copies of enough words are linked;
    null texts and shorter ones have no passages. Repeated rows count once and are all returned; a
    doc_id that stands for several texts is linked by each of them; rows with a null doc_id take no
    part and have a null class. Empty tables give no rows; other columns are not read.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    texts = every.where("doc_id is not null and text is not null")
    ids = settle(texts.select("doc_id", "tid").distinct())
    first = ids.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    rows, rows_path = store(shared(windows(texts, words, k)), "windows")
    whole = F.col("key").bitwiseAND(F.lit(7)) == 7
    marks = rows.where(~whole).select("key", F.lit(-1).alias("task"), "doc", "at", "crowd")
    paths = [rows_path]

    def intervals_of(part: DataFrame) -> DataFrame:
        holders = settle(part.select(F.col("doc").alias("tid")).distinct().join(first, "tid"))
        lists = part.groupBy(F.col("doc").alias("tid")).agg(F.collect_list(F.struct("key", "task", "at")).alias("marks")).join(holders, "tid")
        held = _only(texts, holders).join(lists, ["doc_id", "tid"]).dropDuplicates(["tid"]).select("tid", "text", "marks")
        return intervals(held, words, k)

    def keep(part: DataFrame, name: str) -> DataFrame:
        kept, path = store(part, name)
        paths.append(path)
        return kept

    found = keep(matches(intervals_of(marks.where("not crowd")), words, k, threshold), "passages")
    links = found.where("kind = 0").select("a", "b")
    copied = ids.join(rows.where(whole).select(F.col("key").alias("name"), F.col("doc").alias("doc_id"), F.col("at").alias("n")), "doc_id").where(F.col("tid").bitwiseOR(F.lit(7)) == F.col("name"))
    copies = copied.groupBy("tid").agg(F.max("n").alias("n"), F.count("*").alias("held")).where("held > 1")
    none = F.lit(None).cast("array<long>")
    spans = found.where("kind = 1").select(F.col("a").alias("tid"), _stretch(F.col("start"), F.col("end")).alias("one"), none.alias("many"))
    spans = spans.union(copies.select("tid", F.col("n").cast("long"), none))
    if not marks.where("crowd").isEmpty():
        each = keep(intervals_of(marks.where("crowd")).drop("task").withColumn("name", F.xxhash64("key", "low", "tokens")), "crowds")
        told = keep(_told(each, words, k, threshold), "told")
        links = links.union(told.where("b is not null").select("a", "b"))
        spans = spans.union(told.where("size(stretches) > 0").select("a", F.lit(None).cast("long"), "stretches"))
    spans = spans.groupBy("tid").agg(F.sort_array(F.array_distinct(F.concat(F.collect_set("one"), F.flatten(F.collect_list("many"))))).alias("spans"))
    linked = components(links)
    named = spans.join(linked, F.col("tid") == F.col("node"), "left").select("tid", F.coalesce("component", "tid").alias("component"), "spans")
    member = settle(ids.join(named, "tid"))
    for path in paths:
        remove_folder(docs.sparkSession, path)
    classes = member.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("held"))
    known = member.join(classes, "component").select("doc_id", "tid", "class_id", (F.col("held") - 1).alias("n_links"), F.transform("spans", lambda x: F.struct(*_ends(x))).alias("spans"))
    return every.select("doc_id", "tid").join(known, ["doc_id", "tid"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")
    )


def covered_words(spans):
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])
