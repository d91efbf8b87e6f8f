"""Periodic runs of words: lags counted by Fourier transforms for frequent words and by pair differences for rare ones.

A run of period q and length m makes m - q matches at lag q (equal words q places apart), so a lag
with fewer than ``max(24 - q, 2 q)`` matches in a document has no run. The matches of all lags are
counted exactly, and only lags with enough of them are scanned for islands, that is unbroken
stretches of matches. Documents are independent: no shuffle, memory in proportion to the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches
from lattica.llm.rolling import portions

Run = tuple[int, int, int]  # start, length, period


def _pair_counts(ids: np.ndarray, places: np.ndarray, longest: int) -> np.ndarray:
    """How often equal ids stand q places apart, for q up to ``longest``."""
    counts = np.zeros(longest + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, places = ids[order], places[order]
    end = np.searchsorted(ids, ids, side="right")
    k, step = np.arange(len(ids)), 1
    while len(k):
        k = k[k + step < end[k]]
        apart = places[k + step] - places[k]
        near = apart <= longest  # later partners are farther still
        k = k[near]
        counts += np.bincount(apart[near], minlength=longest + 1)
        step += 1
    return counts


def lag_counts(ids: np.ndarray, longest: int) -> np.ndarray:
    """Matches of every lag up to ``longest``. The transforms' rounding errors are far below one half, so counts are exact."""
    n = len(ids)
    often = np.bincount(ids)
    heavy = np.flatnonzero(often > 2 * (n * max(n, 2).bit_length()) ** 0.5)
    if not len(heavy):
        return _pair_counts(ids, np.arange(n), longest)
    rare = np.flatnonzero(~np.isin(ids, heavy))
    size = 1 << (n + longest).bit_length()
    power = np.zeros(size // 2 + 1)
    for word in heavy:
        spectrum = np.fft.rfft(ids == word, size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64) + _pair_counts(ids[rare], rare, longest)


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of unbroken stretches of at least ``least`` matches at ``lag``.

    Such a stretch holds one of the places least-1, 2 least-1, ... and at least half of ``least`` places
    beside it on one side, so in long texts these are looked at before the whole text is.
    """
    m = len(ids) - lag
    if m > 4096:
        spot, half = np.arange(least - 1, m, least), (least - 1) // 2
        spot = spot[ids[spot] == ids[spot + lag]]
        if not len(spot):
            return []
        before, after = spot, spot
        for d in range(1, min(half, 16) + 1):
            before = before[before >= d]
            before = before[ids[before - d] == ids[before - d + lag]]
            after = after[after + d < m]
            after = after[ids[after + d] == ids[after + d + lag]]
            if not len(before) and not len(after):
                return []
    breaks = np.flatnonzero(ids[lag:] != ids[:-lag])
    edges = np.concatenate(([-1], breaks, [m]))
    lengths = np.diff(edges) - 1
    return [(int(edges[i]) + 1, int(lengths[i])) for i in np.flatnonzero(lengths >= least)]


def periodic_runs(ids: np.ndarray, least: int = 24, repeats: int = 3) -> list[Run]:
    """All runs by start, then period: maximal stretches of smallest period q and at least ``max(least, repeats q)`` words; ``repeats`` is at least 2.

    A stretch that has a period also has its multiples: their islands have the same ends and are
    dropped, and the matches that known runs explain do not make a lag worth a scan.
    """
    longest = len(ids) // repeats
    if len(ids) < least or not longest:
        return []
    counts = lag_counts(ids, longest)
    q = np.arange(longest + 1)
    need = np.maximum(np.maximum(least - q, (repeats - 1) * q), 1)
    explained, runs, ends = np.zeros_like(counts), [], set()
    for lag in np.flatnonzero(counts >= need).tolist():
        if lag == 0 or counts[lag] - explained[lag] < need[lag]:
            continue
        new = [(start, length + lag, lag) for start, length in islands(ids, lag, int(need[lag])) if (start, length + lag) not in ends]
        if new:
            ends.update((start, length) for start, length, _ in new)
            runs += new
            multiples = np.arange(2 * lag, longest + 1, lag)
            # At a multiple of its period a run is an island of its own, so what several runs explain adds up.
            here = sum(np.maximum(length - multiples, 0) for _, length, _ in new)
            explained[multiples] = np.maximum(explained[multiples], here)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def numbered_words(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def with_repetition(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words, of which a tenth of the documents, by the crc32 of the id, are made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, runs_text string, collapsed binary"


def find_runs(docs: DataFrame, repeat: bool = False, least: int = 24, repeats: int = 3) -> DataFrame:
    """One row for each row: doc_id, n_words, runs (by start, then period), best, runs_text (``start,length,period`` lines), collapsed (UTF-8).

    Words are what stands between ASCII blanks. ``repeat`` first makes a tenth of the documents
    periodic (``with_repetition``), as a test bed. A null or empty text, or one of blanks alone, has no
    words and no runs. A null doc_id is left as it is by ``repeat``. Every row is judged alone: repeated
    rows give repeated results. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # of bytes: at space, tab, LF, VT, FF and CR alone
                if repeat:
                    words = with_repetition(words, doc_id)
                runs = periodic_runs(numbered_words(words), least, repeats) if len(words) >= least else []
                named = [{"start": s, "length": m, "period": q} for s, m, q in runs]
                top = strongest(runs)
                rows.append((len(words), named, top and dict(zip(("start", "length", "period"), top, strict=True)), "".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(words, runs)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.list_(run_type), run_type, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "runs", "best", "runs_text", "collapsed"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, {FOUND}")


def run_report(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of ``find_runs``."""
    best = lambda name: F.col(f"best.{name}").alias(name)
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"), exponent,
        F.sha2(F.col("runs_text").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
