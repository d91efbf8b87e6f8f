"""Vectorised word and byte hashing over Arrow batches (numpy, inside Spark tasks).

Texts of a batch are laid out in one byte buffer with a zero byte after each, so one pass of numpy
calls serves many documents.  A word is a maximal run of ASCII letters and digits and of bytes from
0x80 up, after A-Z is lower-cased, which equals ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; a bijection on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def ranges(sizes: list[int], limit: int, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive entries, ``most`` at most, of about ``limit`` together; a larger one stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start == most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def portions(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of a text column: Spark's may hold 64 MB, and Python's strings take several times their bytes."""
    for b in batches:
        sizes = [n or 0 for n in pc.binary_length(b.column(b.schema.get_field_index(column))).to_pylist()]
        for i, j in ranges(sizes, limit):
            yield b.slice(i, j - i)


def chunks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts, 65,536 at most, of about ``limit`` bytes together; a longer text stands alone."""
    return ranges([len(t) + 1 for t in texts], limit)


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a zero after each, start of each text)."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return data, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text in order, index of its text)."""
    data, starts = buffer_of(texts)
    low = _LOWER[data]
    edge = np.diff(np.concatenate(([False], _IS_WORD[low])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    sums = np.concatenate(([U64(0)], np.cumsum((low.astype(U64) + U64(1)) * powers(BASE, len(low)))))
    h = mix((sums[end] - sums[begin]) * powers(INVERSE, len(low))[begin])
    return h, np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingle hashes of each text, one after another; offsets, one more than texts).

    At most 65,536 texts at once.  A text of fewer than ``k`` words, but not none, has one shingle of
    all its words.
    """
    h, doc, _ = shingles(texts, k)
    keys = (doc.astype(U64) << U64(48)) | (h >> U64(16))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    count = np.bincount((keys >> U64(48)).astype(np.int64), minlength=len(texts))
    return keys & U64((1 << 48) - 1), np.concatenate(([0], np.cumsum(count)))


def shingles(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle in order, index of its text, number of words of each text)."""
    words, of = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts))
    p = powers(BASE, k)
    h = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k if len(h) else 0):
        h += words[i : len(words) - k + 1 + i] * p[i]
    whole = of[: len(h)] == of[k - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = mix(h[whole]), of[: len(h)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(n)))
        extra = np.array([(words[at[i] : at[i + 1]] * p[: n[i]]).sum(dtype=U64) + U64(n[i]) for i in short], dtype=U64)
        h, doc = np.concatenate((h, mix(extra))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc, n
