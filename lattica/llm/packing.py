"""Bounded-space online packing of token lists into windows of a fixed capacity.

Each partition keeps a fixed number of open windows.  A document is placed where it fits best; if it
fits nowhere, the fullest window is emitted, topped up first by a cut of the document where its gap
is large.  What stays open at a partition's end is merged: the pieces of a few dozen partitions are
placed anew by best fit in decreasing order.  Memory per task, whatever the input's size: one Arrow
batch, the open windows, the ids of about four megabytes of text or of one longer text, the remembered
words (500,000 of at most 32 letters, some 100 MB) and in the merge ``open_windows * merge_width`` windows.
"""

from __future__ import annotations

import bisect
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm.common import map_batches, settle
from lattica.llm.rolling import portions

#: Words whose ids a task remembers, and their greatest length in letters: at most some 300 bytes each. Past that it forgets
#: those that it has not met among the last half of them.
REMEMBER, LONG = 500_000, 32
#: Bytes of text that are tokenized together, beyond one text.
TOGETHER = 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple[Tokenizer, np.ndarray, list[dict[str, bytes]]]:
    """The tokenizer, which ids end a piece, and the words met of late and before that."""
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, ends, [{}, {}]


def _pieces(word: str) -> int:
    """How many pieces the tokenizer cuts a plain word into: 1 for letters or marks, 2 for letters with marks after them; 0 for all that is not plainly that."""
    letters = word.rstrip(MARKS)
    if not letters:
        return int(word != "")
    return (1 + (len(letters) < len(word))) * (letters.isalpha() and max(letters) < PLAIN)


#: Up to here letters keep their number and stay letters when they are lower-cased and composed.
PLAIN = "\u0130"
#: ASCII marks, of which the tokenizer keeps each run together.
MARKS = string.punctuation


def _learn(words: list[str], tokenizer: Tokenizer, ends: np.ndarray, known: dict[str, bytes]) -> None:
    """Add the ids of ``words`` to ``known``. Plain words are encoded together and cut where ids end their pieces; all others go to the tokenizer whole."""
    counts = [_pieces(w) for w in words]
    plain, expected = [w for w, n in zip(words, counts, strict=True) if n], np.array([n for n in counts if n], np.int64)
    rest = [w for w, n in zip(words, counts, strict=True) if not n]
    groups = [" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)]
    for i, e in zip(range(0, len(plain), 256), tokenizer.encode_batch_fast(groups, add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        cut, last = np.flatnonzero(ends[ids]) + 1, np.cumsum(expected[i : i + 256])
        if len(cut) != last[-1]:
            rest += plain[i : i + 256]
            continue
        body, at = ids.tobytes(), 0
        for w, to in zip(plain[i : i + 256], (4 * cut[last - 1]).tolist(), strict=True):
            known[w] = body[at:to]
            at = to
    for i in range(0, len(rest), 256):
        for w, e in zip(rest[i : i + 256], tokenizer.encode_batch_fast(rest[i : i + 256], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()


#: A comma or full stop that was set apart from what is no letter or digit; the tokenizer keeps marks that touch together.
TORN = re.compile(r"[\W_] [,.] ")


def _spread(text: str) -> str:
    """The text, with blanks for line ends; where its ids stay the same, in lower case and with commas and full stops apart from the words before them, so that fewer different words are met.

    That is so in Latin-1, whose letters are lower-cased one by one and are composed already, if each
    such mark follows a letter or digit and no special token stands there, which knows its case.
    """
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    apart = text.lower().replace(", ", " , ").replace(". ", " . ")
    return text if "<|" in text or TORN.search(apart) else apart


def tokenize(texts: list[str], path: str, end: int) -> list[np.ndarray]:
    """Ids of each text, then ``end``.

    The tokenizer never joins across white space, so each blank-separated word is encoded once and
    remembered, unless it is long; a text's ids are those of its words, one after another.
    """
    tokenizer, ends, memory = _tokenizer(path)
    known, before = memory
    split = pc.split_pattern(pa.array([_spread(t) for t in texts], pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(known) + len(words) > REMEMBER // 2:
        before, known = memory[:] = known, {}
    here, new = {}, []
    for w in words:
        if (ids := known.get(w) or before.get(w)) is None:
            new.append(w)
        else:
            here[w] = ids
    _learn(new, tokenizer, ends, here)
    known.update(here)
    for w in new:
        if len(w) > LONG:
            del known[w]
    bodies = [here[w] for w in words]
    held = np.frombuffer(b"".join(bodies), "<u4")
    size = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
    first, code = np.cumsum(size) - size, coded.indices.to_numpy()
    n = size[code]
    upto = np.concatenate(([0], np.cumsum(n)))
    bound = upto[split.offsets.to_numpy()]
    ids = held[np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], n)]
    last = np.array([end], "<u4")
    return [np.concatenate((ids[i:j], last)) for i, j in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def forget(path: str) -> None:
    """Drop what this worker remembers, which outlives its task."""
    _tokenizer(path)[2][:] = {}, {}


class OpenWindows:
    """The open windows of one partition: ``rows`` of emitted ones gather in ``out``."""

    def __init__(self, capacity: int, most: int, slack: int, first_id: int):
        self.capacity, self.most, self.slack, self.next_id = capacity, most, slack, first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def put(self, window: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.pieces[window].append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total))

    def emit(self, window: int) -> None:
        offset = 0
        for piece in self.pieces.pop(window):
            self.out.append((*piece, window, offset))
            offset += piece[2]

    def open(self) -> int:
        self.next_id += 1
        self.pieces[self.next_id - 1] = []
        return self.next_id - 1

    def add(self, doc, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            left = total - start
            if left >= self.capacity:  # full windows of one document
                self.put(w := self.open(), doc, start, ids[start : start + self.capacity], total)
                self.emit(w)
                start += self.capacity
                continue
            i = bisect.bisect_left(self.free, (left, -1))
            if i < len(self.free):  # best fit
                room, w = self.free.pop(i)
                self.put(w, doc, start, ids[start:], total)
                start = total
            elif len(self.free) < self.most:
                room, w = self.capacity, self.open()
                self.put(w, doc, start, ids[start:], total)
                start = total
            else:  # the fullest goes, topped up if its gap is large
                room, w = self.free.pop(0)
                if room > self.slack:
                    self.put(w, doc, start, ids[start : start + room], total)
                    start += room
                self.emit(w)
                continue
            if room > left:
                bisect.insort(self.free, (room - left, w))
            else:
                self.emit(w)

    def rest(self) -> list[tuple]:
        """Pieces of the windows that are still open."""
        left, self.out = self.out, []
        for w in list(self.pieces):
            self.emit(w)
        rows, self.out = self.out, left
        return rows


def merge_pieces(frame: pd.DataFrame, capacity: int, first_id: int) -> pd.DataFrame:
    """Place pieces anew, whole, by best fit in decreasing order; ties go by document and start."""
    frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="last")
    free: list[tuple[int, int]] = []
    where, offset, used = [], [], 0
    for n in frame["length"]:
        i = bisect.bisect_left(free, (n, -1))
        room, w = free.pop(i) if i < len(free) else (capacity, used)
        used = max(used, w + 1)
        where.append(first_id + w)
        offset.append(capacity - room)
        if room > n:
            bisect.insort(free, (room - n, w))
    return frame.assign(sequence_id=where, offset=offset)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2, open_windows: int = 16, slack: int = 64, merge_width: int = 16) -> DataFrame:
    """Pack the ids of every document into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null text
    counts as empty and still has its ``end`` id.  Repeated rows are packed each for itself; rows with
    a null doc_id keep it; an empty table gives no rows; other columns are not read.  ``tokenizer`` is
    a path that every executor has.  Sequence ids are unique but not gapless.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows = OpenWindows(capacity, open_windows, slack, part << 40)

        def rows(pieces: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([part if is_open else -1] * len(pieces), pa.int32())], names=NAMES)

        for b in portions(batches, "text", TOGETHER):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, tokens in zip(ids, tokenize([t or "" for t in texts], tokenizer, end), strict=True):
                windows.add(doc, tokens)
            if len(windows.out) > 4096:
                yield rows(windows.out, False)
                windows.out = []
        yield rows(windows.out, False)
        forget(tokenizer)
        yield rows(windows.rest(), True)

    def merge(pieces: pa.Table) -> pa.Table:
        frame = pieces.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        first = (1 << 62) + (int(frame["merged_by"].iloc[0]) << 32)
        return pa.Table.from_pandas(merge_pieces(frame, capacity, first)[NAMES[:7]], preserve_index=False, schema=pa.schema([(n, pa.int64()) for n in NAMES[:7]]))

    placed = settle(map_batches(docs.select("doc_id", "text"), place, PIECES + ", part int"))
    closed = placed.where("part < 0").drop("part")
    left = placed.where("part >= 0").withColumn("merged_by", F.floor(F.col("part") / merge_width))
    return closed.unionByName(left.groupBy("merged_by").applyInArrow(merge, PIECES))
