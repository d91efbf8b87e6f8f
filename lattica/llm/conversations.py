"""Least-cost repair of conversations by layers of grammar states.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Edits keep, re-role, delete or
insert turns at a cost each. For every turn, counted from the end, one integer holds the layers: for
each cost from the turn's least one upwards the bitset of the grammar states from which the rest of the
conversation can be accepted at just that cost. The first layer with the start state gives the cost;
following the bits from the first turn on, always by the edit whose initial comes first, gives the least audit.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, partitions

# Grammar states, as bits of a layer: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: What is left to pay differs by at most 7 between states: any state but the start follows another's edits after at most an insertion and a deletion. So nine layers hold every least cost.
LAYERS = 9
BAND = (1 << 4 * LAYERS) - 1
_EVERY = sum(1 << 4 * d for d in range(LAYERS))
_AT = {s: _EVERY * s for s in STATES}
#: The state after a role's turn, from each state that allows the turn.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Conversations are repaired in blocks of so many rows; the blocks are joined at the states between them.
BLOCK = 4096


def _before(layers: int, initial: str) -> int:
    """The states from which a turn of this role leads into ``layers``, layer by layer."""
    if initial == "s":
        return (layers & _AT[SYSTEM]) >> 1
    if initial == "a":
        return (layers & _AT[ASSISTANT]) >> 1
    if initial == "u":
        into = layers & _AT[USER]
        return into >> 2 | into >> 1 | into << 1
    return 0


def _inserted(layers: int) -> int:
    """``layers`` with what insertions reach."""
    while True:
        more = (layers | (_before(layers, "u") | _before(layers, "a")) << 4 * INSERT) & BAND
        if more == layers:
            return layers
        layers = more


def _normal(layers: int) -> tuple[int, int]:
    """(layers from the least cost on, that cost)."""
    least = ((layers & -layers).bit_length() - 1) // 4
    return layers >> 4 * least, least


def least_repairs(turns: str, goals: int) -> dict[int, tuple[int, str, str]]:
    """From each state that can reach one of the goal states: (cost, audit, the initial that each edit gives, ``-`` for a deletion).

    ``turns`` has two characters a row: the role's initial (``-`` for others) and its fault (``d`` must go, ``t`` cut off, ``.`` none).
    """
    n = len(turns) // 2
    layers, least = [0] * (n + 1), [0] * (n + 1)
    layers[n] = _inserted(goals)
    for i in range(n - 1, -1, -1):
        after, initial, fault = layers[i + 1], turns[2 * i], turns[2 * i + 1]
        reach = after << 4 * DELETE
        if fault != "d":
            more = CUT_OFF if fault == "t" else 0
            reach |= _before(after, initial) << 4 * (KEEP + more) | (_before(after, "u") | _before(after, "a")) << 4 * (REROLE + more)
        layers[i], up = _normal(reach & ((1 << 4 * (LAYERS + DELETE + CUT_OFF)) - 1))
        layers[i] = _inserted(layers[i] & BAND)
        least[i] = least[i + 1] + up
    has = lambda i, state, cost: 0 <= cost - least[i] < LAYERS and bool(layers[i] >> 4 * (cost - least[i]) & state)
    found = {}
    for state in STATES:
        cost = next((least[0] + d for d in range(LAYERS) if layers[0] >> 4 * d & state), None)
        if cost is not None:
            found[state] = (cost, *_trace(turns, has, state, cost, goals))
    return found


#: Repairs of short conversations, which often have the same roles and faults.
_remembered = functools.lru_cache(maxsize=20_000)(least_repairs)


def _trace(turns: str, has: Callable[[int, int, int], bool], state: int, cost: int, goals: int) -> tuple[str, str]:
    """The bits from the first turn on: at each step the edit that comes first in ASCII and from which the goal is still met at this cost."""
    i, n, audit, roles = 0, len(turns) // 2, [], []
    while i < n or cost or not state & goals:
        steps = []
        if i < n:
            initial, fault = turns[2 * i], turns[2 * i + 1]
            steps.append(("D", "-", i + 1, state, cost - DELETE))
        steps += [("I", r, i, NEXT[r][state], cost - INSERT) for r in "ua" if state in NEXT[r]]
        if i < n and fault != "d":
            more = CUT_OFF if fault == "t" else 0
            steps += [("K", initial, i + 1, NEXT[initial][state], cost - KEEP - more)] if state in NEXT.get(initial, ()) else []
            steps += [("R", r, i + 1, NEXT[r][state], cost - REROLE - more) for r in "ua" if state in NEXT[r]]
        letter, role, i, state, cost = next(s for s in steps if has(s[2], s[3], s[4]))
        audit.append(letter)
        roles.append(role)
    return "".join(audit), "".join(roles)


NAMED = {"u": b"user", "a": b"assistant"}


class Repair:
    """One conversation, block by block: for each grammar state the cheapest audit that ends there, and the hash of its text so far."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, str, hashlib._Hash]] = {START: (0, "", hashlib.sha256())}
        self.rows: list[tuple[str, bytes, bytes]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last: str | None = None
        self.turns: tuple[int, int, int] | None = None  # least, greatest, distinct
        self.before: tuple | None = None

    def add(self, turn: int | None, fault: str, role: bytes, text: bytes) -> None:
        if fault in ("", "truncated") and (turn, role, text) == self.before:
            fault = "duplicate"
        self.before = (turn, role, text)
        initial = role[:1].decode("latin-1")
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 0)
            self.turns = (low, turn, n + (not n or turn != high))
        code = {"": ".", "truncated": "t"}.get(fault, "d")
        self.rows.append(((initial if initial in NEXT else "-") + code, role, text))
        if len(self.rows) == BLOCK:
            self._close(STATES)

    def _close(self, goals: tuple[int, ...]) -> None:
        """Repair the rows held, from every state that is reached to every goal state."""
        turns, new = "".join(x[0] for x in self.rows), {}
        for goal in goals:
            repairs = (_remembered if len(turns) <= 64 else least_repairs)(turns, goal)
            ways = [(cost + repairs[s][0], audit + repairs[s][1], repairs[s][2], s) for s, (cost, audit, _) in self.ways.items() if s in repairs]
            if ways:
                cost, audit, roles, came = min(ways)
                hashed, first = self.ways[came][2].copy(), not set("KRI") & set(self.ways[came][1])
                rows, added = iter(self.rows), audit[len(self.ways[came][1]) :]
                for letter, given in zip(added, roles, strict=True):
                    _, role, text = ("", b"", b"") if letter == "I" else next(rows)
                    if letter != "D":
                        hashed.update((b"" if first else b"\n") + (role if letter == "K" else NAMED[given]) + b":" + text)
                        first = False
                new[goal] = (cost, audit, hashed)
        self.ways, self.rows = new, []

    def result(self) -> tuple:
        self._close((START | ASSISTANT,))
        ((cost, audit, hashed),) = self.ways.values()
        low, high, distinct = self.turns or (0, -1, 0)
        return (high - low + 1 - distinct, *self.counts.values(), cost, audit, hashed.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with deliberate faults, by the crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its end marks, 3 repeats it, 4 makes it the user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(filled("role"))
    times = F.when(F.col("lot") == 0, F.array()).when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", lot.alias("lot")).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Each row's fault as far as it shows without the row before: blank, duplicate (role and text stand at an earlier turn of the conversation), truncated, or an empty string.

    The first turn of each role and text is a partial aggregation over digests, and the join on them is one that adaptive execution can split, so a very long conversation is spread over many tasks.
    """
    key, at = ["conv_id", "role", "digest"], F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    marked = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = marked.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select(*(F.col(c).alias(f"{c}_") for c in key), "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("first") < at, "duplicate").when(~ends, "truncated").otherwise("")
    return marked.join(first, same, "left").select("conv_id", "turn", "role", "text", fault.alias("fault"))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def repair(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``known`` (conv_id; by default that of ``rows``): gaps in its turns, faults, cost and audit of the least repair, and the SHA-256 of the repaired text.

    Rows (conv_id, turn, role, text) count by turn, nulls first, and within a turn by role and text, so
    repeated rows stand side by side. Null roles and texts count as one space; rows of a null conv_id are
    one conversation. A conversation without rows has zeros and an empty audit. An empty table gives no
    rows; other columns are not read. A conversation's text streams through one task, as one hash
    covers it; what is held of it is a block of rows and the audit.
    """
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    ordered = (
        faults(filled)
        .select(F.col("conv_id").isNotNull().alias("named"), "conv_id", "turn", "fault", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
        .repartition(partitions(rows.sparkSession), "conv_id")
        .sortWithinPartitions("named", "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        state: Repair | None = None
        done: list[tuple] = []
        id_type: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [id_type[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *(x.split()[0] for x in REPORT.split(", "))])

        for b in batches:
            id_type[:] = [b.column(1).type]
            for _, conv, turn, fault, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, Repair()
                state.add(turn, fault, role, text)
            if len(done) > 1000:
                yield flush()
        if state is not None:
            done.append((current, *state.result()))
        if done:
            yield flush()

    found = map_batches(ordered, run, f"conv_id {kind}, {REPORT}")
    everyone = (rows if known is None else known).select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    names = [x.split()[0] for x in REPORT.split(", ")]
    zero = lambda name, value: F.coalesce(F.col(name), F.lit(value).cast("string" if isinstance(value, str) else "long")).alias(name)
    return everyone.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *(zero(n, v) for n, v in zip(names, NONE, strict=True)))

