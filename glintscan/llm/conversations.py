"""Repair of conversations to the grammar ``(s?(ua)+)?`` of role initials, at least cost.

A turn may be kept (free), given the role user or assistant (1) or deleted (2; blank and repeated turns must be), and
empty user and assistant turns may be inserted anywhere (5); a truncated turn that stays costs 5 more. One pass goes
backward over a conversation's turns and keeps the cost to go from each state of the grammar; what the cheapest edits
are from there is noted for every turn and state. A second pass goes forward and takes, of the edits that lie on a
cheapest way, the one with the least initial (Delete, Insert, Keep, Rerole). As each state allows one role only to
an insertion or a new role, the initials tell the repaired conversation.

A conversation's rows go to one task, for a digest of the whole depends on all of them in order. There they are sorted
(on disk, where they don't fit) and streamed, so that memory does not grow with the conversation: what was seen
earlier is told by a window, and of the pass backward only a few bytes stay with each row.

Nulls in role or text are one space; turns come in order, nulls first. Rows of the same turn come in the order of role
and text. A null conversation id is one conversation. Repeated rows are duplicates but for the first. An empty table
gives an empty result, and only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintscan.llm.common import small_batches

#: States of the grammar: nothing yet, after a system turn, a user turn is open, an exchange is complete.
START, SYSTEM, OPEN, DONE = range(4)
#: The one role that each state takes next, and the state that follows; a system turn is taken at the start alone.
_ROLE = ("user", "user", "assistant", "user")
_NEXT = (OPEN, OPEN, DONE, OPEN)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
_NEVER = 1 << 60
#: Costs at the end of a conversation, and the insertions that they stand for.
_END = (0, 2 * INSERT, INSERT, 0)
_WORD = "[^\\x20\\x09-\\x0D]"


def _steps(initial: str, gone: bool, truncated: bool, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn in a state, by initial: (initial, cost, next state)."""
    found = [("D", DELETE, state)]
    if not gone:
        more = TRUNCATED if truncated else 0
        if initial == _ROLE[state][0]:
            found.append(("K", more, _NEXT[state]))
        elif initial == "s" and state == START:
            found.append(("K", more, SYSTEM))
        found.append(("R", REROLE + more, _NEXT[state]))
    return found


def backward(to_go: tuple[int, ...], initial: str, gone: bool, truncated: bool) -> tuple[tuple[int, ...], str]:
    """Cost to go before a turn, from that behind it, and the edits from each state: their initials, the last the turn's own."""
    steps = [_steps(initial, gone, truncated, q) for q in range(4)]
    cost = [min(c + to_go[after] for _, c, after in s) for s in steps]
    for _ in range(3):  # insertions before the turn; three pass through all states
        cost = [min(cost[q], INSERT + cost[_NEXT[q]]) for q in range(4)]

    def walk(q: int) -> str:
        out = ""
        while True:
            tight = [(e, after) for e, c, after in steps[q] if c + to_go[after] == cost[q]]
            if INSERT + cost[_NEXT[q]] == cost[q]:
                tight.append(("I", _NEXT[q]))
            edit, after = min(tight)
            out += edit
            if edit != "I":
                return out
            q = after

    return tuple(cost), ",".join(walk(q) for q in range(4))


def repaired(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str | None, str | None]]]:
    """The state after a turn's edits, and each edit with the turn that it leaves (none: deleted)."""
    out: list[tuple[str, str | None, str | None]] = []
    for e in edits:
        if e == "D":
            out.append((e, None, None))
            continue
        to = _ROLE[state]
        if e == "I":
            out.append((e, to, ""))
        elif e == "R":
            out.append((e, to, text))
        else:
            out.append((e, role, text))
            if role[:1] == "s":
                state = SYSTEM
                continue
        state = _NEXT[state]
    return state, out


def faults(turns: DataFrame) -> DataFrame:
    """Adds the first fault of each turn (null: none) to (_c, _n, _r, _t, _there), rows of a conversation in one partition."""
    seen = Window.partitionBy("_c", "_there", "_r", "_t").orderBy("_n")
    first = F.row_number().over(seen) == 1
    blank = ~F.col("_t").rlike(_WORD)
    cut_off = ~F.regexp_extract("_t", rf"({_WORD})[\x20\x09-\x0D]*\z", 1).rlike("[.!?]")
    fault = F.when(blank, "blank").when(~first, "duplicate").when(cut_off, "truncated")
    return turns.repartition("_c").withColumn("_fault", F.when(F.col("_there"), fault))


_KEPT = "_c string, _n long, _r string, _t string, _there boolean, _fault string, _edits string"


def planned(turns: DataFrame) -> DataFrame:
    """Adds ``_edits``, the cheapest edits of each turn from each state, comma-joined; no exchange."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        at, to_go = (), _END
        for b in batches:
            edits = []
            rows = (b[c].to_pylist() for c in ("_c", "_r", "_there", "_fault"))
            for c, role, there, fault in zip(*rows, strict=True):
                if (c,) != at:
                    at, to_go = (c,), _END
                if not there:
                    edits.append("")
                    continue
                least = min(to_go)
                key = (tuple(x - least for x in to_go), role[:1], fault in ("blank", "duplicate"), fault == "truncated")
                if key not in known:
                    known[key] = backward(*key)
                cost, said = known[key]
                to_go = tuple(x + least for x in cost)
                edits.append(said)
            yield b.append_column("_edits", pa.array(edits, pa.string()))

    given = faults(turns)
    again = F.coalesce(F.col("_fault") == "duplicate", F.lit(False))  # of equal rows the first is none
    last_first = [F.asc("_c"), F.desc_nulls_last("_n"), F.desc("_r"), F.desc("_t"), again.desc()]
    in_order = [F.asc("_c"), F.asc_nulls_first("_n"), F.asc("_r"), F.asc("_t"), again.asc()]
    return given.sortWithinPartitions(*last_first).mapInArrow(of, _KEPT).sortWithinPartitions(*in_order)


def prepared(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The named columns, without nulls in role and text; ``_there`` is false for rows that only name a conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    small_batches(conversations.sparkSession)
    given = conversations.select(F.col(conv_id).cast("string").alias("_c"), F.col(turn).cast("long").alias("_n"), space(role).alias("_r"), space(text).alias("_t"))
    return given.withColumn("_there", F.lit(True))


def damaged(turns: DataFrame) -> DataFrame:
    """``prepared`` turns, damaged by a checksum of their place: dropped, emptied, cut off, repeated or given to the user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(named("_c"), F.lit(":"), named("_n")), "UTF-8")), F.lit(20))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(3), F.lit(3))).otherwise(F.array(kind)))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_t", "[.!?]+", "")).otherwise(F.col("_t"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_r"))
    rows = turns.withColumn("_kind", copies)
    return rows.select("_c", "_n", role.alias("_r"), text.alias("_t"), (F.col("_kind") != 0).alias("_there"))


Made = list[tuple[str, str | None, str | None]]


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, str | None, str | None, Made] | None]:
    """The forward walk: (conversation, turn, role, fault, edits) for each turn and, without turn and role, for each
    conversation's end; nothing after each batch."""
    at: tuple = ()
    state = START

    def end() -> Iterator[tuple]:
        if at:
            yield *at, None, None, None, repaired(state, "I" * (_END[state] // INSERT), "", "")[1]

    for b in batches:
        columns = (b[c].to_pylist() for c in ("_c", "_n", "_r", "_t", "_there", "_fault", "_edits"))
        for c, n, role, text, there, fault, said in zip(*columns, strict=True):
            if (c,) != at:
                yield from end()
                at, state = (c,), START
            if there:
                state, made = repaired(state, said.split(",")[state], role, text)
                yield c, n, role, fault, made
        yield None
    yield from end()
    yield None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [name for name, _ in fields])


_EDITS = "conv_id string, place long, edit string, turn long, role string, text string, fault string"


def edits(turns: DataFrame) -> DataFrame:
    """One row for each edit of ``prepared`` conversations: (conv_id, place, edit, turn, role, text, fault).

    Places number the repaired turns from 0; deleted turns have none. Insertions have neither a turn nor a fault.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at: tuple = ()
        place = 0
        for event in walked(batches):
            if event is None:
                yield _batch(rows, _EDITS)
                rows.clear()
                continue
            c, n, _, fault, made = event
            if (c,) != at:
                at, place = (c,), 0
            for e, role, text in made:
                rows.append((c, None if role is None else place, e, *((None, role, text, None) if e == "I" else (n, role, text, fault))))
                place += role is not None

    return planned(turns).mapInArrow(of, _EDITS)


class Report:
    """What is counted along one conversation, and the digest of its repaired turns."""

    SCHEMA = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    COST = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.digest, self.first = hashlib.sha256(), True

    def turn(self, n: int | None, role: str, fault: str | None) -> None:
        if n is not None:
            self.low = n if self.low is None else self.low
            self.distinct, self.high = self.distinct + (n != self.high), n
        if fault:
            self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]

    def edit(self, e: str, role: str | None, text: str | None, fault: str | None) -> None:
        self.audit.append(e)
        self.cost += self.COST[e] + (TRUNCATED if fault == "truncated" and e in "KR" else 0)
        if role is not None:
            self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

    def row(self, c: str | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (c, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def report(turns: DataFrame) -> DataFrame:
    """Per conversation gaps in its turns, faults, illegal neighbours, cost, the edits' initials and the repaired turns' digest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found = Report()
        for event in walked(batches):
            if event is None:
                yield _batch(rows, Report.SCHEMA)
                rows.clear()
                continue
            c, n, role, fault, made = event
            if role is not None:
                found.turn(n, role, fault)
            for e in made:
                found.edit(*e, fault)
            if role is None:
                rows.append(found.row(c))
                found = Report()

    return planned(turns).mapInArrow(of, Report.SCHEMA)
