"""Conversation structure repair by a run-length dynamic program (operator 12).

A repaired conversation has roles ``(s?(ua)+)?``. Four states tell what came last: nothing, a system
row, a user row, an assistant row. What one row can do from each state is a 4 x 4 min-plus matrix that depends
only on its symbol (role initial and fault), so equal consecutive symbols are one run, and a run is
advanced through the cached binary powers of its matrix. Costs to the end are unrolled
forward into the edits: from a state each edit leads to one state, so taking the least initial among the
cheapest gives the least audit.

Rows are range-sorted by conversation and turn and streamed. A conversation inside one task is done there. One
that touches the task's first or last conversation, or is longer than ``ROWS`` rows, is cut into segments that
carry the product of their matrices: one pass backwards over the segments gives the costs behind each, one pass
forwards the state each is entered with, and the segments are unrolled in parallel. Only the digest of the repaired
text is taken in order, streamed; no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize

ROWS = 4096           # rows of one segment
BYTES = 8 << 20       # characters of one segment, the last row aside
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
NEXT = (2, 2, 3, 2)   # the state an inserted or reroled row leads to
END = (0, 6, 3, 0)    # inserts that complete a conversation
NAME = {2: "user", 3: "assistant"}
ROLES = "sua"         # role initials with a place; others have none
MUST, OK, CUT = 0, 1, 2  # blank or duplicate; no fault; truncated
BLANK = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"


def symbol(initial: str, fault: int) -> int:
    """Number of a (role, fault) pair; a row that must go has the same whatever its role."""
    return 0 if fault == MUST else 1 + 2 * (ROLES.find(initial) if initial else -1) + (2 if fault == OK else 3)


def _keep(sym: int, state: int) -> int | None:
    """The state a kept row leads to, or None."""
    role = (sym - 3) // 2 if sym else -1
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


def _edits(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done with the next row."""
    yield "D", DELETE, state
    if sym:
        more = TRUNCATED if (sym - 1) % 2 else 0
        to = _keep(sym, state)
        if to is not None:
            yield "K", KEEP + more, to
        yield "R", REROLE + more, NEXT[state]


class Machine:
    """The program with its cached matrices, powers and steps; one per task."""

    def __init__(self):
        self.powers: dict[int, list[tuple]] = {}
        self.steps: dict[tuple, tuple] = {}
        self.choices: dict[tuple, tuple] = {}

    @staticmethod
    def times(a: tuple, b: tuple) -> tuple:
        return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))

    def row(self, sym: int) -> tuple:
        """One row: any inserts, then its edit."""
        out = [[FAR] * 4 for _ in range(4)]
        for s in range(4):
            at, cost = s, 0
            for _ in range(4):
                for _, c, to in _edits(sym, at):
                    out[s][to] = min(out[s][to], cost + c)
                at, cost = NEXT[at], cost + INSERT
        return tuple(map(tuple, out))

    def apply(self, sym: int, n: int, v: tuple) -> tuple:
        """Costs in front of a run of ``n`` symbols, from those behind it."""
        p = self.powers.setdefault(sym, [self.row(sym)])
        k = 0
        while n >> k:
            if len(p) == k:
                p.append(self.times(p[-1], p[-1]))
            if n >> k & 1:
                v = tuple(min(p[k][i][j] + v[j] for j in range(4)) for i in range(4))
            k += 1
        return v

    def product(self, runs: list[tuple[int, int]]) -> tuple:
        """The matrix of several runs, column by column."""
        cols = []
        for j in range(4):
            v = tuple(0 if i == j else FAR for i in range(4))
            for sym, n in reversed(runs):
                v = tuple(min(x, FAR) for x in self.apply(sym, n, v))
            cols.append(v)
        return tuple(zip(*cols))

    def step(self, sym: int, v: tuple) -> tuple:
        """``apply`` of one row, remembered up to a constant."""
        low = min(v)
        key = (sym, *(x - low for x in v))
        got = self.steps.get(key)
        if got is None:
            got = self.steps[key] = self.apply(sym, 1, key[1:])
        return tuple(x + low for x in got)

    def choose(self, sym: int, state: int, behind: tuple) -> tuple[str, int]:
        """The edits up to and with the next row, least among the cheapest, and the state after them."""
        low = min(behind)
        key = (sym, state, *(x - low for x in behind))
        got = self.choices.get(key)
        if got is None:
            out, at, v = "", state, key[2:]
            while True:
                front = self.apply(sym, 1, v)
                found = [(e, to) for e, c, to in _edits(sym, at) if c + v[to] == front[at]]
                if INSERT + front[NEXT[at]] == front[at]:
                    found.append(("I", -1))
                e, to = min(found)
                out += e
                if e != "I":
                    break
                at = NEXT[at]
            got = self.choices[key] = (out, to)
        return got

    def unroll(self, rows: list[dict], state: int, v: tuple) -> tuple[str, list[str], int]:
        """(all edits, those of each row that may stay, state behind); ``v`` are the costs behind ``rows``."""
        runs = collapse(rows)
        ends = [v]
        for sym, n in reversed(runs[1:]):
            ends.append(self.apply(sym, n, ends[-1]))
        out, own = [], []
        for (sym, n), behind in zip(runs, reversed(ends)):
            if sym == 0:  # rows that must go commute with inserts, and D comes before I
                out.append("D" * n)
                continue
            inner = [behind]
            for _ in range(n - 1):
                inner.append(self.step(sym, inner[-1]))
            for w in reversed(inner):
                e, state = self.choose(sym, state, w)
                out.append(e)
                own.append(e)
        return "".join(out), own, state


def collapse(rows: list[dict]) -> list[tuple[int, int]]:
    """Runs of equal symbols."""
    runs: list[list[int]] = []
    for r in rows:
        if runs and runs[-1][0] == r["sym"]:
            runs[-1][1] += r["n"]
        else:
            runs.append([r["sym"], r["n"]])
    return [tuple(x) for x in runs]


def lines(rows: list[dict], own: list[str], state: int) -> Iterator[str]:
    """The repaired rows as role, colon, text; ``state`` is the one in front of ``rows``."""
    for r, edits in zip((r for r in rows if r["sym"]), own):
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                state = _keep(r["sym"], state)
                yield f"{r['role']}:{r['text']}"
            else:
                state = NEXT[state]
                yield f"{NAME[state]}:{r['text'] if e == 'R' else ''}"


def completion(state: int) -> tuple[str, list[str]]:
    """Inserts that complete a conversation, and their rows."""
    out = []
    while END[state]:
        state = NEXT[state]
        out.append(NAME[state] + ":")
    return "I" * len(out), out


class Segment:
    """Consecutive rows of one conversation, with what the report needs of them."""

    def __init__(self, conv, number: int, first: bool):
        self.conv, self.number, self.first = conv, number, first
        self.rows: list[dict] = []
        self.size = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "n_turns": 0}
        self.lo = self.hi = self.t_first = self.t_last = self.head = self.tail = None

    def add(self, turn, role: str, text: str, n: int, blank: bool, seen: bool, finished: bool) -> None:
        """``n`` equal rows; ``seen``: their role and text occur in an earlier turn."""
        if not n:  # only says that the conversation exists
            return
        head = role[:1]
        legal = self.tail is None or self.tail + head in ("su", "ua", "au")
        self.count["illegal"] += n - 1 + (not legal)
        self.head = head if self.head is None else self.head
        self.tail = head
        if turn is not None:
            if turn != self.t_last:
                self.count["n_turns"] += 1
            self.t_first = turn if self.t_first is None else self.t_first
            self.t_last = self.hi = turn
            self.lo = turn if self.lo is None else self.lo
        gone = n if blank or seen else n - 1
        if gone < n:
            self.count["truncated"] += not finished
            self.rows.append({"sym": symbol(head, OK if finished else CUT), "n": 1, "role": role, "text": text})
            self.size += len(text)
        if gone:
            self.count["blank" if blank else "duplicate"] += gone
            self.rows.append({"sym": 0, "n": gone, "role": None, "text": None})

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.size >= BYTES

    def record(self, machine: Machine, whole: bool) -> dict:
        out = {"conv_id": self.conv, "sid": self.number, "whole": whole, **self.count, "lo": self.lo, "hi": self.hi,
               "t_first": self.t_first, "t_last": self.t_last, "head": self.head, "tail": self.tail,
               "matrix": None, "rows": None, "cost": None, "audit": None, "repaired_sha256": None}
        runs = collapse(self.rows)
        if not whole:
            out["matrix"] = [x for row in machine.product(runs) for x in row]
            out["rows"] = self.rows
            return out
        v = END
        for sym, n in reversed(runs):
            v = machine.apply(sym, n, v)
        audit, own, state = machine.unroll(self.rows, 0, END)
        more, rest = completion(state)
        text = "\n".join([*lines(self.rows, own, 0), *rest])
        out |= {"cost": v[0], "audit": audit + more, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        return out


_FACTS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, lo bigint, hi bigint, "
          "t_first bigint, t_last bigint, head string, tail string")
_SEGMENT = ("conv_id {kind}, sid bigint, whole boolean, " + _FACTS + ", matrix array<bigint>, "
            "rows array<struct<sym:int,n:bigint,role:string,text:string>>, cost bigint, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage of ``turns`` (conv_id, turn, role, text); adds ``n``: 0 for a dropped row, 2 for a repeated one."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text, c = F.coalesce("role", blank), F.coalesce("text", blank), F.crc32(key) % 20
    return turns.select(
        "conv_id", F.when(c != 0, F.col("turn")).alias("turn"),
        F.when(c == 4, F.lit("user")).when(c != 0, role).alias("role"),
        F.when(c == 1, F.lit("")).when(c == 2, F.regexp_replace(text, "[.!?]", "")).when(c != 0, text).alias("text"),
        F.when(c == 0, 0).when(c == 3, 2).otherwise(1).cast("bigint").alias("n"))


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """Equal rows counted as one, with the turn that first says the same, in order over all tasks."""
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("th", F.md5("text"))
    same = materialize(same, "turns")
    # only what is said in several turns is joined; a hot saying is counted before the shuffle
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = (same.where("n > 0").groupBy("conv_id", "role", "th").agg(F.min(place).alias("first"), F.count("*").alias("m"))
            .where("m > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("th").alias("t"), "first"))
    on = same["conv_id"].eqNullSafe(said["c"]) & (same["role"] == said["r"]) & (same["th"] == said["t"])
    seen = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)) & F.col("first").isNotNull()
    rows = same.join(said, on, "left").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "th", "text", "n", seen.alias("seen"),
        (~F.col("text").rlike(BLANK)).alias("blank"), F.col("text").rlike(FINISHED).alias("finished"))
    order = ["conv_id", "turn", "role", "th"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _rows(df: DataFrame, run: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``run`` from row dictionaries to row dictionaries; what it gives is sent in batches bounded in rows and characters."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in found:
                for at in range(0, b.num_rows, 512):
                    yield from b.slice(at, 512).to_pylist()
        held, size = [], 0
        for r in run(rows()):
            held.append(r)
            size += sum(len(x["text"] or "") for x in r.get("rows") or ()) + len(r.get("text") or "")
            if len(held) >= 512 or size >= BYTES:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)
    return df.mapInArrow(batches, schema)


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    def run(found: Iterator[dict]) -> Iterator[dict]:
        machine = Machine()
        number, one = TaskContext.get().partitionId() << 32, None
        first = True  # the task's first conversation may have begun before
        for r in found:
            if one is None or r["conv_id"] != one.conv:
                if one is not None:
                    yield one.record(machine, whole=not first and one.first)
                    first = False
                    number += 1
                one = Segment(r["conv_id"], number, True)
            elif one.full():
                yield one.record(machine, whole=False)
                number += 1
                one = Segment(r["conv_id"], number, False)
            one.add(r["turn"], r["role"], r["text"], r["n"], r["blank"], r["seen"], r["finished"])
        if one is not None:
            yield one.record(machine, whole=False)
    return _rows(rows, run, _SEGMENT.format(kind=kind))


def _in_order(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _costs_behind(segments: DataFrame) -> DataFrame:
    """``(at, v)``: the costs behind each segment, by one pass from the last to the first."""
    def run(found: Iterator[dict]) -> Iterator[dict]:
        conv, v = (), END
        for r in found:
            if conv == () or r["conv_id"] != conv:
                conv, v = r["conv_id"], END
            yield {"at": r["sid"], "v": list(v)}
            m = r["matrix"]
            v = tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))
    return _rows(_in_order(segments.select("conv_id", "sid", "matrix"), F.desc("sid")), run, "at bigint, v array<bigint>")


def _entries(exits: DataFrame) -> DataFrame:
    """``(to, entry, first)``: the state each segment is entered with, by one pass from the first to the last."""
    def run(found: Iterator[dict]) -> Iterator[dict]:
        conv, state = (), 0
        for r in found:
            first = conv == () or r["conv_id"] != conv
            if first:
                conv, state = r["conv_id"], 0
            yield {"to": r["sid"], "entry": state, "first": first}
            state = r["exits"][state]
    return _rows(_in_order(exits, "sid"), run, "to bigint, entry int, first boolean")


def _across(segments: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that lie in several tasks or segments."""
    behind = segments.join(_costs_behind(segments), F.col("sid") == F.col("at"))

    def leave(found: Iterator[dict]) -> Iterator[dict]:
        machine = Machine()
        for r in found:
            yield {"conv_id": r["conv_id"], "sid": r["sid"],
                   "exits": [machine.unroll(r["syms"], s, tuple(r["v"]))[2] for s in range(4)]}
    syms = F.transform("rows", lambda x: F.struct(x["sym"].alias("sym"), x["n"].alias("n")))
    exits = _rows(behind.select("conv_id", "sid", syms.alias("syms"), "v"), leave, f"conv_id {kind}, sid bigint, exits array<int>")

    entered = behind.join(_entries(exits), F.col("sid") == F.col("to"))
    facts = ["conv_id", "sid", *[x.split()[0] for x in _FACTS.split(", ")]]

    def unroll(found: Iterator[dict]) -> Iterator[dict]:
        machine = Machine()
        for r in found:
            audit, own, state = machine.unroll(r["rows"], r["entry"], tuple(r["v"]))
            text = list(lines(r["rows"], own, r["entry"]))
            cost = min(r["matrix"][4 * r["entry"] + j] + r["v"][j] for j in range(4))
            yield {**{k: r[k] for k in facts}, "first": r["first"], "leaves": state, "cost": cost, "audit": audit,
                   "text": "\n".join(text) if text else None}
    parts = _rows(entered, unroll, f"conv_id {kind}, sid bigint, {_FACTS}, first boolean, leaves int, cost bigint, audit string, text string")

    def finish(found: Iterator[dict]) -> Iterator[dict]:
        one = None
        for r in found:
            if one is None or r["first"]:
                if one is not None:
                    yield one.result()
                one = Whole(r)
            one.add(r)
        if one is not None:
            yield one.result()
    return _rows(_in_order(parts, "sid"), finish,
                 f"conv_id {kind}, {_FACTS}, cost bigint, audit string, repaired_sha256 string")


class Whole:
    """A conversation put together from its segments; the text is only hashed."""

    def __init__(self, r: dict):
        self.out = {**r, **{k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "n_turns")},
                    "lo": None, "hi": None, "t_last": None, "tail": None}
        self.hash, self.written, self.audit, self.state = hashlib.sha256(), False, [], 0

    def _write(self, text: str) -> None:
        self.hash.update((b"\n" if self.written else b"") + text.encode())
        self.written = True

    def add(self, r: dict) -> None:
        o = self.out
        for k in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
            o[k] += r[k]
        if r["head"] is not None and o["tail"] is not None and o["tail"] + r["head"] not in ("su", "ua", "au"):
            o["illegal"] += 1
        o["tail"] = o["tail"] if r["tail"] is None else r["tail"]
        if r["lo"] is not None:
            o["n_turns"] -= o["t_last"] == r["t_first"]
            o["lo"] = r["lo"] if o["lo"] is None else o["lo"]
            o["hi"], o["t_last"] = r["hi"], r["t_last"]
        if r["text"] is not None:
            self._write(r["text"])
        self.audit.append(r["audit"])
        self.state = r["leaves"]

    def result(self) -> dict:
        more, rest = completion(self.state)
        for x in rest:
            self._write(x)
        return {**{k: v for k, v in self.out.items() if k not in ("sid", "first", "leaves", "text")},
                "audit": "".join(self.audit) + more, "repaired_sha256": self.hash.hexdigest()}


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text, n): faults, cheapest edits, digest of the result.

    ``n`` says how often a row stands there; 0 only keeps its conversation in the result. Columns: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are taken by turn, nulls first; ties by role, then by the
    MD5 of the text. Null ids are one conversation. A conversation without rows has zeros, an empty audit and the digest of
    nothing; an empty table gives an empty result; further columns are ignored. Equal rows are counted before they are shuffled,
    and a conversation of any length is cut into segments; its audit and digest are one value each, the digest streamed.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    segments = materialize(_segments(_sorted_rows(turns), kind), "segments")
    columns = ["conv_id", *[x.split()[0] for x in _FACTS.split(", ")], "cost", "audit", "repaired_sha256"]
    done = segments.where("whole").select(columns).unionByName(_across(segments.where("not whole"), kind).select(columns))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n_turns"), F.lit(0).cast("bigint"))
    return done.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the contract's damage. Null roles and texts are one space, which has no place and is blank."""
    return repair(damage(conversations))
