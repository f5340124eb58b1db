"""Conversation structure repair: Hirschberg's divide and conquer over four states.

A conversation is in order when its roles' initials are `(s?(ua)+)?`. Read turn by turn that is a machine with four states: nothing
yet, after the system's turn, after the user's, after the assistant's. Rows may be kept, given the role that is due, or deleted, and empty
turns of the due role inserted. The cheapest edits, of equally cheap ones those with the ASCII-least initials, are found in linear space:
a vector of four costs comes forward from the beginning of a part and one backward from its end; they meet in the middle, the best crossing
is chosen (of equally good ones that with the least edits so far, which the forward vector knows as a rank), and both halves are solved alike.

Rows are sorted by conversation and turn and stream through Arrow batches twice: first without their texts, for faults and edits, then with
them. A task keeps one byte for each row of the conversation at hand and the hashes of its distinct rows, but no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, GONE, CUT = range(3)  # what a row's first fault means: none, must be deleted, truncated
INITIALS = "sua"
INF = 1 << 60
#: Inserted turns lead from a state to the next one: the user's turn is due but after the user's own.
_DUE = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost and edits from each state to an end that is in order.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
BLANK = " \t\n\x0b\x0c\r"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _steps(initial: int, fault: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """For a row, from each state to each: the least cost and the edits, insertions before the row and what is done with it. initial: a place in INITIALS, or 3."""
    out = [[(INF, "")] * 4 for _ in range(4)]
    for start in range(4):
        at = start
        for inserted in range(3):
            found = [(at, DELETE, "D")]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                found.append((_DUE[at], REROLE + more, "R"))
                if initial < 3 and (_DUE[at] == initial + 1 or (initial == 0 and at == BEGIN)):
                    found.append((initial + 1, more, "K"))
            for to, cost, edit in found:
                out[start][to] = min(out[start][to], (inserted * INSERT + cost, "I" * inserted + edit))
            at = _DUE[at]
    return tuple(map(tuple, out))


STEPS = [_steps(i, f) for i in range(4) for f in range(3)]


def _forward(codes: bytes, lo: int, hi: int, start: int) -> list[tuple[int, int]]:
    """For each state after rows lo to hi - 1: the least cost from start, and the rank of its ASCII-least edits among the states'. No state's
    edits begin another's, as each ends with what is done with the last row; so ranks are kept row by row."""
    now = [(INF, 0)] * 4
    now[start] = (0, 0)
    for code in codes[lo:hi]:
        steps = STEPS[code]
        new = []
        for to in range(4):
            cost, rank, edits = INF, 9, ""
            for at in range(4):
                base, place = now[at]
                if base < INF:
                    step, text = steps[at][to]
                    if step < INF and (base + step, place, text) < (cost, rank, edits):
                        cost, rank, edits = base + step, place, text
            new.append((cost, rank, edits))
        order = sorted(range(4), key=lambda k: new[k][1:])
        now = [(new[k][0], order.index(k)) for k in range(4)]
    return now


def _backward(codes: bytes, lo: int, hi: int, end: tuple[int, ...]) -> tuple[int, ...]:
    """For each state before row lo: the least cost through row hi - 1, and from there the costs of `end`."""
    for i in range(hi - 1, lo - 1, -1):
        end = tuple(min(step[0] + rest for step, rest in zip(steps, end, strict=True)) for steps in STEPS[codes[i]])
    return end


def _solve(codes: bytes, lo: int, hi: int, start: int, end: tuple[int, ...], out: list[str]) -> int:
    """Append the edits of rows lo to hi - 1, and give the state after them."""
    if hi - lo == 1:
        steps = STEPS[codes[lo]][start]
        _, edits, to = min((steps[k][0] + end[k], steps[k][1], k) for k in range(4))
        out.append(edits)
        return to
    mid = (lo + hi) // 2
    before, after = _forward(codes, lo, mid, start), _backward(codes, mid, hi, end)
    _, _, cross = min((before[k][0] + after[k], before[k][1], k) for k in range(4))
    _solve(codes, lo, mid, start, tuple(0 if k == cross else INF for k in range(4)), out)
    return _solve(codes, mid, hi, cross, end, out)


def cheapest(codes: bytes) -> tuple[int, str]:
    """The cost of the cheapest edits of a conversation and the ASCII-least of their initials. codes: 3 * initial + fault, one byte for each row."""
    return _remembered(codes) if len(codes) <= 16 else _cheapest(codes)


def _cheapest(codes: bytes) -> tuple[int, str]:
    if not codes:
        return 0, ""
    end, out = tuple(c for c, _ in END), []
    cost = _backward(codes, 0, len(codes), end)[BEGIN]
    out.append(END[_solve(codes, 0, len(codes), BEGIN, end, out)][1])
    return cost, "".join(out)


_remembered = lru_cache(maxsize=1 << 16)(_cheapest)


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, more) -> conv_id, turn, role, text, copies: a known damage, for measuring repair.

    crc32 of `conv_id:turn` modulo 20: 0 drops a row (copies 0), 1 empties its text, 2 takes its . ! and ? away, 3 repeats it (copies 2), 4 makes its role
    user. Nulls of role and text, and in that key, are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), changed.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _rows(turns: DataFrame) -> DataFrame:
    """The columns that repair reads; no copies column means one of each row. Two hashes of role and text order rows of one turn and role, and tell repeats."""
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(0)) if "copies" in turns.columns else F.lit(1)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"), copies.alias("copies"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(3), F.char_length("text"), F.reverse("text"), "role")})


ORDER = ["turn", "role", "h1", "h2"]


def _examined(rows: DataFrame) -> DataFrame:
    """conv_id and REPORT: faults and edits of each conversation, from rows without their texts."""
    said = F.rtrim("text", F.lit(BLANK))
    fault = F.when(said == "", 1).when(F.substring(said, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
    bare = rows.select("conv_id", "turn", "role", "h1", "h2", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run  # no conversation yet
        out: list[tuple] = []

        def close() -> None:
            cost, audit = cheapest(bytes(codes))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            out.append((at, gaps, *counts, cost, audit))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])
            out.clear()
            return made

        for batch in batches:
            for conv, turn, h1, h2, copies, initial, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "h1", "h2", "copies", "initial", "fault")), strict=True):
                if at is run or conv != at:
                    if at is not run:
                        close()
                    at, codes, seen, counts, turns, last = conv, bytearray(), set(), [0, 0, 0, 0], [0, 0, 0], None
                for _ in range(copies):
                    if turn is not None and (not turns[2] or turn != turns[1]):
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                    key = h1 << 64 | h2 & (1 << 64) - 1
                    if fault == 1:
                        counts[0] += 1
                    elif key in seen:
                        counts[1] += 1
                    elif fault == 2:
                        counts[2] += 1
                    gone = fault == 1 or key in seen
                    seen.add(key)
                    place = INITIALS.find(initial) if initial else -1
                    codes.append(3 * (3 if place < 0 else place) + (GONE if gone else CUT if fault == 2 else FINE))
                    counts[3] += last is not None and last + initial not in ("su", "ua", "au")
                    last = initial
            if len(out) >= 1000:
                yield batch_of()
        if at is not run:
            close()
        if out:
            yield batch_of()

    sorted_rows = bare.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).drop("role")
    return sorted_rows.mapInArrow(run, f"conv_id long, {REPORT}")


def _edited(rows: DataFrame, examined: DataFrame) -> DataFrame:
    """Rows of conversations, each conversation's report before its rows."""
    reports = examined.withColumn("row", F.lit(0))
    both = rows.withColumn("row", F.lit(1)).unionByName(reports, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", *ORDER).select("conv_id", "row", "role", "text", "copies", *(c.split()[0] for c in REPORT.split(", ")))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(report, None, None, None) at the beginning of a conversation, then (None, edit, role, text) for each edit; a deleted row's own role and text."""
    audit, place, state = "", 0, BEGIN

    def inserts() -> Iterator[tuple]:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            state, place = _DUE[state], place + 1
            yield None, "I", "user" if state == USER else "assistant", ""

    for batch in batches:
        columns = batch.schema.names
        for r in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            row = dict(zip(columns, r, strict=True))
            if row["row"] == 0:
                yield from inserts()
                audit, place, state = row["audit"], 0, BEGIN
                yield row, None, None, None
                continue
            for _ in range(row["copies"]):
                yield from inserts()
                edit, place = audit[place], place + 1
                role = row["role"]
                if edit == "R":
                    state = _DUE[state]
                    role = "user" if state == USER else "assistant"
                elif edit == "K":
                    state = 1 + INITIALS.index(role[0])
                yield None, edit, role, row["text"]
    yield from inserts()


def report(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; copies: how often a row stands there, 0 for not at all) -> one row for each conv_id, also where no row is left:

    gaps (turn numbers missing between the least and the greatest; null ones don't count), blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours whose initials are not su, ua or au), cost and audit of the cheapest repair, repaired_sha256 (of its `role:text`, joined by line breaks).

    Null roles and texts are one space; a row without a role's initial can't be kept. Rows go by turn, null first, those of one turn by role and
    hashes of role and text. A null conv_id is a conversation too. An empty table gives an empty result; other columns are not used."""
    rows = _rows(turns)
    names = [c.split()[0] for c in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, of, digest, first = [], None, None, True

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 6 else pa.int64()) for i, c in enumerate(columns)], names=["conv_id", *names, "repaired_sha256"])

        for head, edit, role, text in _walk(batches):
            if head:
                if of:
                    out.append((of["conv_id"], *(of[c] for c in names), digest.hexdigest()))
                of, digest, first = head, hashlib.sha256(), True
                if len(out) >= 1000:
                    yield batch_of()
            elif edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        if of:
            out.append((of["conv_id"], *(of[c] for c in names), digest.hexdigest()))
        if out:
            yield batch_of()

    return _edited(rows, _examined(rows)).mapInArrow(run, f"conv_id long, {REPORT}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """turns, as for report -> conv_id, place (from 1), edit (K, R or I), role, text: the repaired conversations' turns. Conversations with none have no row."""
    rows = _rows(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, place = [], None, 0
        names = ["conv_id", "place", "edit", "role", "text"]

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.string()) for i, c in enumerate(columns)], names=names)

        for head, edit, role, text in _walk(batches):
            if head:
                conv, place = head["conv_id"], 0
            elif edit != "D":
                place += 1
                out.append((conv, place, edit, role, text))
                if len(out) >= 200:
                    yield batch_of()
        if out:
            yield batch_of()

    return _edited(rows, _examined(rows)).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")
