"""Conversation structure repair: the cheapest edits that make roles alternate.

Turns are kept (K), given another role (R) or deleted (D), and empty turns inserted (I), so that
the roles read ``(s?(ua)+)?``. Of the cheapest edits those with the least audit string win.

**Rank-compressed dynamic program.** A layer is a turn, its states are what the roles so far end
in (nothing, s, u, a). A turn's macro edit is a run of up to two inserted turns and then what
happens to the turn itself. Its codes D, ID, IID, IIK, IIR, IK, IR, K, R are prefix-free and in
order, so audit strings of equally many codes compare like their codes, and a prefix's place is
known by the *rank* of its state in the layer. A state keeps a cost, a rank and a pointer to its
parent and code, one byte; strings exist only when the pointers are followed back. Longer runs of
inserted turns come back to a state that a shorter run reaches for less.

**Long conversations.** Rows are sorted by conversation and turn over ranges, so a task holds
whole conversations but for the one that it begins and the one that it ends with, and solves them.
Those two go on as pieces. A piece is solved for each state that it may be entered in; its costs
and, for each entry, the order of its exits are all that the next step needs, as strings
with different beginnings are told apart by the ranks there. The pieces of a conversation, at most
as many as there are tasks, are chained, and each then follows its own pointers back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, ship

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: In the order of their strings, none of which begins another.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a role that is wanted next is, by state, if it is not the system's.
_NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_FAR = 1 << 60
_SPACE = " \t\n\v\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")


def _moves(initial: str, fault: str) -> list[list[tuple[int, int, int]]]:
    """For each state after a turn: (state before, cost, code) of the best macro edits to it."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in range(4):
        at, cost, run = before, 0, ""
        while True:
            options = [("D", at, DELETE)]
            if fault in ("", "truncated"):
                more = TRUNCATED if fault else 0
                options.append(("R", _NEXT[at], REROLE + more))
                if (initial, at) == ("s", NONE):
                    options.append(("K", SYSTEM, more))
                elif initial in "ua" and initial == ROLES[_NEXT[at]][0]:
                    options.append(("K", _NEXT[at], more))
            for letter, to, price in options:
                found = (cost + price, CODES.index(run + letter))
                best[before, to] = min(best.get((before, to), (_FAR, 0)), found)
            if len(run) == 2:
                break
            at, cost, run = _NEXT[at], cost + INSERT, run + "I"
    return [[(b, *best[b, to]) for b in range(4) if (b, to) in best] for to in range(4)]


#: By role initial (x for any other) and fault.
MOVES = {(i, f): _moves(i, f) for i in "suax" for f in FAULTS}
#: Closing insertions by the state that they end a conversation in.
CLOSING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def forward(turns: list[tuple[str, str]], entry: int) -> tuple[list[int], list[int], bytearray]:
    """Costs and ranks of the exits of ``turns`` (initial, fault) entered in a state, and the
    pointers: four bytes a turn, parent * 16 + code."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[entry] = 0
    pointers = bytearray()
    for turn in turns:
        layer, order = [_FAR] * 4, []
        for to, moves in enumerate(MOVES[turn]):
            best = None
            for before, price, code in moves:
                if cost[before] < _FAR:
                    found = (cost[before] + price, rank[before], code, before)
                    if best is None or found < best:
                        best = found
            if best is None:
                pointers.append(0)
            else:
                layer[to] = best[0]
                order.append((best[1], best[2], to))
                pointers.append(best[3] * 16 + best[2])
        order.sort()
        rank = [0] * 4
        for i, (_, _, to) in enumerate(order):
            rank[to] = i
        cost = layer
    return cost, rank, pointers


def backward(pointers: bytearray, leave: int) -> tuple[int, list[int]]:
    """The entry and the codes of the best way to an exit."""
    codes = []
    for i in range(len(pointers) // 4 - 1, -1, -1):
        leave, code = divmod(pointers[4 * i + leave], 16)
        codes.append(code)
    return leave, codes[::-1]


def ending(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """The cost of the whole and the state that it ends in."""
    total, _, state = min((cost[s] + INSERT * len(CLOSING[s]), rank[s], s) for s in range(4))
    return total, state


def repaired(rows: list[tuple[str, str]], codes: list[int], state: int, last: bool) -> tuple[str, list[list[str]]]:
    """Audit string of ``rows`` (role, text) entered in ``state``, and the lines that come of each
    row; those that close a conversation come with its last row."""
    audit, lines = [], []
    for (role, text), code in zip(rows, codes):
        own = []
        for letter in CODES[code]:
            if letter == "D":
                continue
            kept = SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[state]
            state = kept
            own.append(f"{ROLES[state] if letter != 'K' else role}:{text if letter != 'I' else ''}")
        audit.append(CODES[code])
        lines.append(own)
    if last:
        for letter in CLOSING[state]:
            state = _NEXT[state]
            audit.append(letter)
            lines[-1].append(f"{ROLES[state]}:")
    return "".join(audit), lines


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def fault(text: str, again: bool) -> str:
    bare = text.rstrip(_SPACE)
    if not bare:
        return "blank"
    if again:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after damage by crc32 of ``conv_id:turn`` modulo 20."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
        F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).alias("_d"),
    )
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _solved(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result columns of one whole conversation's rows (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    turns = []
    for _, role, text in rows:
        turns.append((initial(role), fault(text, (role, text) in seen)))
        seen.add((role, text))
    cost, rank, pointers = forward(turns, NONE)
    total, state = ending(cost, rank)
    _, codes = backward(pointers, state)
    audit, lines = repaired([r[1:] for r in rows], codes, NONE, True)
    digest = hashlib.sha256("\n".join(line for own in lines for line in own).encode()).hexdigest()
    found = [t for t, _, _ in rows if t is not None]
    gaps = found[-1] - found[0] + 1 - len(set(found)) if found else 0
    count = lambda what: sum(f == what for _, f in turns)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), _illegal([r[1] for r in rows]), total, audit, digest)


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


_FIELDS = ("conv_id long", "whole boolean", "piece int", "pos long", "turn long", "role string", "text string")
_SCHEMA = ", ".join(_FIELDS) + ", " + RESULT
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
_NAMES = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
_ARROW = pa.schema([(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in _SCHEMA.split(", ")])
#: Rows that leave a task together.
OUT = 2_000


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")))


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that are whole here, and the rows of the first and the last,
    which may not be. Rows come sorted."""
    piece = TaskContext.get().partitionId()
    out: list[tuple] = []
    held: list[tuple] | None = None
    first, conv = True, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    def as_piece(rows: list[tuple]) -> Iterator[tuple]:
        for pos, (turn, role, text) in enumerate(rows):
            yield (conv, False, piece, pos, turn, role, text) + (None,) * 8

    for key, group in groupby(_by_conversation(batches), key=lambda r: r[0]):
        if held is not None:
            out += as_piece(held) if first else [(conv, True) + (None,) * 5 + _solved(held)]
            first = False
        held, conv = [r[1:] for r in group], key
        while len(out) >= OUT:
            yield batch_of(out[:OUT])
            del out[:OUT]
    if held is not None:
        out += as_piece(held)
    for lo in range(0, len(out), OUT):
        yield batch_of(out[lo : lo + OUT])


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs and ranks of a piece for each entry, and what it adds to the counts."""
    rows = rows.sort_values("pos")
    roles = rows["role"].tolist()
    faults = [fault(t, a) for t, a in zip(rows["text"], rows["again"])]
    turns = list(zip(map(initial, roles), faults))
    cost, rank = [], []
    for entry in range(4):
        c, r, _ = forward(turns, entry)
        cost += c
        rank += r
    found = [int(t) for t in rows["turn"] if t is not None]
    return pd.DataFrame(
        {
            "conv_id": pd.array([rows["conv_id"].iloc[0]], dtype="Int64"),
            "piece": [rows["piece"].iloc[0]],
            "cost": [cost],
            "rank": [rank],
            "low": pd.array([found[0] if found else None], dtype="Int64"),
            "high": pd.array([found[-1] if found else None], dtype="Int64"),
            "distinct": [len(set(found))],
            "first": [roles[0][:1]],
            "last": [roles[-1][:1]],
            "illegal": [_illegal(roles)],
            **{w: [faults.count(w)] for w in FAULTS[1:]},
        }
    )


_SUMMARY = "conv_id long, piece int, cost array<long>, rank array<long>, low long, high long, distinct long, first string, last string, illegal long, blank long, duplicate long, truncated long"
_CHAINED = "conv_id long, piece int, entry int, leave int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """A conversation's pieces in order: the state in which each is entered and left, and the
    counts of the whole. A piece is one macro edit with its own costs and ranks."""
    pieces = list(rows.sort_values("piece").itertuples(index=False))
    cost, rank, parents = [0, _FAR, _FAR, _FAR], [0] * 4, []
    for p in pieces:
        layer, order, parent = [_FAR] * 4, [], [0] * 4
        for to in range(4):
            ways = [(cost[b] + int(p.cost[4 * b + to]), rank[b], int(p.rank[4 * b + to]), b) for b in range(4) if max(cost[b], p.cost[4 * b + to]) < _FAR]
            if ways:
                layer[to], above, own, parent[to] = min(ways)
                order.append((above, own, to))
        order.sort()
        rank = [0] * 4
        for i, (_, _, to) in enumerate(order):
            rank[to] = i
        cost = layer
        parents.append(parent)
    total, state = ending(cost, rank)
    ways = []
    for parent in reversed(parents):
        ways.append((parent[state], state))
        state = parent[state]
    ways.reverse()
    spans = [(int(p.low), int(p.high), int(p.distinct)) for p in pieces if p.distinct]
    distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    illegal = sum(int(p.illegal) for p in pieces) + sum(a.last + b.first not in ("su", "ua", "au") for a, b in zip(pieces, pieces[1:]))
    n = len(pieces)
    return pd.DataFrame(
        {
            "conv_id": rows["conv_id"].tolist(),
            "piece": [p.piece for p in pieces],
            "entry": [w[0] for w in ways],
            "leave": [w[1] for w in ways],
            "final": [i == n - 1 for i in range(n)],
            "gaps": [spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0] * n,
            **{w: [sum(int(getattr(p, w)) for p in pieces)] * n for w in FAULTS[1:]},
            "illegal": [illegal] * n,
            "cost": [total] * n,
        }
    )


def _decoded(rows: pd.DataFrame) -> pd.DataFrame:
    """The audit of a piece, and the repaired lines of each of its rows."""
    rows = rows.sort_values("pos")
    entry, leave, final = (rows[c].iloc[0] for c in ("entry", "leave", "final"))
    turns = [(initial(r), fault(t, a)) for r, t, a in zip(rows["role"], rows["text"], rows["again"])]
    _, _, pointers = forward(turns, int(entry))
    _, codes = backward(pointers, int(leave))
    audit, lines = repaired(list(zip(rows["role"], rows["text"])), codes, int(entry), bool(final))
    return pd.DataFrame(
        {"conv_id": rows["conv_id"].tolist(), "piece": rows["piece"].tolist(), "pos": rows["pos"].tolist(), "audit": [audit, *[None] * (len(rows) - 1)], "lines": ["\n".join(x) if x else None for x in lines]}
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of lines that come sorted; a running digest holds no texts."""
    names = ["conv_id", "repaired_sha256"]
    digest, conv, begun, any_ = None, None, False, False
    for batch in batches:
        done = []
        for key, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if not any_ or key != conv:
                if any_:
                    done.append((conv, digest.hexdigest()))
                digest, conv, begun, any_ = hashlib.sha256(), key, False, True
            if lines is not None:
                digest.update((b"\n" if begun else b"") + lines.encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names)
    if any_:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names)


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation in the table, with ``damage`` of its rows after ``damaged``.

    Null roles and texts are one space, so they are blank or have a role to be replaced. Rows of a
    null conv_id are one conversation. Null turns come first; rows of equal turn are taken by role,
    then xxhash64 of the text, and repeated ones are duplicates. Very long texts are compared and digested whole.
    An empty table gives none, a conversation without rows after damage zeros and an empty audit.
    Other columns are ignored. The digest of one conversation is sequential by definition: one
    task reads its lines in order, holding none."""
    spark = conversations.sparkSession
    ship(spark)
    plain = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = damaged(conversations) if damage else plain.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # the random end of the key can only part rows that are equal
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order, "text")
    done = materialize(ranged.mapInArrow(released(_task), _SCHEMA), "turns")
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    whole = done.where("whole").select("conv_id", *names)

    cut = done.where("not whole").select("conv_id", "piece", "pos", F.col("turn").cast("string").alias("turn"), "role", "text", F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("same"))
    earliest = cut.groupBy("conv_id", "same").agg(F.min(F.struct("piece", "pos")).alias("at"))
    again = F.struct("piece", "pos") > F.col("at")
    cut = materialize(_null_safe(cut, earliest, ["conv_id", "same"]).select("conv_id", "piece", "pos", "turn", "role", "text", again.alias("again")), "pieces")
    chained = cut.groupBy("conv_id", "piece").applyInPandas(_summary, _SUMMARY).groupBy("conv_id").applyInPandas(_chain, _CHAINED)
    chained = materialize(chained, "chained")
    # at most two rows for each task of the sorted rows
    way = F.broadcast(chained.select("conv_id", "piece", "entry", "leave", "final"))
    decoded = _null_safe(cut, way, ["conv_id", "piece"]).groupBy("conv_id", "piece").applyInPandas(_decoded, "conv_id long, piece int, pos long, audit string, lines string")
    decoded = materialize(decoded, "decoded")
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    audit = decoded.where("audit is not null").groupBy("conv_id").agg(audits.alias("audit"))
    digests = decoded.select("conv_id", "piece", "pos", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos").mapInArrow(released(_digests), "conv_id long, repaired_sha256 string")
    counts = chained.where("final").select("conv_id", *names[:6])
    split = _null_safe(_null_safe(counts, audit, ["conv_id"]), digests, ["conv_id"]).select("conv_id", *names)

    every = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id")).distinct()
    found = whole.unionByName(split)
    out = _null_safe(every, found, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names[:6]]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal; the keys are those of ``left``."""
    names = {c: f"_{c}" for c in on}
    other = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    condition: Column | None = None
    for c, name in names.items():
        one = left[c].eqNullSafe(other[name])
        condition = one if condition is None else condition & one
    return left.join(other, condition, how).drop(*names.values())
