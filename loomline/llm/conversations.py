"""Conversation structure repair by divide and conquer over edit costs, in the manner of Hirschberg.

The edits of a conversation are the cheapest that leave role initials of the form ``(s?(ua)+)?``: Keep costs
0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant message) 5, and a truncated
message that stays 5 more. Blank and duplicate messages must go. Four states say what stands last: nothing,
system, user, assistant. A forward vector holds, for each state after the first half, the cost and the rank
of its least list of edits; a backward vector the cost of the rest. They meet in the middle, the state with
the least sum is chosen, of equal ones that with the least edits in ASCII order, and both halves are solved
alike: only the four-state vectors of the current halves are held. Two least lists of edits that end in one
message never begin with each other (both name every message), so ranks at a boundary decide the whole list.

Messages are ordered by (conversation, turn, role, hash of role and text) over range partitions, so a
conversation of any length lies in consecutive pieces. Conversations inside a partition are finished there.
Of the two at its edges only four-state vectors between piece ends meet in one task: they fix the states
where pieces meet, the pieces are then solved on their own, and their texts are hashed in a stream. Only a
result that is one value by definition, the list of edits, is held whole.

Nulls in role and text are one space, a null turn comes first, null ids are one conversation. Messages with
one turn are ordered by role and hash; equal messages of one turn are duplicates of the first. A message is
blank without other than ASCII white space, a duplicate if its role and text came earlier, truncated if its
last character other than white space is not ``.``, ``!`` or ``?``; the first of these counts. A conversation
without messages has zeros and the hash of the empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import stash

DELETE, RENAME, INSERT, CUT = 2, 1, 5, 5
#: Bytes of text, and messages, in one range partition.
PART_BYTES, PART_ROWS = 8 << 20, 100_000
SPACE = " \t\n\v\f\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULTS = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: What stands last once an inserted message follows, and after a system or user or assistant message.
_INSERTED = (USER, USER, ASSISTANT, USER)
_KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
#: Inserts that make a conversation complete where its messages end, by state.
TAILS = ("", "II", "I", "")
_LEGAL = {"su", "ua", "au"}

#: A step leads from a state to a state, at a cost and with a key that orders steps from one state; None: it cannot.
Step = Sequence[Sequence[tuple | None]]


def _message_step(initial: int, forced: bool, cut: bool) -> Step:
    """All ways past one message, the cheapest and of these the least in ASCII; up to two inserts may come before it."""
    table: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        at = start
        for inserts in range(3):
            before, base = "I" * inserts, INSERT * inserts
            ways = [(at, base + DELETE, before + "D")]
            if not forced:
                extra = CUT if cut else 0
                if initial in _KEPT[at]:
                    ways.append((_KEPT[at][initial], base + extra, before + "K"))
                ways.append((_INSERTED[at], base + RENAME + extra, before + "R"))
            for to, cost, edits in ways:
                old = table[start][to]
                if old is None or (cost, edits) < old:
                    table[start][to] = (cost, edits)
            at = _INSERTED[at]
    return tuple(tuple(row) for row in table)


#: By code: initial * 4 + forced * 2 + truncated.
STEPS = [_message_step(code >> 2, bool(code & 2), bool(code & 1)) for code in range(16)]


def forward(steps: Sequence[Step], start: int) -> list[tuple[int, int] | None]:
    """Per state at the end: cost from ``start``, and the rank of its least edits among the states'."""
    here: list[tuple[int, int] | None] = [None] * 4
    here[start] = (0, 0)
    for step in steps:
        found: list[tuple | None] = [None] * 4
        for s, known in enumerate(here):
            if known is not None:
                for t, way in enumerate(step[s]):
                    if way is not None:
                        new = (known[0] + way[0], known[1], way[1])
                        if found[t] is None or new < found[t]:
                            found[t] = new
        order = {key: i for i, key in enumerate(sorted(f[1:] for f in found if f is not None))}
        here = [None if f is None else (f[0], order[f[1:]]) for f in found]
    return here


def backward(steps: Sequence[Step], ends: list[int | None]) -> list[int | None]:
    """Per state at the start: cost to the end, where each state costs ``ends`` (None: not allowed)."""
    for step in reversed(steps):
        ends = [
            min((way[0] + ends[t] for t, way in enumerate(step[s]) if way is not None and ends[t] is not None), default=None) for s in range(4)
        ]
    return ends


def _met(left: list[tuple[int, int] | None], right: list[int | None]) -> tuple[int, int]:
    """Least cost, and the state of the least edits among those that reach it."""
    cost, _, state = min((f[0] + b, f[1], s) for s, (f, b) in enumerate(zip(left, right)) if f is not None and b is not None)
    return cost, state


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The state after each step of the cheapest and then least edits from ``start`` to ``end``."""
    if len(steps) <= 1:
        return [end] * len(steps)
    middle = len(steps) // 2
    ends: list[int | None] = [None] * 4
    ends[end] = 0
    _, state = _met(forward(steps[:middle], start), backward(steps[middle:], ends))
    return crossings(steps[:middle], start, state) + crossings(steps[middle:], state, end)


def last_state(steps: Sequence[Step], start: int = NOTHING) -> tuple[int, int]:
    """Cost of a whole conversation, and the state after its last message."""
    return _met(forward(steps, start), [INSERT * len(t) for t in TAILS])


def _edited(codes: bytes, roles: list[str], texts: list[str], start: int, end: int, last: bool) -> tuple[str, list[str]]:
    """Edits from a state to a state, and the repaired messages; with the inserts that complete the last piece."""
    steps = [STEPS[c] for c in codes]
    at, audit, lines = start, [], []
    ways = [(i, to) for i, to in enumerate(crossings(steps, start, end))]
    for i, to in ways:
        edits = steps[i][at][to][1]
        audit.append(edits)
        for edit in edits[:-1]:
            at = _INSERTED[at]
            lines.append("user:" if at == USER else "assistant:")
        if edits[-1] == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
        elif edits[-1] == "R":
            lines.append(f"{'user' if to == USER else 'assistant'}:{texts[i]}")
        at = to
    if last:
        audit.append(TAILS[at])
        for _ in TAILS[at]:
            at = _INSERTED[at]
            lines.append("user:" if at == USER else "assistant:")
    return "".join(audit), lines


class _Piece:
    """The messages of one conversation in one partition, in order."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts = conv, bytearray(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = None  # initials
        self.seen = self.marked = None

    def add(self, kind: int, turn: int | None, role: str, text: str, key: str, copies: int) -> None:
        if kind == MARK:
            self.marked = (turn, key)
        for _ in range(copies if kind == MESSAGE else 0):
            bare = text.strip(SPACE)
            blank = not bare
            duplicate = not blank and (turn, key) in (self.seen, self.marked)
            truncated = not blank and not duplicate and bare[-1] not in ".!?"
            self.blank += blank
            self.duplicate += duplicate
            self.truncated += truncated
            initial = role[:1]
            if self.codes:
                self.illegal += self.last + initial not in _LEGAL
            else:
                self.first = initial
            self.last = initial
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
            forced = blank or duplicate
            self.codes.append(_INITIALS.get(initial, 3) * 4 + forced * 2 + truncated)
            self.roles.append("" if forced else role)
            self.texts.append("" if forced else text)
            self.seen = (turn, key)


DROPPED, MARK, MESSAGE = 0, 1, 2
_PIECE = [
    ("piece", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("between", pa.list_(pa.int64())),
]
_PIECE_DDL = "piece long, turns long, low long, high long, first string, last string, codes binary, roles array<string>, texts array<string>, between array<long>"
_RESULT_DDL = ", ".join([*[f"{c} long" for c in COUNTS], "audit string, repaired_sha256 string"])


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _finished(p: _Piece) -> tuple:
    steps = [STEPS[c] for c in p.codes]
    cost, end = last_state(steps)
    audit, lines = _edited(bytes(p.codes), p.roles, p.texts, NOTHING, end, True)
    sha = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return (p.conv, _gaps(p.low, p.high, p.turns), p.blank, p.duplicate, p.truncated, p.illegal, cost, audit, sha, *[None] * len(_PIECE))


def _unfinished(p: _Piece, number: int) -> tuple:
    """The piece with what can stand between its ends: for each pair of states the cost and the rank, -1 where none."""
    steps = [STEPS[c] for c in p.codes]
    between = [x for s in range(4) for f in forward(steps, s) for x in (f or (-1, -1))]
    known = (None, p.blank, p.duplicate, p.truncated, p.illegal, None, None, None)
    return (p.conv, *known, number, p.turns, p.low, p.high, p.first, p.last, bytes(p.codes), p.roles, p.texts, between)


def _solve(conv: pa.DataType):
    names = [*RESULTS, *[n for n, _ in _PIECE]]
    types = [conv, *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), *[t for _, t in _PIECE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, edges, out, held = TaskContext.get().partitionId(), None, 0, [], 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for conv_id, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if piece is None:
                    piece = _Piece(conv_id)
                elif conv_id != piece.conv:
                    out.append(_finished(piece) if edges else _unfinished(piece, 2 * part))
                    held += len(piece.codes) + 1
                    edges, piece = 1, _Piece(conv_id)
                    if held > 20_000:
                        yield packed(out)
                        out, held = [], 0
                piece.add(*rest)
        if piece is not None:
            out.append(_unfinished(piece, 2 * part + 1))
        if out:
            yield packed(out)

    return run


def _planned(table: pa.Table) -> pa.Table:
    """The states where the pieces of one conversation meet, and its counts, from the vectors between piece ends."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    steps = [[[None if r["between"][8 * s + 2 * t] < 0 else tuple(r["between"][8 * s + 2 * t : 8 * s + 2 * t + 2]) for t in range(4)] for s in range(4)] for r in rows]
    cost, end = last_state(steps)
    ends = crossings(steps, NOTHING, end)
    full = [r for r in rows if r["first"] is not None]
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(full, full[1:]))
    dated = [r for r in rows if r["low"] is not None]
    turns = sum(r["turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = _gaps(dated[0]["low"], dated[-1]["high"], turns) if dated else 0
    totals = {"gaps": gaps, **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost}
    n = len(rows)
    return pa.table({
        "piece": pa.array([r["piece"] for r in rows], pa.int64()),
        "start": pa.array([NOTHING, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32()),
        "final": pa.array([k == n - 1 for k in range(n)], pa.bool_()),
        **{c: pa.array([v] * n, pa.int64()) for c, v in totals.items()},
    })


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["codes", "roles", "texts", "start", "end", "final"]).to_pylist()
        found = [_edited(r["codes"], r["roles"], r["texts"], r["start"], r["end"], r["final"]) for r in rows]
        results = [pa.array([a for a, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.string()))]
        kept = ["conv_id", "piece", "final", *COUNTS]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *results], names=[*kept, "edits", "lines"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: the hash of all lines is fed piece by piece."""
    sha, empty, audit = hashlib.sha256(), True, []
    for batch in batches:
        done, edits, sums = [], [], []
        for j, (final, some, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("final", "edits", "lines")))):
            audit.append(some)
            for line in lines:
                sha.update(("" if empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                empty = False
            if final:
                done.append(j)
                edits.append("".join(audit))
                sums.append(sha.hexdigest())
                sha, empty, audit = hashlib.sha256(), True, []
        kept = batch.take(pa.array(done, pa.int64())).select(["conv_id", *COUNTS])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(edits, pa.string()), pa.array(sums, pa.string())], names=RESULTS)


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults, the cost and edits of its cheapest repair, and the hash of the repaired messages.

    A column ``copies``, if there, says how many times a message stands there, adjacent; 0 for a message that is
    gone while its conversation is still to be reported.
    """
    copies = F.col("copies").cast("int") if "copies" in messages.columns else F.lit(1)
    space = F.lit(" ")
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), copies.alias("copies"),
    )
    whole = F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), space), F.char_length("role"), "role", "text")
    rows = rows.withColumn("key", F.md5(whole.cast("binary")))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, -(-int(size[0] or 0) // PART_BYTES), -(-size[1] // PART_ROWS))
    spaced = F.trim(F.translate("text", "\t\n\x0b\f\r", " " * 5)) == ""
    narrow = rows.filter((F.col("copies") > 0) & ~spaced).select("conv_id", "turn", "role", "key")
    firsts = narrow.groupBy("key").agg(F.min(F.struct("turn")).alias("a"), F.max(F.struct("turn")).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    later = narrow.join(firsts, "key").filter(F.struct("turn") > F.col("a")).select("conv_id", "turn", "role", "key").distinct()
    nothing = F.lit("")
    stream = (
        rows.select(
            "conv_id", F.when(F.col("copies") > 0, F.lit(MESSAGE)).otherwise(DROPPED).alias("kind"), "turn", "role",
            F.when(F.col("copies") > 0, F.col("text")).otherwise(nothing).alias("text"), "key", "copies",
        )
        .unionByName(later.select("conv_id", F.lit(MARK).alias("kind"), "turn", "role", nothing.alias("text"), "key", F.lit(0).alias("copies")))
        .repartitionByRange(parts, "conv_id", "turn", "role", "key")
        .sortWithinPartitions("conv_id", "turn", "role", "key", "kind")
    )
    kind = messages.schema[conv].dataType.simpleString()
    arrow = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    found = stash(stream.mapInArrow(_solve(arrow), f"conv_id {kind}, {_RESULT_DDL}, {_PIECE_DDL}"))
    pieces = found.filter("piece IS NOT NULL")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    vectors = pieces.select("conv_id", "piece", "turns", "low", "high", "first", "last", "between", "blank", "duplicate", "truncated", "illegal")
    plan = vectors.groupBy("conv_id").applyInArrow(_planned, f"piece long, start int, end int, final boolean, {counts}")
    solved = pieces.select("conv_id", "piece", "codes", "roles", "texts").join(plan, "piece")
    solved = solved.mapInArrow(_solve_pieces, f"conv_id {kind}, piece long, final boolean, {counts}, edits string, lines array<string>")
    ended = solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed, f"conv_id {kind}, {_RESULT_DDL}")
    return found.filter("piece IS NULL").select(*RESULTS).unionByName(ended)


def damaged(messages: DataFrame) -> DataFrame:
    """Messages with planned damage, by the crc32 of ``conv_id:turn`` modulo 20; ``copies`` is 0 for a dropped one."""
    space = F.lit(" ")
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), space), F.lit(":"))][:3])
    damage: Column = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return messages.select(
        "conv_id", "turn",
        F.when(damage == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(damage == 1, F.lit("")).when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1).alias("copies"),
    )
