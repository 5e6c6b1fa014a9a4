"""Repair of the structure of conversations by Hirschberg's divide and conquer.

The roles that are left must read ``(s?(ua)+)?``. Four states follow them: nothing
yet, after a system turn, after a user turn, after an assistant turn. The edits of
a row (insertions before it, then keep, rerole or delete) lead from state to state
at a cost. A conversation is halved: a forward vector has each state's least cost
up to the middle, a backward vector that from the middle on. The crossing of least
sum halves the task in two of its own, so no table of all rows is held.

Of equal sums the crossing with the least audit is taken. Audits need not be held
for that. Up to the middle all end with a row's letter and have one for each row,
so none begins another and their order is settled where they stand: the forward
vector has their ranks beside the costs. Ranks follow from the ranks one row before
and the letters since.

The least costs and ranks from each state to each other make a table. Tables of
rows in a stretch compose, so a conversation may be cut anywhere: rows are sorted
over the cluster, a task takes its stretch of a conversation to one table, the
crossings between stretches come from these tables by the same recursion, and each
stretch is then repaired by itself. Conversations that lie inside a task's rows are
repaired there. Only a conversation's digest, a running hash of its repaired turns,
passes through one task, in pieces and bounded memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import NO_ID, partitions, stored

WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Bytes of turns in a piece, and of a conversation that a task holds to repair it at once.
PIECE, HOLD = 1 << 16, 1 << 22
LONG = 2**63 - 1

# Rows are bytes: initial s, u, a or other (0 to 3), plus 4 if truncated; 8 must go; 9 is the conversation's end.
FORCED, END = 8, 9
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Insertions that a cheapest repair may make between two rows: (state, script, state). u and a: a turn of that role.
_INSERTS = [(q, "", q) for q in range(4)] + [(START, "u", AFTER_U), (START, "ua", AFTER_A), (AFTER_S, "u", AFTER_U), (AFTER_S, "ua", AFTER_A), (AFTER_U, "a", AFTER_A), (AFTER_A, "u", AFTER_U)]
#: A script's letters as the audit has them.
AUDIT = str.maketrans("uaUA", "IIRR")

#: A table: for each state, {state after: (cost, what orders audits, script)}.
Table = tuple[dict[int, tuple], ...]
#: For each state None or (cost, rank).
Vector = tuple


def _row_edits(code: int, q: int) -> list[tuple[int, str, int]]:
    if code == END:
        return [(0, "", q)] if q in (START, AFTER_A) else []
    out = [(DELETE, "D", q)]
    if code != FORCED:
        initial, extra = code % 4, TRUNCATED * (code >= 4)
        to_user, to_assistant = q != AFTER_U, q == AFTER_U
        if initial == 0 and q == START:
            out.append((extra, "K", AFTER_S))
        if to_user:
            out += [(extra, "K", AFTER_U)] * (initial == 1) + [(REROLE + extra, "U", AFTER_U)]
        if to_assistant:
            out += [(extra, "K", AFTER_A)] * (initial == 2) + [(REROLE + extra, "A", AFTER_A)]
    return out


def _table(code: int) -> Table:
    out: list[dict[int, tuple]] = [{} for _ in range(4)]
    for q, inserted, between in _INSERTS:
        for cost, letter, after in _row_edits(code, between):
            script = inserted + letter
            found = (INSERT * len(inserted) + cost, script.translate(AUDIT), script)
            out[q][after] = min(out[q].get(after, found), found)
    return tuple(out)


TABLES = [_table(code) for code in range(END + 1)]


def entered(q: int) -> Vector:
    return tuple((0, 0) if s == q else None for s in range(4))


def forward(vector: Vector, table: Table) -> tuple[int, Vector]:
    """The vector one item on, with its least cost taken off and returned."""
    best: list[tuple | None] = [None] * 4
    for q, own in enumerate(vector):
        if own is not None:
            for after, (cost, key, _) in table[q].items():
                found = (own[0] + cost, own[1], key)
                if best[after] is None or found < best[after]:
                    best[after] = found
    least = min(b[0] for b in best if b is not None)
    order = {k: i for i, k in enumerate(sorted({b[1:] for b in best if b is not None}))}
    return least, tuple(b and (b[0] - least, order[b[1:]]) for b in best)


def backward(vector: Vector, table: Table) -> Vector:
    """Costs to the end from before an item; least taken off."""
    found = [min((cost + vector[after] for after, (cost, _, _) in table[q].items() if vector[after] is not None), default=None) for q in range(4)]
    least = min(x for x in found if x is not None)
    return tuple(x if x is None else x - least for x in found)


@lru_cache(1 << 16)
def _row_forward(vector: Vector, code: int) -> tuple[int, Vector]:
    return forward(vector, TABLES[code])


@lru_cache(1 << 16)
def _row_backward(vector: Vector, code: int) -> Vector:
    return backward(vector, TABLES[code])


def crossings(items: Sequence, entry: int, end: Vector, ahead: Callable, back: Callable, table: Callable) -> list[tuple[int, int]]:
    """(state before, state after) of each item on the cheapest way of least audit; end: costs by state after the last."""
    out: list[tuple[int, int]] = []

    def solve(low: int, high: int, entry: int, end: Vector) -> None:
        if high - low == 1:
            ways = [(cost + end[after], key, after) for after, (cost, key, _) in table(items[low])[entry].items() if end[after] is not None]
            out.append((entry, min(ways)[2]))
            return
        middle = (low + high) // 2
        f, b = entered(entry), end
        for i in range(low, middle):
            f = ahead(f, items[i])[1]
        for i in range(high - 1, middle - 1, -1):
            b = back(b, items[i])
        _, _, meet = min((f[q][0] + b[q], f[q][1], q) for q in range(4) if f[q] is not None and b[q] is not None)
        solve(low, middle, entry, tuple(0 if q == meet else None for q in range(4)))
        solve(middle, high, meet, end)

    if items:
        solve(0, len(items), entry, end)
    return out


ACCEPTED = (0, None, None, 0)


def script(codes: bytes, entry: int = START, end: Vector = ACCEPTED) -> str:
    """The edits of a stretch of rows: lower-case letters insert, each upper-case letter is a row's edit."""
    found = crossings(codes, entry, end, _row_forward, _row_backward, TABLES.__getitem__)
    return "".join(TABLES[c][q][after][2] for c, (q, after) in zip(codes, found, strict=True))


_short = lru_cache(1 << 16)(script)


def cost_of(edits: str, codes: bytes) -> int:
    rows = iter(codes)
    total = 0
    for x in edits:
        if x.islower():
            total += INSERT
        else:
            code = next(rows)
            total += DELETE if x == "D" else REROLE * (x in "UA") + TRUNCATED * (4 <= code < FORCED)
    return total


def stretch_table(codes: bytes) -> Table:
    """The table of a stretch of rows: least costs and the ranks of audits, from each state."""
    out = []
    for q in range(4):
        total, f = 0, entered(q)
        for c in codes:
            least, f = _row_forward(f, c)
            total += least
        out.append({s: (total + x[0], x[1], "") for s, x in enumerate(f) if x is not None})
    return tuple(out)


def audit_of(edits: str, copies: dict[int, int]) -> str:
    """The audit's letters; copies: how many rows stand for one, by place (only deleted ones)."""
    if not copies:
        return edits.translate(AUDIT)
    out, row = [], 0
    for x in edits:
        if x.islower():
            out.append("I")
        else:
            out.append(x.translate(AUDIT) * copies.get(row, 1))
            row += 1
    return "".join(out)


def repaired(edits: str, turns: Sequence[tuple[str, str]]) -> list[str]:
    """role:text of the turns that stay or come in."""
    named, out, at = {"u": "user", "a": "assistant"}, [], iter(turns)
    for x in edits:
        if x.islower():
            out.append(f"{named[x]}:")
        else:
            role, text = next(at)
            if x != "D":
                out.append(f"{role if x == 'K' else named[x.lower()]}:{text}")
    return out


LEGAL = {(0, 1), (1, 2), (2, 1)}


class Stretch:
    """The rows of one conversation that a task has met: counts, codes and the turns not yet given away."""

    def __init__(self, conv: int):
        self.conv = conv
        self.codes, self.copies, self.turns, self.size = bytearray(), {}, [], 0
        self.cuts: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, known: bool, turn: int, role: str, text: str, copies: int, again: bool, bare: str) -> None:
        initial = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        if self.last is None:
            self.first = initial
        elif (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.last = initial
        if known and self.high != turn:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if not bare or again:
            self.blank += copies * (not bare)
            self.duplicate += copies * bool(bare)
            self._row(FORCED, copies, "", "")
            return
        cut = bare[-1] not in ".!?"
        self.truncated += cut
        self._row(initial + 4 * cut, 1, role, text)
        if copies > 1:
            self.duplicate += copies - 1
            self._row(FORCED, copies - 1, "", "")

    def _row(self, code: int, copies: int, role: str, text: str) -> None:
        if copies > 1:
            self.copies[len(self.codes)] = copies
        self.codes.append(code)
        self.turns.append((role, text))
        self.size += len(role) + len(text) + 16

    def more(self) -> int:
        """Cost of the rows that others stand for."""
        return DELETE * sum(n - 1 for n in self.copies.values())

    def gaps(self) -> int:
        return 0 if self.low is None else min(LONG, self.high - self.low + 1 - self.distinct)

    def done(self) -> dict:
        codes = bytes(self.codes)
        edits = (_short if len(codes) < 64 else script)(codes + bytes([END]))
        text = "\n".join(repaired(edits, self.turns))
        return {"conv": self.conv, "kind": "done", "gaps": self.gaps(), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost_of(edits, codes) + self.more(), "audit": audit_of(edits, self.copies), "digest": hashlib.sha256(text.encode()).hexdigest()}

    def piece(self) -> dict:
        out = {"conv": self.conv, "kind": "piece", "seq": len(self.cuts), "roles": [r for r, _ in self.turns], "texts": [t for _, t in self.turns]}
        self.cuts.append(len(self.turns))
        self.turns, self.size = [], 0
        return out

    def run(self) -> dict:
        told = {x: getattr(self, x) for x in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct")} | {"more": self.more(), "table": [[[s, *x[:2]] for s, x in row.items()] for row in stretch_table(bytes(self.codes))]}
        return {"conv": self.conv, "kind": "run", "codes": bytes(self.codes), "copies": json.dumps(list(self.copies.items())), "cuts": self.cuts, "told": json.dumps(told)}


PART = pa.schema(
    [("conv", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("digest", pa.string())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("copies", pa.string()), ("cuts", pa.list_(pa.int32())), ("told", pa.string())]
)
PART_SQL = "conv long, part int, kind string, seq int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, digest string, roles array<string>, texts array<string>, codes binary, copies string, cuts array<int>, told string"


def _rows(batches, *columns: str):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows, schema: pa.Schema, weigh: Callable[[dict], int] = lambda r: 64):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r)
        if size > HOLD or len(held) > 4000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stretches(hold: int, piece: int):
    """Sorted rows to conversations repaired at once (kind done), or to runs and pieces of those that may go on elsewhere."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def out():
            now, opened, first = None, False, True

            def close(last: bool):
                if opened or first or last:
                    yield now.piece()
                    yield now.run()
                else:
                    yield now.done()

            for conv, *row in _rows(batches, "conv", "known", "turn", "role", "text", "copies", "again", "bare"):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield from close(False)
                        first = False
                    now, opened = Stretch(conv), False
                now.add(*row)
                if now.size > (piece if opened or first else hold):
                    opened = True
                    yield now.piece()
            if now is not None:
                yield from close(True)

        return _batches(({"part": part} | r for r in out()), PART, lambda r: 64 + sum(map(len, r.get("texts", ()))))

    return run


CROSSED = "conv long, part int, entry int, exit int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _cross(batches):
    """Of each conversation in runs: how each run is entered and left (-1: the last one), and the counts of all (at the first)."""

    def out():
        now, held = None, []
        for conv, part, told in _rows(batches, "conv", "part", "told"):
            if conv != now and held:
                yield from joined(now, held)
                held = []
            now = conv
            held.append((part, json.loads(told)))
        if held:
            yield from joined(now, held)

    def joined(conv, runs):
        tables = [tuple({s: (cost, rank, "") for s, cost, rank in row} for row in told["table"]) for _, told in runs] + [TABLES[END]]
        found = crossings(tables, START, ACCEPTED, forward, backward, lambda t: t)
        total = {c: sum(told[c] for _, told in runs) for c in ("blank", "duplicate", "truncated", "illegal")}
        total["cost"] = sum(told["more"] for _, told in runs) + sum(t[q][s][0] for t, (q, s) in zip(tables, found, strict=True))
        total["illegal"] += sum((a["last"], b["first"]) not in LEGAL for (_, a), (_, b) in zip(runs, runs[1:], strict=False))
        known = [told for _, told in runs if told["low"] is not None]
        met = sum(t["distinct"] for t in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        total["gaps"] = min(LONG, known[-1]["high"] - known[0]["low"] + 1 - met) if known else 0
        for i, ((part, _), (entry, after)) in enumerate(zip(runs, found, strict=False)):
            yield {"conv": conv, "part": part, "entry": entry, "exit": -1 if i == len(runs) - 1 else after, **(total if i == 0 else {})}

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in CROSSED.split(", ")])
    return _batches(out(), schema)


EDITED = "conv long, part int, seq int, edits string, audit string"


def _edit(batches):
    """The edits of each run, cut as its pieces are."""

    def out():
        for conv, part, codes, copies, cuts, entry, after in _rows(batches, "conv", "part", "codes", "copies", "cuts", "entry", "exit"):
            last = after < 0
            edits = script(codes + bytes([END]) if last else codes, entry, ACCEPTED if last else tuple(0 if q == after else None for q in range(4)))
            many = {i: n for i, n in json.loads(copies)}
            # Where each row's edits end; what is inserted after the last row goes with it.
            ends = [i + 1 for i, x in enumerate(edits) if x.isupper()]
            at, low = 0, 0
            for seq, n in enumerate(cuts):
                high = len(edits) if at + n == len(codes) else ends[at + n - 1] if n else low
                own = edits[low:high]
                yield {"conv": conv, "part": part, "seq": seq, "edits": own, "audit": audit_of(own, {i - at: c for i, c in many.items() if at <= i < at + n})}
                at, low = at + n, high

    return _batches(out(), pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("edits", pa.string()), ("audit", pa.string())]), lambda r: len(r["audit"]) + 64)


def _repair(batches):
    def out():
        for conv, part, seq, roles, texts, edits, audit in _rows(batches, "conv", "part", "seq", "roles", "texts", "edits", "audit"):
            yield {"conv": conv, "part": part, "seq": seq, "audit": audit, "body": "\n".join(repaired(edits, list(zip(roles, texts, strict=True))))}

    return _batches(out(), pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("body", pa.string())]), lambda r: len(r["body"]) + 64)


def _digest(batches):
    """(conv, audit, digest) of pieces in order; a piece at a time is held, and the audit."""

    def out():
        now, some, audit, h = None, False, [], hashlib.sha256()
        for conv, own, body in _rows(batches, "conv", "audit", "body"):
            if conv != now:
                if now is not None:
                    yield {"conv": now, "audit": "".join(audit), "digest": h.hexdigest()}
                now, some, audit, h = conv, False, [], hashlib.sha256()
            audit.append(own)
            if body:
                h.update(("\n" * some + body).encode())
                some = True
        if now is not None:
            yield {"conv": now, "audit": "".join(audit), "digest": h.hexdigest()}

    return _batches(out(), pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("digest", pa.string())]), lambda r: len(r["audit"]) + 64)


def normal(conversations: DataFrame) -> DataFrame:
    """(conv, known, turn, role, text) without nulls: a missing conv_id as NO_ID, role and text as one space, turn not known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), space("role"), space("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """normal() rows with faults put in by crc32(conv_id:turn) mod 20; times: how often a row stands there."""
    name = F.concat(F.when(F.col("conv") == NO_ID, " ").otherwise(F.col("conv").cast("string")), F.lit(":"), F.when(F.col("known"), F.col("turn").cast("string")).otherwise(" "))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select("conv", "known", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"))


def repair(rows: DataFrame, hold: int = HOLD, piece: int = PIECE) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv, known, turn, role, text, times)."""
    spark = rows.sparkSession
    # Rows alike in all are one with a number: it may hold any part of a conversation.
    alike = stored(rows.groupBy("conv", "known", "turn", "role", "text").agg(F.sum("times").alias("copies")).withColumn("print", F.md5(F.concat(F.length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary")))), "turns")
    first = alike.groupBy("conv", "print").agg(F.count("*").alias("n"), F.min("known").alias("first_known"), F.min(F.when(F.col("known"), F.col("turn"))).alias("first_turn")).where("n > 1").drop("n")
    again = F.coalesce(F.col("known") & (~F.col("first_known") | (F.col("turn") > F.col("first_turn"))), F.lit(False))
    key = ("conv", "known", "turn", "role", "text")
    told = alike.join(first, ["conv", "print"], "left").select(*key, "copies", again.alias("again"), F.rtrim("text", F.lit(WHITE)).alias("bare"))
    told = told.withColumn("bare", F.right("bare", F.lit(1)))
    parts = stored(told.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(_stretches(hold, piece), PART_SQL), "conversation-parts")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    done = parts.where("kind = 'done'").select("conv", *counts, "audit", "digest")
    runs = parts.where("kind = 'run'")
    n = partitions(spark)
    crossed = stored(runs.select("conv", "part", "told").repartition(n, "conv").sortWithinPartitions("conv", "part").mapInArrow(_cross, CROSSED), "crossings")
    edits = runs.select("conv", "part", "codes", "copies", "cuts").join(crossed.select("conv", "part", "entry", "exit"), ["conv", "part"]).mapInArrow(_edit, EDITED)
    bodies = parts.where("kind = 'piece'").select("conv", "part", "seq", "roles", "texts").join(edits, ["conv", "part", "seq"]).mapInArrow(_repair, "conv long, part int, seq int, audit string, body string")
    ended = bodies.repartition(n, "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_digest, "conv long, audit string, digest string")
    rest = crossed.where("cost is not null").select("conv", *counts).join(ended, "conv")
    return done.unionByName(rest).withColumnRenamed("digest", "repaired_sha256")


def repair_damaged(conversations: DataFrame, hold: int = HOLD, piece: int = PIECE) -> DataFrame:
    """A row for each conv_id: what damaging its rows left, and the cheapest repair.

    Null conv_id: one conversation of its own, returned with a null id. Null turns
    come first. Null role and text: one space (so no user, and blank). Rows of one
    turn: in order of role and text. Repeated rows: duplicates. Roles that begin
    otherwise than s, u, a fit nowhere and are reroled or deleted. Gaps beyond the
    range of longs: the largest long. No rows after damage: zeros, empty audit, the
    empty text's hash. Empty table: no rows. Other columns are ignored.
    """
    rows = normal(conversations)
    found = repair(damaged(rows), hold, piece)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return (
        rows.select("conv").distinct().join(found, "conv", "left")
        .select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    )


def op11(conversations: DataFrame) -> DataFrame:
    return repair_damaged(conversations)


SQL = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM (SELECT range AS b FROM range(256))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
dealt AS (SELECT n.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ord(name[i]))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 20 AS k FROM named n, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM dealt, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM damaged),
faulty AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
ins(q, letters, new, r) AS (VALUES (0, '', []::VARCHAR[], 0), (1, '', [], 1), (2, '', [], 2), (3, '', [], 3), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3), (2, 'I', ['assistant:'], 3), (3, 'I', ['user:'], 2)),
ops(letter, cost, r, after, role, c) AS (SELECT 'D', 4, r::INTEGER, r::INTEGER, NULL::VARCHAR, NULL::VARCHAR FROM range(4) t(r) UNION ALL VALUES
  ('K', 0, 0, 1, NULL, 's'), ('K', 0, 0, 2, NULL, 'u'), ('K', 0, 1, 2, NULL, 'u'), ('K', 0, 3, 2, NULL, 'u'), ('K', 0, 2, 3, NULL, 'a'),
  ('R', 3, 0, 2, 'user', NULL), ('R', 3, 1, 2, 'user', NULL), ('R', 3, 3, 2, 'user', NULL), ('R', 3, 2, 3, 'assistant', NULL)),
steps AS (SELECT q, letters || letter AS letters, new, letter, 3 * len(letters) + cost AS cost, after, role, c FROM ins JOIN ops USING (r)),
way AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM placed
  UNION ALL
  SELECT f.conv_id, f.i, s.after, w.cost + s.cost + CASE WHEN s.letter <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS total, w.audit || s.letters AS said,
         list_concat(w.lines, list_concat(s.new, CASE WHEN s.letter = 'D' THEN [] ELSE [coalesce(s.role, f.role) || ':' || f.text] END))
  FROM way w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN steps s ON s.q = w.q AND (s.c IS NULL OR s.c = f.c) AND (s.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  QUALIFY row_number() OVER (PARTITION BY f.conv_id, s.after ORDER BY total, said) = 1),
n AS (SELECT conv_id, max(i) AS i, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ended AS (SELECT w.conv_id, w.cost + 3 * len(s.letters) AS cost, w.audit || s.letters AS audit, array_to_string(list_concat(w.lines, s.new), chr(10)) AS body
          FROM way w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i JOIN ins s ON s.q = w.q AND s.r IN (0, 3)
          QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * len(s.letters), w.audit || s.letters) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
