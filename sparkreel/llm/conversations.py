"""Conversation structure repair by a backward cost-to-go pass and a greedy forward walk.

A conversation's rows are edited one by one until the initials of their roles read ``(s?(ua)+)?``: a grammar of four states
(nothing yet, after s, after u, after a). Each conversation is one stream of rows by turn, on one task but never in memory as
a whole. The backward pass reads it from the end and keeps, for each state, the least cost to go; with each row it writes
down what to do in each state: the edits that lie on a cheapest path, at every step the one first in ASCII. The forward
pass reads rows in order, follows the edits from the start state and rebuilds turns, digesting them as they come.

Equal rows of one turn are one row with a count, combined before they are shuffled: all but the first are duplicates, and
duplicates can only be deleted. A row is a duplicate if its role and text occurred in an earlier turn, which a running minimum
tells. A repaired conversation's digest follows its rows in order, so one conversation's stream isn't split.

Defined results: a null role, text, and a null in the number that decides on damage, count as one space; rows with a null
conv_id are one conversation; a null turn comes first and counts in no gap; rows of one turn come by role, then text; rows
that repeat another are duplicates; a role of other initials can only be changed or deleted; a conversation of which no row
is left has zeros, an empty audit and the digest of an empty string; gaps beyond the range of long are its greatest value;
long texts pass one at a time; an empty table gives an empty result; columns besides those four play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from sparkreel.workers import mapped

#: States: nothing yet, after s, after u, after a. NEXT: what a user or assistant turn leads to; LETTER: which of the two it must be.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
LETTER = "uuau"
ROLE = {"u": "user", "a": "assistant", "s": "system"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 60
LEGAL = ("su", "ua", "au")
MOST = (1 << 63) - 1
BLANK = r"\A[\x20\x09-\x0D]*\z"
#: The last character that isn't blank ends no sentence.
CUT = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (how often the row stands there; 0: all that is left is the conversation's name)."""
    rows = table.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20)).alias("d"))
    d, gone = F.col("d"), F.col("d") == 0
    text = F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    nothing = lambda c: F.when(~gone, c)
    return rows.select("conv_id", nothing(F.col("turn")).alias("turn"), nothing(F.when(d == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"), nothing(text).alias("text"), F.when(gone, 0).when(d == 3, 2).otherwise(1).cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n), equal ones as one, with fault: 0 none, 1 blank, 2 duplicate (the first of n, too), 3 truncated."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # what follows asks for rows by conversation; dealt out here, no further exchange is needed
    dealt = once.repartition("conv_id")
    first = F.min(F.struct("turn")).over(Window.partitionBy("conv_id", "role", "text"))
    kind = F.when(F.col("text").rlike(BLANK), 1).when(~F.col("first.turn").eqNullSafe(F.col("turn")), 2).when(F.col("text").rlike(CUT), 3).otherwise(0)
    return dealt.withColumn("first", first).withColumn("fault", kind.cast("int")).drop("first")


def cheapest(costs: list[int]) -> list[int]:
    """Cost to go with turns inserted before the next row, where that is cheaper."""
    out = list(costs)
    out[USER] = min(costs[USER], INSERT + costs[ASSISTANT])
    out[ASSISTANT] = min(costs[ASSISTANT], INSERT + costs[USER])
    for state in (START, SYSTEM):
        out[state] = min(costs[state], INSERT + out[USER])
    return out


def after(state: int, initial: str) -> int | None:
    """Where a row of this initial leads, if it may stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == LETTER[state] else None


def steps(initial: str, fault: int, n: int, rest: list[int]) -> tuple[list[int], list[tuple[str, int]]]:
    """rest: cost to go after these n equal rows. The cost to go before them, and for each state the edits of the first row (inserts before it, too) and the state after it."""
    copies = DELETE * (n - 1)
    extra = TRUNCATED if fault == 3 else 0
    edits: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if fault in (0, 3):
            to = after(state, initial)
            if to is not None:
                own.append(("K", extra, to))
            own.append(("R", REROLE + extra, NEXT[state]))
        edits.append(own)
    costs = cheapest([min(c + rest[to] for _, c, to in own) + copies for own in edits])
    plans = []
    for state in range(4):
        path, at = "", state
        while True:
            tight = {e: to for e, c, to in edits[at] if c + rest[to] + copies == costs[at]}
            if "D" not in tight and INSERT + costs[NEXT[at]] == costs[at]:
                path, at = path + "I", NEXT[at]
                continue
            edit = min(tight)
            plans.append((path + edit, tight[edit]))
            break
    return costs, plans


#: Cost to go at the end: what is written must be empty or end with an assistant's turn.
END = cheapest([0, NEVER, NEVER, 0])


def ending(state: int) -> str:
    """The inserts that bring a conversation to its end."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def backward(rows: DataFrame) -> DataFrame:
    """rows in reverse order by conversation, with cost (from the start state) and, for each state, plan and next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rest, begun = None, END, False
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "n")}
            costs, plans, nexts = [], [], []
            for own, initial, fault, n in zip(*columns.values(), strict=True):
                if not begun or own != conv:
                    conv, rest, begun = own, END, True
                if n:
                    rest, found = steps(initial, fault, n, rest)
                else:
                    found = [("", s) for s in range(4)]
                costs.append(rest[START])
                plans.append([p for p, _ in found])
                nexts.append([s for _, s in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(plans, pa.list_(pa.string())), pa.array(nexts, pa.list_(pa.int32()))], [*batch.schema.names, "cost", "plan", "next"])

    return mapped(rows, run, rows.select("*").schema.add("cost", "long").add("plan", ArrayType(StringType())).add("next", ArrayType(IntegerType())))


class Walk:
    """A conversation's state on its way through the forward pass; its edits, as rows of EDITS."""

    def __init__(self, conv):
        self.conv, self.state, self.seq = conv, START, 0

    def out(self, turn, was, role, text, n, fault, edit, cost) -> tuple:
        self.seq += 1
        return self.conv, self.seq - 1, turn, was, role, text, n, fault, edit, cost

    def insert(self) -> tuple:
        role, self.state = ROLE[LETTER[self.state]], NEXT[self.state]
        return self.out(None, None, role, "", 1, 0, "I", None)

    def row(self, turn, role, text, n, fault, cost, plan, then) -> Iterator[tuple]:
        if not n:  # nothing but the conversation's name
            yield self.out(None, None, None, None, 0, 0, None, None)
            return
        path, to = plan[self.state], then[self.state]
        for _ in path[:-1]:
            yield self.insert()
        edit = path[-1]
        new = {"K": role, "R": ROLE[LETTER[self.state]], "D": None}[edit]
        yield self.out(turn, role, new, None if edit == "D" else text, n, fault, edit, cost)
        self.state = to

    def end(self) -> Iterator[tuple]:
        for _ in ending(self.state):
            yield self.insert()


#: What the forward pass gives; see edits().
EDITS = "seq long, turn long, was string, role string, text string, n long, fault integer, edit string, cost long"
#: Rows of edits handed on at once; characters of their texts.
HELD, CHARACTERS = 4096, 1 << 23


def forward(rows: DataFrame) -> DataFrame:
    """rows in order by conversation, each with its edit, and the turns inserted between."""
    names = ["turn", "role", "text", "n", "fault", "cost", "plan", "next"]
    schema = typed(rows, EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, made, size, kinds = None, [], 0, None
        for batch in batches:
            kinds = [batch.column("conv_id").type, *KINDS]
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if walk is None or conv != walk.conv:
                    made += walk.end() if walk else ()
                    walk = Walk(conv)
                own = [batch.column(c)[i].as_py() for c in names]
                made += walk.row(*own)
                size += len(own[2] or "")
                if len(made) >= HELD or size >= CHARACTERS:
                    yield as_batch(made, kinds, schema.names)
                    made, size = [], 0
        made += walk.end() if walk else ()
        if made:
            yield as_batch(made, kinds, schema.names)

    return mapped(rows, run, schema)


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]


def typed(rows: DataFrame, fields: str):
    schema = rows.select("conv_id").schema
    for field in fields.split(", "):
        schema = schema.add(*field.split(" "))
    return schema


def as_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def edits(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, n (as damaged() gives them). What to do with each conversation, in order:

    conv_id, seq (from 0), turn, was (its role; null for an inserted turn), role and text (as repaired; null where deleted),
    n (equal rows, of which edit is done to the first and the others are deleted), fault (0 none, 1 blank, 2 duplicate,
    3 truncated), edit (K, D, R or I; null for a conversation without rows), cost (from here to the end).
    """
    found = faults(rows).withColumn("initial", F.substring("role", 1, 1))
    back = found.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    return forward(backward(back).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text"))


def repaired(edited: DataFrame) -> DataFrame:
    """Of edits(): the turns of the repaired conversations, conv_id, seq (ascending, with gaps), role, text."""
    return edited.filter(F.col("edit").isin("I", "K", "R")).select("conv_id", "seq", "role", "text")


class Report:
    """What report() says of a conversation, gathered from its edits in order."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal, self.cost, self.audit = conv, [0, 0, 0, 0], 0, None, []
        self.least = self.last = self.before = None
        self.turns, self.digest, self.begun = 0, hashlib.sha256(), False

    def add(self, seq, turn, was, role, text, n, fault, edit, cost) -> None:
        if edit is None:
            return
        self.audit.append(edit + "D" * (n - 1))
        if role is not None:
            self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.begun = True
        if edit == "I":
            return
        self.cost = cost if self.cost is None else self.cost
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.counts[fault] += n if fault == 1 else 1
        self.counts[2] += 0 if fault == 1 else n - 1
        # equal neighbours are never legal
        self.illegal += (self.before is not None and self.before + was[:1] not in LEGAL) + n - 1
        self.before = was[:1]

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv, min(gaps, MOST), *self.counts[1:], self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edited: DataFrame) -> DataFrame:
    """edited: edits(), in the order in which it comes. One row for each conversation: its faults, what its repair costs, the edits' initials, the digest of the repaired turns."""
    schema = typed(edited, REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds = None, None
        for batch in batches:
            kinds, done = [batch.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()], []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] == 0:  # the first of a conversation
                    done += [own.row()] if own else []
                    own = Report(conv)
                own.add(*row)
            if done:
                yield as_batch(done, kinds, schema.names)
        if own:
            yield as_batch([own.row()], kinds, schema.names)

    return mapped(edited, run, schema)
