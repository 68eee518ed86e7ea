"""Repair of the turn structure of conversations: the cheapest edits after which roles run system? (user assistant)+.

A conversation is its rows by turn (null turns first; rows of one turn by role and text).  Each row has at most one fault, the first
of: blank (no character but white space), duplicate (role and text stood in an earlier row), truncated (its last such
character is none of `.!?`).  Edits: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and
duplicate rows), Insert an empty user or assistant turn (3); a truncated row that stays adds 3.

* One shuffle: rows are repartitioned by conversation.  Duplicates are numbered and rows are put in order by two sorts inside the
  partitions, which spill, so a conversation may be larger than memory.
* A streaming pass over the sorted rows (mapInPandas) carries a dynamic programme over the four states of the role grammar
  (start, after system, after user, after assistant) across Arrow batches.  For each state it keeps the cost, the
  order of the states' edit strings (none is a prefix of another, since each ends in the edit of the last row, so an order
  once found holds for all that is appended), and the running SHA-256 of the repaired text, which copies cheaply.  No row is kept.
* Backpointers take four bytes a row.  They leave the task as blocks of `BLOCK` rows, are sorted by falling number inside the
  partition (spilling again), and a second pass walks them from the end to spell the audit.  Small conversations have one block.
  The audit itself, one letter an edit, is part of the result.

The hash of a repaired conversation depends on its whole text in order, so one conversation is one stream of one task, in bounded memory.

Null fields count as one space, so a null text is blank and a null role fits no place.  A null conversation is one
conversation.  Roles match by their first character as it stands.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
# Rows of one block of backpointers.
BLOCK = 1 << 16
START, SYSTEM, USER, ASSISTANT = range(4)
# What an inserted or reroled turn is in each state; its number is also the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
# Empty turns before the end, by state.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LONGEST = (1 << 63) - 1

STEPS = "key string, block long, steps binary, end int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "repaired_sha256")
FOUND = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string, audit string"


@lru_cache(maxsize=None)
def moves(initial: str, fault: int) -> list[tuple[int, list[tuple[int, int, str, list[str], str | None]]]]:
    """For each state after a row, the best way from each state before: (state, [(before, cost, edits, inserted roles, role or None if deleted)]).

    A role of "" stands for the row's own.
    """
    best: dict[tuple[int, int], tuple] = {}
    for before in range(4):
        state, inserted = before, []
        for _ in range(3):
            ends = [(DELETE, "D", state, None)]
            if fault not in (BLANK, DUPLICATE):
                late = UNFINISHED if fault == TRUNCATED else 0
                ends.append((REROLE + late, "R", NEXT[state], ROLE[NEXT[state]]))
                fits = {"s": SYSTEM if state == START else None, "u": USER if NEXT[state] == USER else None, "a": ASSISTANT if state == USER else None}.get(initial)
                if fits is not None:
                    ends.append((late, "K", fits, ""))
            for cost, letter, after, role in ends:
                way = (len(inserted) * INSERT + cost, "I" * len(inserted) + letter, list(inserted), role)
                if (before, after) not in best or way[:2] < best[before, after][:2]:
                    best[before, after] = way
            inserted.append(ROLE[NEXT[state]])
            state = NEXT[state]
    return [(after, [(b, *way) for (b, a), way in best.items() if a == after]) for after in range(4) if any(a == after for _, a in best)]


def code(before: int, edits: str) -> int:
    return before << 4 | (len(edits) - 1) << 2 | "DKR".index(edits[-1])


def edits_of(value: int) -> tuple[int, str]:
    return value >> 4, "I" * (value >> 2 & 3) + "DKR"[value & 3]


@dataclass
class Conversation:
    """The state of the pass over one conversation."""

    key: str
    # Of each reachable state: cost, place among the states' edit strings, SHA-256 so far.
    states: dict = field(default_factory=lambda: {START: (0, 0, hashlib.sha256())})
    steps: bytearray = field(default_factory=bytearray)
    block: int = 0
    first: int | None = None
    last: int | None = None
    turns: int = 0
    counts: list = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    initial: str | None = None

    def add(self, known: bool, turn: int, role: str, text: str, fault: int) -> None:
        if known:
            if self.first is None:
                self.first = turn
            if self.last != turn or not self.turns:
                self.turns += 1
            self.last = turn
        initial = role[:1]
        if self.initial is not None and (self.initial, initial) not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.counts[fault] += 1
        states = self.states
        found, step = [], bytearray(b"\xff\xff\xff\xff")
        for after, ways in moves(initial if initial in ("s", "u", "a") else "", fault):
            best = None
            for before, cost, edits, inserted, kept in ways:
                if before in states:
                    total, order, _ = states[before]
                    way = (total + cost, order, edits, before, inserted, kept)
                    if best is None or way[:3] < best[:3]:
                        best = way
            if best is not None:
                found.append((best[1], best[2], after, best))
                step[after] = code(best[3], best[2])
        self.steps += step
        found.sort(key=lambda x: x[:2])
        self.states = {}
        for place, (_, _, after, (total, _, _, before, inserted, kept)) in enumerate(found):
            sha = states[before][2]
            lines = [f"{r}:" for r in inserted]
            if kept is not None:
                lines.append(f"{kept or role}:{text}")
            if lines:
                sha = sha.copy()
                sha.update((("\n" if before != START else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            self.states[after] = (total, place, sha)

    def cut(self) -> tuple:
        """The backpointers gathered since the last block."""
        steps, block = bytes(self.steps), self.block
        self.steps, self.block = bytearray(), block + 1
        return (self.key, block, steps, None, *[None] * len(TOTALS))

    def close(self) -> tuple:
        """The last block, with the totals and the state at the end; inserts that end the conversation are `TO_END`."""
        total, _, end = min((total + TO_END[s] * INSERT, order, s) for s, (total, order, _) in self.states.items())
        sha, state = self.states[end][2].copy(), end
        for _ in range(TO_END[end]):
            sha.update((("\n" if state != START else "") + ROLE[NEXT[state]] + ":").encode())
            state = NEXT[state]
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LONGEST)
        return (self.key, self.block, bytes(self.steps), end, gaps, *self.counts[1:], self.illegal, total, sha.hexdigest())


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    found = pd.DataFrame(rows, columns=names, dtype=object)
    return found.astype({n: "Int64" for n, t in (c.split() for c in schema.split(", ")) if t in ("long", "int")})


def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, out = None, []
    for batch in batches:
        for key, known, turn, role, text, fault, gone in zip(*[batch[c] for c in ("key", "known", "turn", "role", "text", "fault", "gone")], strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.close())
                now = Conversation(key)
            if not gone:
                now.add(known, turn, role, text, fault)
                if len(now.steps) >= 4 * BLOCK:
                    out.append(now.cut())
        if out:
            yield _frame(out, STEPS)
            out = []
    if now is not None:
        yield _frame([now.close()], STEPS)


def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spells the audits; the blocks of a conversation come with falling numbers."""
    key, state, totals, parts = None, START, None, []
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.key != key:
                key, state, totals = row.key, int(row.end), [getattr(row, c) for c in TOTALS]
                parts = ["I" * TO_END[state]]
            steps = row.steps
            for at in range(len(steps) - 4, -4, -4):
                state, edits = edits_of(steps[at + state])
                parts.append(edits)
            if row.block == 0:
                out.append((key, *totals, "".join(reversed(parts))))
        if out:
            yield _frame(out, FOUND)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    `rows` has conv_id, turn, role, text; a column gone, if there is one, marks rows that only name their conversation.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    kind = rows.schema["conv_id"].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    plain = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), gone.alias("gone"))
    placed = plain.repartition("key")
    before = F.row_number().over(Window.partitionBy("key", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))  # streams; the same placement
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("_before") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    marked = placed.withColumn("_before", before).select(
        "key", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", "text", fault.alias("fault"), "gone", "_before")
    steps = marked.sortWithinPartitions("key", "known", "turn", "role", "text", "_before").drop("_before").mapInPandas(forward, STEPS)
    found = steps.sortWithinPartitions("key", F.desc("block")).mapInPandas(backward, FOUND)
    own = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).cast(kind)
    return found.select(own.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by `kind`.

    0 drops a row (it stays as `gone`), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it a user's; other numbers leave it.
    Without `kind` it is the CRC-32 of conv_id:turn modulo 20.  Nulls count as one space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    if kind is None:
        kind = F.crc32(F.encode(F.concat_ws(":", filled("conv_id"), filled("turn")), "UTF-8")) % 20
    some = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return some.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.coalesce(F.col("_kind") == 0, F.lit(False)).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")
