"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, by Viterbi search
with survivor coalescence.

The rows of a conversation are read in order, one at a time. Four states (nothing written yet, last role system, user,
assistant) each keep one survivor: the cheapest edits that end there, ties to the least audit. Survivors are tips of a
backpointer tree whose segments count their references. A segment without a reference goes, one with a single reference
joins what follows it, and what all survivors share is emitted at once, so memory follows the unresolved part, one byte an
edit and survivor, not the conversation. A survivor that another one beats whatever follows is dropped; else the survivor
that has written nothing would keep the tree from ever coalescing.

Tied suffixes are compared whole without walking them. No survivor's audit is the start of another's, since all end with
the edit of the same row; so their order, kept as a rank, settles every comparison of longer audits that differ in their
survivor, and the few letters since the last row settle the rest.

Texts never enter the tree: ``edits`` names rows by number, and ``audits`` hands each survivor a copy of the running hash.

Distribution: one shuffle by conversation and sorts that spill. A conversation is one sequence for one hash and one audit,
so a single task reads it, however long, in bounded memory; ``repaired`` spreads its texts over tasks by row number.

Defined cases: rows go by turn (null first), then role, then text, so the input order does not matter. A null role or text
is one space, in the key of the damage too; a null conv_id is a conversation of its own. An empty role fits nowhere: it is
reroled or deleted, and counts as illegal beside any row. Rows alike in role and text are duplicates but the first, also at
one turn. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import small_batches

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

# The costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, LEAVE_TRUNCATED = 3, 4, 3, 3

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Turns that may be inserted before the next row, by state: more would only walk in circles.
INSERTED = {NOTHING: ("", "u", "ua"), SYSTEM: ("", "u", "ua"), USER: ("", "a"), ASSISTANT: ("", "u")}
#: A survivor in the second state that costs more than one in the first by over this much never wins.
BEATS = ((ASSISTANT, NOTHING, 4), (ASSISTANT, SYSTEM, 0), (ASSISTANT, USER, 3), (USER, NOTHING, 7), (USER, SYSTEM, 3),
         (USER, ASSISTANT, 3), (NOTHING, SYSTEM, 0), (NOTHING, ASSISTANT, 0), (NOTHING, USER, 3), (SYSTEM, USER, 3))
ROLES = {"u": "user", "a": "assistant"}

# Letters in the tree. Keep is the initial kept, rerole the capital of the new one, insert 1 (user) or 2 (assistant), delete D.
_INSERT = {"u": "1", "a": "2"}
TO_AUDIT = bytes.maketrans(b"suaUA12D", b"KKKRRIID")


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, bytes, bytes]]]:
    """Per state before a row: (state after it, cost, audit letters, tree letters)."""
    out = []
    for state in range(4):
        ways = []
        for added in INSERTED[state]:
            at = state
            for role in added:
                at = AFTER[role][at]
            edits = [(at, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                left = LEAVE_TRUNCATED if fault == TRUNCATED else 0
                for role, step in AFTER.items():
                    if at in step and role == initial:
                        edits.append((step[at], left, role))
                    elif at in step and role != "s":
                        edits.append((step[at], left + REROLE, role.upper()))
            for to, cost, letter in edits:
                tree = ("".join(_INSERT[r] for r in added) + letter).encode()
                ways.append((to, cost + INSERT * len(added), tree.translate(TO_AUDIT), tree))
        out.append(ways)
    return out


MOVES = {(initial, fault): _moves(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


class Segment:
    """Edits without a branch. ``refs`` counts the survivors and segments that start at its end."""

    __slots__ = ("parent", "letters", "refs")

    def __init__(self, parent: Segment | None, letters: bytes):
        self.parent, self.letters, self.refs = parent, bytearray(letters), 1


class Repair:
    """The search over one conversation: ``step`` for each row, then ``finish``. ``resolved`` holds the edits that are
    certain, until ``take`` hands them out."""

    def __init__(self, hashing: bool):
        tip = Segment(None, b"")
        self.alive = {NOTHING: (0, 0, tip, hashlib.sha256() if hashing else None)}
        self.resolved = bytearray()
        self.most = 0  # unresolved letters at most, for tests

    def step(self, role: str, text: str, fault: int) -> None:
        moves = MOVES[role[:1] if role[:1] in ("s", "u", "a") else "", fault]
        best: dict[int, tuple] = {}
        for state, (cost, rank, _, _) in self.alive.items():
            for to, more, audit, tree in moves[state]:
                key = (cost + more, rank, audit)
                if to not in best or key < best[to][0]:
                    best[to] = (key, state, tree)
        for better, worse, gap in BEATS:
            if better in best and worse in best and best[worse][0][0] > best[better][0][0] + gap:
                del best[worse]
        self._advance(best, role, text)

    def _advance(self, best: dict[int, tuple], role: str, text: str) -> None:
        heirs: dict[int, int] = {}
        for _, state, _ in best.values():
            heirs[state] = heirs.get(state, 0) + 1
        for state, (_, _, tip, _) in self.alive.items():
            if state not in heirs:
                self._release(tip)
            else:
                tip.refs = heirs[state]
        order = {to: rank for rank, to in enumerate(sorted(best, key=lambda q: best[q][0][1:]))}
        after = {}
        for to, ((cost, _, _), state, tree) in best.items():
            _, _, tip, sha = self.alive[state]
            if heirs[state] == 1:
                tip.letters += tree
            else:
                tip = Segment(tip, tree)
                sha = sha and sha.copy()
            if sha:
                self._write(sha, state, tree, role, text)
            after[to] = (cost, order[to], tip, sha)
        self.alive = after
        self._coalesce()

    @staticmethod
    def _write(sha, state: int, tree: bytes, role: str, text: str) -> None:
        first = state == NOTHING
        for letter in tree.decode():
            if letter == "D":
                continue
            if letter in "12":
                turn = "user:" if letter == "1" else "assistant:"
            else:
                turn = f"{ROLES[letter.lower()] if letter in 'UA' else role}:{text}"
            sha.update((turn if first else f"\n{turn}").encode())
            first = False

    @staticmethod
    def _release(tip: Segment | None) -> None:
        while tip is not None:
            tip.refs -= 1
            if tip.refs:
                return
            tip = tip.parent

    def _coalesce(self) -> None:
        size = 0
        for _, _, tip, _ in self.alive.values():
            at = tip
            while at.parent is not None:
                if at.parent.refs == 1:
                    at.parent.letters += at.letters
                    at.letters, at.parent = at.parent.letters, at.parent.parent
                else:
                    at = at.parent
            self.resolved += at.letters  # what all survivors share; empty when the next one comes here
            at.letters.clear()
            size += len(tip.letters)
        self.most = max(self.most, size)

    def take(self) -> bytes:
        out = bytes(self.resolved)
        self.resolved.clear()
        return out

    def finish(self) -> tuple[int, bytes, str]:
        """(cost, the rest of the edits, sha256 of the repaired conversation)."""
        ends = []
        for state, (cost, rank, _, _) in self.alive.items():
            for added in INSERTED[state]:
                at = state
                for role in added:
                    at = AFTER[role][at]
                if at in (NOTHING, ASSISTANT):
                    ends.append((cost + INSERT * len(added), rank, added, state))
        cost, _, added, state = min(ends)
        _, _, tip, sha = self.alive[state]
        last = "".join(_INSERT[r] for r in added).encode()
        if sha:
            self._write(sha, state, last, "", "")
        parts, at = [last], tip
        while at is not None:
            parts.append(bytes(at.letters))
            at = at.parent
        return cost, self.take() + b"".join(reversed(parts)), sha.hexdigest() if sha else ""


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and live: the rows after damage by crc32 of ``conv_id:turn``. A dropped row stays with
    ``live`` false, so that its conversation is known."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"),
                                plain(text).alias("text"), F.concat(plain(conv_id), F.lit(":"), plain(turn)).alias("key"))
    kind = F.crc32(F.col("key").cast("binary")) % 20
    return (rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy"))


def rows_in_order(rows: DataFrame) -> DataFrame:
    """Conversations whole in their partitions and in order, each row with its first fault (0: none).

    One shuffle, by conversation: the window over equal rows and the order within partitions keep that partitioning.
    """
    small_batches(rows.sparkSession)
    # all is read by position from the conversation, so a third of the rows in one still is one task, which spills
    placed = rows.repartition("conv_id")
    alike = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(~F.col("live"), 0).when(bare == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return (placed.withColumn("nth", F.row_number().over(alike)).withColumn("fault", fault)
            .sortWithinPartitions("conv_id", F.col("live").desc(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
            .select("conv_id", "turn", "role", "text", "fault", "live"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


AUDITS = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
          "most_unresolved long")


class _Counts:
    """Faults of the rows of one conversation, in order."""

    def __init__(self):
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def values(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.faults[1:], self.illegal]


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (as ``damaged`` gives them): counts of faults, cost, audit and hash of the repaired turns."""
    kind = dict(rows.dtypes)["conv_id"]
    ordered = rows_in_order(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        began, now, search, counts, audit = False, None, None, None, bytearray()
        schema = None

        def close() -> None:
            cost, rest, sha = search.finish()
            out.append((now, *counts.values(), cost, (bytes(audit) + rest).translate(TO_AUDIT).decode(), sha, search.most))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if schema is None:
                longs, strings = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
                schema = pa.schema([("conv_id", batch.schema.field(0).type), *[(c, pa.int64()) for c in longs],
                                    *[(c, pa.string()) for c in strings], ("most_unresolved", pa.int64())])
            for conv_id, turn, role, text, fault, live in _stream([batch]):
                if not began or conv_id != now:
                    if began:
                        close()
                    began, now, search, counts, audit = True, conv_id, Repair(True), _Counts(), bytearray()
                if live:
                    counts.add(turn, role, fault)
                    search.step(role, text, fault)
                    audit += search.take()
            if out:
                yield flush()
        if began:
            close()
            yield flush()
    return ordered.mapInArrow(run, f"conv_id {kind}, {AUDITS}")


def edits(rows: DataFrame) -> DataFrame:
    """Per edit: conv_id, edit_no (from 0), edit (Keep, Rerole, Delete, Insert), row (its number in the conversation; null
    for Insert) and new_role (null for Keep and Delete). Edits leave the task as soon as they are certain."""
    kind = dict(rows.dtypes)["conv_id"]
    ordered = rows_in_order(rows)
    names = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}
    new = {"U": "user", "A": "assistant", "1": "user", "2": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        began, now, search, at, row = False, None, None, 0, 0
        schema = None

        def emit(letters: bytes) -> None:
            nonlocal at, row
            for tree, audit in zip(letters.decode(), letters.translate(TO_AUDIT).decode()):
                out.append((now, at, names[audit], None if audit == "I" else row, new.get(tree)))
                at += 1
                row += audit != "I"

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field(0).type), ("edit_no", pa.int64()), ("edit", pa.string()),
                                    ("row", pa.int64()), ("new_role", pa.string())])
            for conv_id, _, role, text, fault, live in _stream([batch]):
                if not began or conv_id != now:
                    if began:
                        emit(search.finish()[1])
                    began, now, search, at, row = True, conv_id, Repair(False), 0, 0
                if live:
                    search.step(role, text, fault)
                    emit(search.take())
            if out:
                yield flush()
        if began:
            emit(search.finish()[1])
            if out:
                yield flush()
    return ordered.mapInArrow(run, f"conv_id {kind}, edit_no long, edit string, row long, new_role string")


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, edit_no (their order), edit, role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = (rows.where("live").withColumn("row", F.row_number().over(order) - 1)
                .select(F.col("conv_id").alias("of"), F.col("row").alias("at"), "role", "text"))
    found = edits(rows).where("edit <> 'Delete'")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at"))
    return found.join(numbered, same, "left").select(
        "conv_id", "edit_no", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
