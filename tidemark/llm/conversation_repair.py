"""Conversation structure repair by a Viterbi pass whose decided edits leave memory as soon as they are sure.

Every row of a conversation is kept, given another role or deleted, and empty turns may be inserted, so that the roles
read ``(s?(ua)+)?``. A survivor is the cheapest edit sequence that ends in one of the four states of that pattern; the
survivors share a tree of back pointers whose nodes count what points at them. Branches without a survivor fall away,
and once all survivors share an ancestor, the edits up to it are emitted and forgotten. Equal costs are settled by the
complete unresolved sequences down from the candidates' last common node, ASCII-least first.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State before and initial of the next role, to state after.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}


class _Node:
    """One edit on the way to some survivors; ``uses`` counts its children and the survivors that end here."""

    __slots__ = ("parent", "depth", "edit", "row", "role", "uses")

    def __init__(self, parent: "_Node | None", edit: str, row, role: str | None):
        self.parent, self.edit, self.row, self.role, self.uses = parent, edit, row, role, 1
        self.depth = 0 if parent is None else parent.depth + 1


def earlier(a: _Node, b: _Node) -> bool:
    """Whether the edits to ``a`` come before those to ``b``: both unresolved ends whole, back to their common node."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Survivors:
    """Cheapest edit sequences by state; ``row`` takes the next row and returns the edits that are sure since."""

    def __init__(self):
        self.root = _Node(None, "", None, None)
        self.best = {START: (0, self.root)}

    def _release(self, node: _Node) -> None:
        node.uses -= 1
        while not node.uses and node is not self.root:
            node = node.parent
            node.uses -= 1

    def _offer(self, to: dict, state: int, cost: int, parent: _Node, edit: str, row, role: str | None) -> None:
        have = to.get(state)
        if have and have[0] < cost:
            return
        node = _Node(parent, edit, row, role)
        parent.uses += 1
        if have and have[0] == cost and not earlier(node, have[1]):
            self._release(node)
            return
        to[state] = cost, node
        if have:
            self._release(have[1])

    def _insert(self) -> None:
        """Survivors that add empty turns here; more than two in a row never pay."""
        for state, initial in ((START, "u"), (SYSTEM, "u"), (ASSISTANT, "u"), (USER, "a")):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(self.best, STEP[state, initial], cost + INSERT, node, "I", None, NAMES[initial])

    def row(self, row: tuple) -> list[tuple]:
        """``row`` is (turn, role, text, fault)."""
        self._insert()
        initial, fault, to = row[1][:1], row[3], {}
        more = CUT if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._offer(to, state, cost + DELETE, node, "D", row, None)
            if fault in ("blank", "duplicate"):
                continue
            for wanted in "sua":
                after = STEP.get((state, wanted))
                if after is None:
                    continue
                if wanted == initial:
                    self._offer(to, after, cost + more, node, "K", row, row[1])
                elif wanted in NAMES:
                    self._offer(to, after, cost + REROLE + more, node, "R", row, NAMES[wanted])
        for _, node in self.best.values():
            self._release(node)
        self.best = to
        self._give_up()
        return self._sure()

    def _give_up(self) -> None:
        """Drop survivors that can no longer win, else deleting everything would stay one for ever.

        Whatever follows SYSTEM can as well follow ASSISTANT at the same cost, and whatever follows START can at a cost of at
        most one more deletion, of the system row that START might still keep; USER is one insertion from ASSISTANT.
        """
        reach = min((self.best[s][0] + more for s, more in ((ASSISTANT, 0), (USER, INSERT)) if s in self.best), default=float("inf"))
        for state, more in ((SYSTEM, 0), (START, DELETE)):
            if state in self.best and self.best[state][0] > reach + more:
                self._release(self.best.pop(state)[1])

    def _path(self, node: _Node) -> list[_Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _sure(self) -> list[tuple]:
        """Edits that all survivors share; the root moves below them."""
        out = []
        if self.root.uses == 1:
            for node in self._path(next(iter(self.best.values()))[1]):
                if self.root.uses > 1:
                    break
                out.append((node.edit, node.row, node.role))
                node.parent, node.row, self.root = None, None, node
        return out

    def end(self) -> list[tuple]:
        """The edits that were open after the last row."""
        self._insert()
        ends = [self.best[state] for state in (START, ASSISTANT) if state in self.best]
        pick = ends[0]
        for other in ends[1:]:
            if other[0] < pick[0] or other[0] == pick[0] and earlier(other[1], pick[1]):
                pick = other
        return [(n.edit, n.row, n.role) for n in self._path(pick[1])]


def faulty(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn, role, text, fault) of one conversation's ordered rows (turn, role, text, late); fault is None where there is none.

    ``late`` marks a row whose role and text an earlier turn has; equal rows of one turn are neighbours.
    """
    before = None
    for turn, role, text, late in rows:
        end = text.rstrip(SPACE)[-1:]
        if not end:
            fault = "blank"
        elif late or (turn, role, text) == before:
            fault = "duplicate"
        else:
            fault = None if end in ".!?" else "truncated"
        before = turn, role, text
        yield turn, role, text, fault


def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, row, new role) in order: K keep, R give another role, D delete, I insert; ``row`` is None for I."""
    survivors = Survivors()
    for row in rows:
        yield from survivors.row(row)
    yield from survivors.end()


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, absent``: rows harmed by crc32 of "conversation:turn" modulo 20.

    0 loses the row (it stays as ``absent``, without role and text, so that its conversation is still known), 1 empties
    the text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes it the user's. A null counts as one space.
    """
    def known(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(known(conv_id), F.lit(":"), known(turn)).cast("binary")) % 20
    copies = F.array_repeat(F.lit(0), F.when(F.col("_harm") == 3, 2).otherwise(1))
    return conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"),
                                known(text).alias("text"), harm.alias("_harm")).select(
        "conv_id", "turn", F.explode(copies).alias("_copy"),
        F.when(F.col("_harm") == 4, "user").when(F.col("_harm") > 0, F.col("role")).alias("role"),
        F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", ""))
        .when(F.col("_harm") > 0, F.col("text")).alias("text"),
        (F.col("_harm") == 0).alias("absent")).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together and in order, with ``late``: an earlier turn holds the same role and text.

    Whether a text came earlier is counted on digests, before the rows meet, so no task remembers a conversation's texts.
    """
    kept = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" ")),
                             "absent": F.coalesce("absent", F.lit(False))}).withColumn("_text", F.md5("text"))
    first = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    many = (kept.filter("NOT absent").groupBy("conv_id", "role", "_text").agg(F.min(first).alias("_first"), F.max(first).alias("_last"))
            .filter("_first < _last").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_digest"), "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_digest"))
    late = F.coalesce(first > F.col("_first"), F.lit(False))
    return (kept.join(many, same, "left").select("conv_id", "turn", "role", "text", "absent", late.alias("late"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _conversations(batches) -> Iterator[tuple]:
    """Conversation id and its rows (turn, role, text, late), one conversation after the other."""
    def rows():
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in range(6)])
    for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield conv, ((turn, role, text, late) for _, turn, role, text, absent, late in group if not absent)


def _prepared(rows: DataFrame) -> DataFrame:
    common.small_batches(rows.sparkSession)
    absent = F.col("absent").cast("boolean") if "absent" in rows.columns else F.lit(False)
    return _ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"), absent.alias("absent")))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text, fault``: every edit of every conversation of ``rows (conv_id, turn, role, text)``.

    Conversations are read by turn, null turns first, equal turns by role and text. ``place`` numbers the edits from 0.
    A deleted row keeps its old role and text here; the repaired conversation is all rows but the deleted ones.
    Null roles and texts count as one space, an empty role has no initial and is never kept; rows marked in a boolean column ``absent`` are
    not there. A null id is a conversation of its own. Other columns take no part; an empty table gives no rows.
    """
    schema = rows.select("conv_id").schema.add("place", "long").add("edit", "string").add("turn", "long").add("role", "string") \
        .add("text", "string").add("fault", "string")

    def task(batches):
        out, size = [], 0
        kind = None

        def made():
            columns = list(zip(*out)) if out else [[]] * 7
            types = [kind or pa.null(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch
        for conv, found in _conversations(typed()):
            for place, (edit, row, role) in enumerate(edits(faulty(found))):
                turn, old, text, fault = row or (None, None, "", None)
                out.append((conv, place, edit, turn, old if edit == "D" else role, text, fault))
                size += len(text)
                if len(out) >= common.BATCH_ROWS or size >= common.BATCH_BYTES:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    return _prepared(rows).mapInArrow(task, schema)


def report(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Takes what ``repair`` takes and folds the same edits while they are emitted. ``gaps`` counts missing turns, the next three the first
    faults of rows, ``illegal`` the neighbours whose role initials are not su, ua or au; ``audit`` holds the edits'
    initials and the digest the repaired ``role:text`` lines. A conversation without rows has zeros, an empty audit and
    the digest of nothing. The digest needs one conversation's rows in order, so a conversation is one task's; it
    streams through, and memory holds its unresolved edits only (the audit is one byte an edit).
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = rows.select("conv_id").schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")

    def fold(found) -> list:
        tally = dict.fromkeys(names, 0)
        low = high = last = previous = None
        distinct, audit, digest, lines = 0, bytearray(), hashlib.sha256(), 0

        def watched():
            nonlocal low, high, last, previous, distinct
            for row in faulty(found):
                turn, role, _, fault = row
                if turn is not None:
                    distinct += turn != last
                    low, high, last = (turn if low is None else low), turn, turn
                if fault:
                    tally[fault] += 1
                if previous is not None and previous + role[:1] not in ("su", "ua", "au"):
                    tally["illegal"] += 1
                previous = role[:1]
                yield row
        for edit, row, role in edits(watched()):
            audit += edit.encode()
            cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            tally["cost"] += cost + (CUT if edit in "KR" and row[3] == "truncated" else 0)
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{row[2] if row else ''}".encode())
                lines += 1
        if low is not None:
            tally["gaps"] = high - low + 1 - distinct
        return [tally[n] for n in names] + [audit.decode(), digest.hexdigest()]

    def task(batches):
        kind = pa.int64()

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch
        found = ((conv, *fold(group)) for conv, group in _conversations(typed()))
        while part := list(itertools.islice(found, common.BATCH_ROWS)):
            columns = list(zip(*part))
            types = [kind] + [pa.int64()] * len(names) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)
        common.give_back()

    return _prepared(rows).mapInArrow(task, schema)
