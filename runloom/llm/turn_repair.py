"""Cheapest repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation should be empty, or an optional system turn and then user and assistant turns in alternation. Four states say
what the next turn may be; each row is kept, given another role or deleted, and turns may be inserted before it. Per state
one survivor stays: the cheapest edits that end there, of equal ones the least in letters.

The survivors are leaves of a tree of back pointers. A node counts what refers to it, children and survivors; a branch that
no survivor needs any more goes at once. As soon as the root has a single child and no survivor, that child's edit is
certain: it is emitted and the child becomes the root. So memory holds the edits that are still open, not the conversation.
Equal costs are decided by the complete open edits of both survivors. Their order is carried along as a rank: survivors of the
same rows have different edits, none the beginning of another, so what is appended later never changes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runloom.llm import common

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States by what was said last, and where the initials of a role lead.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
GOOD, CUT, BAD = range(3)


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """The states that inserted turns lead to, with the edits; more than three lead nowhere new."""
    yield state, ""
    for edits in ("I", "II", "III"):
        state = next(s for letter, s in NEXT[state].items() if letter in ROLES)
        yield state, edits


def _moves(state: int, initial: str, fault: int) -> list[tuple[int, int, str]]:
    """From a state over one row: the new states, each with the least cost and edits."""
    best: dict[int, tuple[int, str]] = {}
    for at, inserts in _inserted(state):
        ways = [(at, DELETE, "D")]
        if fault != BAD:
            more = TRUNCATED if fault == CUT else 0
            ways += [(new, more if letter == initial else more + REROLE, "K" if letter == initial else "R")
                     for letter, new in NEXT[at].items() if letter in ROLES or letter == initial]
        for new, cost, edit in ways:
            way = (cost + INSERT * len(inserts), inserts + edit)
            best[new] = min(best.get(new, way), way)
    return [(new, *way) for new, way in best.items()]


MOVES = {(s, i, f): _moves(s, i, f) for s in NEXT for i in ("s", "u", "a", "") for f in (GOOD, CUT, BAD)}
LAST = {s: min((INSERT * len(i), i) for at, i in _inserted(s) if at in (EMPTY, ASSISTANT)) for s in NEXT}


class _Node:
    """One edit; ``child`` is the exclusive or of the children's numbers, so the only child is known."""

    __slots__ = ("number", "parent", "edit", "role", "text", "refs", "child")

    def __init__(self, number, parent, edit, role, text):
        self.number, self.parent, self.edit, self.role, self.text = number, parent, edit, role, text
        self.refs = self.child = 0


class Search:
    """The survivors over the rows so far. ``emit`` takes (edit, role, text) of each edit once it is certain."""

    def __init__(self, emit):
        self.emit, self.made = emit, 0
        self.root = _Node(0, None, "", None, None)
        self.open = {0: self.root}
        self.root.refs = 1
        self.alive = {EMPTY: (0, 0, self.root)}  # state: cost, rank, node

    def _grown(self, parent: _Node, edit: str, role, text) -> _Node:
        self.made += 1
        node = self.open[self.made] = _Node(self.made, parent, edit, role, text)
        parent.refs += 1
        parent.child ^= node.number
        return node

    def _dropped(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            del self.open[node.number]
            parent = node.parent
            parent.refs -= 1
            parent.child ^= node.number
            node = parent

    def _settled(self) -> None:
        """Emit what all survivors share. A root with one reference that is not a survivor's has one child."""
        while self.root.refs == 1 and self.root.child:
            child = self.open[self.root.child]
            self.emit(child.edit, child.role, child.text)
            del self.open[self.root.number]
            child.parent = None
            self.root = child

    def _path(self, state: int, node: _Node, edits: str, role: str, text: str) -> _Node:
        for edit in edits:
            if edit == "D":
                node = self._grown(node, edit, role, text)
                continue
            letter = role[:1] if edit == "K" else next(x for x in NEXT[state] if x in ROLES)
            state = NEXT[state][letter]
            node = self._grown(node, edit, role if edit == "K" else ROLES[letter], "" if edit == "I" else text)
        return node

    def _take(self, found: dict) -> None:
        """Replace the survivors: ``found`` has by state (cost, rank, edits, old state, role, text)."""
        before = self.alive
        order = sorted(found, key=lambda s: found[s][1:3])
        self.alive = {}
        for rank, state in enumerate(order):
            cost, _, edits, old, role, text = found[state]
            node = self._path(old, before[old][2], edits, role, text)
            node.refs += 1
            self.alive[state] = (cost, rank, node)
        for _, _, node in before.values():
            self._dropped(node)
        self._settled()

    def row(self, role: str, text: str, fault: int) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        found: dict = {}
        for old, (cost, rank, _) in self.alive.items():
            for new, more, edits in MOVES[old, initial, fault]:
                way = (cost + more, rank, edits, old, role, text)
                if new not in found or way[:3] < found[new][:3]:
                    found[new] = way
        # A state goes once another can end each of its ways cheaper: from ASSISTANT what SYSTEM still needs costs the same, what
        # EMPTY needs at most a deletion more, and an insertion leads from USER to ASSISTANT and back.
        cost_of = {s: f[0] for s, f in found.items()}
        for better, spare in ((ASSISTANT, {SYSTEM: 0, EMPTY: DELETE, USER: INSERT}), (USER, {ASSISTANT: INSERT})):
            for state, margin in spare.items():
                if better in cost_of and cost_of.get(state, 0) > cost_of[better] + margin:
                    found.pop(state, None)
        self._take(found)

    def end(self) -> int:
        """Emit the rest; the cost of all edits."""
        ways = []
        for state, (cost, rank, _) in self.alive.items():
            more, edits = LAST[state]
            ways.append((cost + more, rank, edits, state))
        cost, rank, edits, state = min(ways)
        self._take({ASSISTANT: (cost, rank, edits, state, "", "")})
        if not edits:  # the survivor is a node that was there before
            self._settled()
        return cost


def fault_of(text: str, repeated: bool) -> tuple[int, str]:
    """How a text may be treated, and its first fault."""
    said = text.strip(common.SPACES)
    if not said or repeated:
        return BAD, "duplicate" if said else "blank"
    return (GOOD, "") if said[-1] in ".!?" else (CUT, "truncated")


def ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """The rows of each conversation together and in order, with the number of earlier equal ones in ``copy``."""
    rows = turns.select(
        turns[conv].alias("conv"),
        turns[turn].cast("long").alias("turn"),
        F.coalesce(turns[role], F.lit(" ")).alias("role"),
        F.coalesce(turns[text], F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    ).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), F.col("text"))})
    same = Window.partitionBy("conv", "present", "role", "k1", "k2").orderBy("turn")
    # Rows that share the hash of ``conv`` also share that of the window, so texts are shuffled once.
    counted = rows.repartition("conv").withColumn("copy", F.row_number().over(same) - 1)
    return counted.sortWithinPartitions("conv", "turn", "role", "text", "copy").select("conv", "turn", "role", "text", "present", "copy")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


class _Figures:
    """What the rows of one conversation show before repair."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.initial = None
        self.turns = 0

    def row(self, turn: int | None, role: str, kind: str) -> None:
        if kind:
            self.counts[kind] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None:
            self.counts["illegal"] += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row per conversation: its faults and its cheapest repair.

    Rows are taken by turn, nulls first, ties by role and text. A row's first fault counts: ``blank``, ``duplicate`` (role and text of an
    earlier row, by 128-bit hashes of the text) or ``truncated`` (the last character is not one of ``.!?``). ``gaps`` are missing turn
    numbers, ``illegal`` neighbours that are not system-user, user-assistant or assistant-user by initials. Keeping costs 0, a new role
    1, a deletion 2 (blank and duplicate rows must go), an inserted empty turn 5, a truncated row that stays 5 more. ``audit`` has the
    initials of the cheapest edits in order, the least in letters of equal ones; ``repaired_sha256`` is the hash of the
    repaired ``role:text`` lines.

    A null role or text is one space. Rows where ``present`` is not true only name their conversation; one without other
    rows has zeros and an empty audit. Null ids are one conversation. An empty table gives an empty one; extra columns are ignored.
    One conversation is read in order by one task, which holds the edits still open and the audit, not the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            figures, audit, digest, lines = _Figures(), [], hashlib.sha256(), 0

            def emit(edit: str, role: str, text: str) -> None:
                nonlocal lines
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1

            search = Search(emit)
            for _, turn, role, text, present_, copy in rows:
                if present_:
                    fault, kind = fault_of(text, copy > 0)
                    figures.row(turn, role, kind)
                    search.row(role, text, fault)
            cost = search.end()
            numbers = [[figures.gaps], *[[n] for n in figures.counts.values()], [cost]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], kind_of), *[pa.array(n, pa.int64()) for n in numbers], pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                names=names,
            )

    given = ordered(turns, conv_col, turn_col, role_col, text_col, present)
    names = [conv_col, *_SUMMARY, "audit", "repaired_sha256"]
    kind_of = to_arrow_type(given.schema["conv"].dataType)
    kinds = [given.schema["conv"].dataType, *[T.LongType()] * len(_SUMMARY), T.StringType(), T.StringType()]
    return given.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def repaired_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The edits of ``repair`` as rows: ``place`` counts them, ``edit`` is K, R, D or I, with the role and text after it.

    Rows come out as soon as they are certain. Without edit D, in order of ``place``, they are the repaired conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            kinds = (kind_of, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        done: list[tuple] = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            place = iter(range(1 << 62))
            search = Search(lambda edit, role, text: done.append((conv, next(place), edit, role, text)))
            for _, _, role, text, _, copy in rows:
                search.row(role, text, fault_of(text, copy > 0)[0])
                if len(done) >= 1000:
                    yield batch()
            search.end()
        if done:
            yield batch()

    given = ordered(turns, conv_col, turn_col, role_col, text_col, None)
    names = [conv_col, "place", "edit", role_col, text_col]
    kind_of = to_arrow_type(given.schema["conv"].dataType)
    kinds = [given.schema["conv"].dataType, T.LongType(), T.StringType(), T.StringType(), T.StringType()]
    return given.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))

