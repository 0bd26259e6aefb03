"""Conversation structure repair as a lightest derivation, by Knuth's agenda.

A conversation should be at most one system turn and then pairs of a user and
an assistant turn, or nothing. The least changes that make it so are found
deductively. An item [i, q] says that the first i turns are dealt with and
leave the repaired conversation in state q; an axiom is an edit that a turn
admits. From an item and an edit of the turn after it follows the next item,
and from an item alone another one by an inserted turn. An item's weight is
(cost, audit), the audit being the initials of the edits so far. Every step
adds a cost and a letter, which keeps the order of weights and never lessens
one, so these functions are superior: the least weight on the agenda is final
when it is taken, and the search ends with the goal item.

Of items of one cost the agenda takes those of fewer turns first. That is as
good as the order of their audits, for only a kept turn costs nothing and it
leads on to more turns, and it spares comparing audits but of the same item.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
_FOLLOWS = frozenset(("su", "ua", "au"))
# States of a repaired beginning, by its last turn; the empty one and one ending in an
# assistant's turn are complete.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_COMPLETE = (_START, _ASSISTANT)
_KEPT = {
    (_START, "s"): _SYSTEM,
    **{(state, "u"): _USER for state in (_START, _SYSTEM, _ASSISTANT)},
    (_USER, "a"): _ASSISTANT,
}
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
SOUND, BLANK, DUPLICATE, CUT_OFF = "sound", "blank", "duplicate", "truncated"


def _added(state: int) -> int:
    """The state after a user's or an assistant's turn, whichever may come."""
    return _ASSISTANT if state == _USER else _USER


class Turn(NamedTuple):
    """A turn's number, role and text."""

    number: int | None
    role: str
    text: str


def faults(turns: Sequence[Turn]) -> list[str]:
    """The first fault of each turn: blank, a repetition, or an end without a full stop."""
    seen: set[bytes] = set()
    found = []
    for turn in turns:
        solid = turn.text.rstrip(_BLANKS)
        own = f"{len(turn.role)}:{turn.role}{turn.text}".encode("utf-8", "surrogatepass")
        key = hashlib.sha256(own).digest()
        if not solid:
            fault = BLANK
        elif key in seen:
            fault = DUPLICATE
        else:
            fault = SOUND if solid[-1] in _ENDS else CUT_OFF
        seen.add(key)
        found.append(fault)
    return found


class _Weight:
    """A cost and an audit. Audits share their beginnings, so that a step adds one letter."""

    __slots__ = ("before", "cost", "length", "letter")

    def __init__(self, cost: int, letter: str = "", before: _Weight | None = None) -> None:
        self.cost, self.letter, self.before = cost, letter, before
        self.length: int = before.length + 1 if before else 0

    def then(self, cost: int, letter: str) -> _Weight:
        return _Weight(self.cost + cost, letter, self)

    def __lt__(self, other: _Weight) -> bool:
        """By cost, then by audit in ASCII order, a beginning before its extension.

        Audits are compared back to where they part.
        """
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        less = a.length < b.length
        while a.length > b.length:
            a = a.before
        while b.length > a.length:
            b = b.before
        while a is not b:
            if a.letter != b.letter:
                less = a.letter < b.letter
            a, b = a.before, b.before
        return less

    def audit(self) -> str:
        letters, at = [], self
        while at.before is not None:
            letters.append(at.letter)
            at = at.before
        return "".join(reversed(letters))


def _edits(turn: Turn, fault: str) -> dict[int, list[tuple[int, str, int]]]:
    """The axioms of a turn: by state the cost, initial and next state of each edit it admits."""
    removed = {state: [(DELETE, "D", state)] for state in range(4)}
    if fault in (BLANK, DUPLICATE):
        return removed
    extra = TRUNCATED if fault == CUT_OFF else 0
    for state, edits in removed.items():
        kept = _KEPT.get((state, turn.role[:1]))
        if kept is not None:
            edits.append((extra, "K", kept))
        edits.append((RELABEL + extra, "R", _added(state)))
    return removed


def lightest(turns: Sequence[Turn], found: Sequence[str]) -> tuple[int, str]:
    """The least cost of a repair and, of the cheapest repairs, the ASCII-least audit."""
    axioms = [_edits(turn, fault) for turn, fault in zip(turns, found, strict=True)]
    goal = (len(turns) + 1, _START)
    best = {(0, _START): _Weight(0)}
    agenda = [(0, 0, _START)]  # cost, turns dealt with, state
    final: set[tuple[int, int]] = set()

    def derive(item: tuple[int, int], weight: _Weight) -> None:
        known = best.get(item)
        if known is None or weight < known:
            best[item] = weight
            if known is None or weight.cost < known.cost:
                heapq.heappush(agenda, (weight.cost, *item))

    while goal not in final:  # it follows from any item by deleting and inserting turns
        _, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        weight = best[i, state]
        if i < len(turns):
            for cost, letter, after in axioms[i][state]:
                derive((i + 1, after), weight.then(cost, letter))
        elif state in _COMPLETE:
            derive(goal, weight)
        if i <= len(turns):
            derive((i, _added(state)), weight.then(INSERT, "I"))
    return best[goal].cost, best[goal].audit()


def edited(turns: Sequence[Turn], audit: str) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit leaves and adds; an audit fixes the new roles."""
    out, state = [], _START
    left = iter(turns)
    for letter in audit:
        turn = None if letter == "I" else next(left)
        if letter == "D":
            continue
        state = _KEPT[state, turn.role[:1]] if letter == "K" else _added(state)
        role = turn.role if letter == "K" else _ROLES[state]
        out.append((role, turn.text if turn else ""))
    return out


class Repair(NamedTuple):
    """What is wrong with a conversation and what mends it."""

    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    repaired: list[dict[str, str]]


def repair(turns: Sequence[Turn]) -> Repair:
    """One conversation's faults and cheapest repair; its turns come in order."""
    numbers = {turn.number for turn in turns if turn.number is not None}
    found = faults(turns)
    initials = [turn.role[:1] for turn in turns]
    cost, audit = lightest(turns, found)
    return Repair(
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *(found.count(fault) for fault in (BLANK, DUPLICATE, CUT_OFF)),
        sum(a + b not in _FOLLOWS for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        [{"role": role, "text": text} for role, text in edited(turns, audit)],
    )


_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _repair_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 7 + [pa.string(), _REPAIRED]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["_conv", *Repair._fields],
    )


# Characters of repaired text in a batch that a task returns.
_BATCH_CHARS = 1 << 22


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of each conversation of sorted rows."""
    turns: list[Turn] = []
    conv, started = None, False
    done: list[tuple] = []
    size = 0
    for batch in batches:
        for c, number, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if started and c != conv:
                done.append((conv, *repair(turns)))
                turns = []
                if size > _BATCH_CHARS:
                    yield _repair_batch(done)
                    done, size = [], 0
            conv, started = c, True
            turns.append(Turn(number, role, text))
            size += len(text)
    if started:
        done.append((conv, *repair(turns)))
        yield _repair_batch(done)


def repaired_conversations(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per conversation: its id, its faults, and its cheapest repair.

    Turns are taken by number, NULL first, then by role and text; NULL roles and
    texts count as empty, rows without a conversation as one conversation. gaps
    counts the numbers missing between the least and the greatest. A turn's
    first fault counts: blank without a character but white space, duplicate
    where an earlier turn has its role and text, truncated where its last
    character but white space is no full stop, exclamation or question mark.
    illegal counts neighbours whose roles' initials are not su, ua or au.

    Of edits, keeping costs nothing, a new role of user or assistant 1, deleting
    2, inserting an empty turn of either 5. Blank and duplicate turns must go; a
    truncated one that stays costs 5 more. cost is the least that gives roles of
    the initials (s?(ua)+)?, audit the initials of its edits (Delete, Insert,
    Keep, Rerole), the ASCII-least among equals, and repaired the turns it
    leaves, as role and text. No rows give no rows; other columns are not
    looked at. One shuffle brings a conversation's turns together; a task holds
    one conversation at a time.
    """
    rows = conversations.select(
        F.col(conv_column).cast("long").alias("_conv"),
        F.col(turn_column).cast("long").alias("_turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    )
    ordered = rows.repartition("_conv").sortWithinPartitions(
        "_conv", F.col("_turn").asc_nulls_first(), "_role", "_text"
    )
    return ordered.mapInArrow(
        _repairs,
        "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired array<struct<role: string, text: string>>",
    ).withColumnRenamed("_conv", conv_column)
