"""Repair of damaged conversations by least-cost edits, streamed over sorted turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm.common import WORD

#: Cost of an edit by its initial; a truncated turn that stays costs ``CUT`` more.
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
CUT = 1

# What stands at the end of the turns so far: nothing, a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
# The state that a user or assistant turn leads to; no other than these two may be added.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LETTERS = "DIKR"
_NEVER = 1 << 60

TURNS = "conv_key string, turn bigint, dated boolean, role string, text string, fault string"
REPAIRED = (
    "conv_key string, edit string, turn bigint, dated boolean, role string, text string, fault string,"
    " new_role string"
)
REPORT = (
    "conv_key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def key_of(conv_id: Column) -> Column:
    """A text for each conversation id, with one of its own for null."""
    return F.coalesce(F.concat(F.lit(":"), conv_id.cast("string")), F.lit(""))


def id_of(conv_key: Column, kind: str) -> Column:
    return F.when(conv_key != "", F.substr(conv_key, F.lit(2))).cast(kind)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of ``conv_id:turn`` modulo 20 asks for; nulls count as one space.

    0 drops the row, 1 empties the text, 2 removes ``.``, ``!`` and ``?``, 3 repeats the row, 4 makes it the user's.
    """
    space = F.lit(" ")
    own = [F.coalesce(F.col(name).cast("string"), space) for name in ("conv_id", "turn")]
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(own[0], F.lit(":"), own[1]).cast("binary")) % 20).alias("_case"),
    )
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_case") == 3, F.array_repeat(F.lit(1), 2)).otherwise(F.array(F.lit(1)))
    return rows.filter("_case != 0").select(
        "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def faulty(turns: DataFrame) -> DataFrame:
    """The turns as ``TURNS``, dealt out by conversation, with each one's first fault or null.

    ``blank`` has no word, ``duplicate`` equals an earlier turn in role and text, ``truncated`` does not
    end in ``.``, ``!`` or ``?``. Earlier turns with equal texts are found by a sort inside the
    partitions, which spills; no set of seen texts is held.
    """
    shaped = turns.select(
        key_of(F.col("conv_id")).alias("conv_key"), F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"),
        F.col("turn").isNotNull().alias("dated"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).repartition("conv_key")
    # clustered by conversation already: the window sorts, but moves nothing
    equal = Window.partitionBy("conv_key", "role", "text").orderBy("dated", "turn")
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank")
        .when(F.row_number().over(equal) > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), "truncated")
    )
    return shaped.select("*", fault.alias("fault"))


@lru_cache(maxsize=1 << 16)
def _step(ahead: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """Cost from each state over one turn and what follows, and each state's edit, two bits each.

    ``ahead`` is the cost from each state behind the turn; costs are relative to the least, so few
    different ones occur. Of edits that cost the same the one with the least letter is taken: a
    letter and a state leave one state to go to, so this gives the least text of edits.
    """
    must_go = fault in ("blank", "duplicate")
    stays = CUT if fault == "truncated" else 0
    keeps = _KEEPS.get(initial, {})
    found = []
    for state in range(4):
        kept = keeps.get(state)
        found.append([
            COSTS["D"] + ahead[state], _NEVER,
            _NEVER if must_go or kept is None else COSTS["K"] + stays + ahead[kept],
            _NEVER if must_go else COSTS["R"] + stays + ahead[_NEXT[state]],
        ])
    # one insertion before a turn is enough: two either undo each other or may as well stand at the end
    best = [min(own) for own in found]
    for state in range(4):
        found[state][1] = COSTS["I"] + best[_NEXT[state]]
    costs = [min(own) for own in found]
    edits = sum(own.index(cost) << 2 * state for state, (own, cost) in enumerate(zip(found, costs)))
    return tuple(cost - min(costs) for cost in costs), edits


def _last() -> tuple[int, ...]:
    """Cost from each state behind the last turn."""
    costs = [0 if state in _ENDS else _NEVER for state in range(4)]
    for _ in range(2):
        costs = [min(costs[state], COSTS["I"] + costs[_NEXT[state]]) for state in range(4)]
    return tuple(costs)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns last first: adds each one's edits by state as one small number; carries the costs along."""
    key, ahead = None, _last()
    for batch in batches:
        edits = np.empty(len(batch), np.int16)
        for at, (own, role, fault) in enumerate(zip(batch["conv_key"], batch["role"], batch["fault"])):
            if own != key:
                key, ahead = own, _last()
            ahead, edits[at] = _step(ahead, role[:1], fault or None)
        yield batch.assign(edits=edits)


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns first to last with their edits by state: the repaired conversation, edit by edit."""
    key, state = None, START

    def added() -> tuple:
        return key, "I", 0, False, None, "", None, _ROLE[state]

    for batch in batches:
        out = []
        for own, turn, dated, role, text, fault, edits in batch.itertuples(index=False):
            if own != key:
                while state not in _ENDS:
                    state = _NEXT[state]
                    out.append(added())
                key, state = own, START
            while (edit := _LETTERS[edits >> 2 * state & 3]) == "I":
                state = _NEXT[state]
                out.append(added())
            new = None
            if edit == "K":
                state, new = _KEEPS[role[:1]][state], role
            elif edit == "R":
                state = _NEXT[state]
                new = _ROLE[state]
            out.append((own, edit, turn, dated, role, text, fault, new))
        yield pd.DataFrame(out, columns=_names(REPAIRED))
    out = []
    while state not in _ENDS:
        state = _NEXT[state]
        out.append(added())
    if out:
        yield pd.DataFrame(out, columns=_names(REPAIRED))


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits that make each conversation ``(s?(ua)+)?``, one row of ``REPAIRED`` each.

    ``turns`` has ``conv_id, turn, role, text``; rows are taken by turn (nulls first), equal turns by role and text.
    A turn may be kept (K), given the role user or assistant (R), deleted (D, the only edit of blank and
    duplicate turns), or an empty user or assistant turn inserted (I). Ties go to the least
    text of edits. Rows come conversation by conversation, in order; ``new_role`` is null for deleted turns,
    ``role`` for inserted ones, which have no number (``dated`` false).

    One shuffle, by conversation. Turns are sorted last first and the cost of each state is carried from
    batch to batch; each turn leaves with its best edit for every state, in eight bits. They are then
    sorted first to last and the edits followed. The sorts spill, so of a giant conversation only
    a batch is in memory, and the tasks of a lost executor start again from the shuffle.

    Nulls in role and text count as one space, a null turn comes first, a null ``conv_id`` is a
    conversation of its own. Repeated rows are duplicates. Texts may have any length. An empty table
    gives no rows. Further columns are ignored.
    """
    found = faulty(turns.select("conv_id", "turn", "role", "text"))
    copy = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # behind the row that it repeats
    order = ["dated", "turn", "role", "text", copy]
    later = found.sortWithinPartitions("conv_key", *[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    chosen = later.mapInPandas(_backward, TURNS + ", edits smallint")
    return chosen.sortWithinPartitions("conv_key", *order).mapInPandas(_forward, REPAIRED)


class _Totals:
    """What is known of one conversation so far: a few numbers, a hash, and a byte for each edit."""

    def __init__(self, key: str):
        self.key, self.edits, self.hash, self.kept = key, bytearray(), hashlib.sha256(), 0
        self.low = self.high = self.before = None
        self.distinct = self.cost = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, edit, turn, dated, role, text, fault, new_role) -> None:
        self.edits += edit.encode()
        self.cost += COSTS[edit] + (CUT if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if dated and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.distinct = turn, self.distinct + 1
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
        if edit != "D":
            self.hash.update(f"{chr(10) if self.kept else ''}{new_role}:{text}".encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        faults = self.faults.values()
        return self.key, gaps, *faults, self.illegal, self.cost, self.edits.decode(), self.hash.hexdigest()


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals = None
    for batch in batches:
        out = []
        for own, *rest in batch[_names(REPAIRED)].itertuples(index=False):
            edit, turn, dated, role, text, fault, new_role = rest
            if totals is None or own != totals.key:
                if totals is not None:
                    out.append(totals.row())
                totals = _Totals(own)
            totals.add(edit, turn, dated, role, text, fault or None, new_role)
        if out:
            yield pd.DataFrame(out, columns=_names(REPORT))
    if totals is not None:
        yield pd.DataFrame([totals.row()], columns=_names(REPORT))


def reports(repaired: DataFrame) -> DataFrame:
    """One row of ``REPORT`` for each conversation, from the rows of ``repair`` as they come.

    ``gaps`` counts missing numbers, ``illegal`` neighbours among the turns as they were; the hash is of the lines
    ``role:text`` that remain. A hash over a conversation is a chain, so one task reads
    a conversation however long it is, in batches; it keeps one byte for each edit.
    """
    return repaired.mapInPandas(_summed, REPORT)


def repaired_conversations(turns: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Reports by ``conv_id``; conversations of ``of`` without turns have zeros and the hash of nothing."""
    kind = dict(turns.dtypes)["conv_id"]
    found = reports(repair(turns))
    if of is not None:
        known = of.select(key_of(F.col("conv_id")).alias("conv_key")).distinct()
        found = known.join(found, "conv_key", "left")
    values = [
        F.coalesce(name, F.sha2(F.lit(b""), 256) if name == "repaired_sha256" else F.lit("" if name == "audit" else 0)).alias(name)
        for name in _names(REPORT)[1:]
    ]
    return found.select(id_of(F.col("conv_key"), kind).alias("conv_id"), *values)
