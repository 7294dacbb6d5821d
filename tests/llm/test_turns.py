"""Repair of conversations against plain search, and its streaming over batches."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from parapet.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """``(cost, audit, lines)`` by search over all edits; rows are ``(role, text, fault)``."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(at, state, added):
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        if added < 3:
            cost, audit, lines = best(at, after[state], added + 1)
            found.append((cost + 2, "I" + audit, (full[after[state]] + ":", *lines)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            found.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                cost, audit, lines = best(at + 1, after[state], 0)
                found.append((cost + 2 + more, "R" + audit, (f"{full[after[state]]}:{text}", *lines)))
                if role[:1] == after[state] or (state == "" and role[:1] == "s"):
                    cost, audit, lines = best(at + 1, role[:1], 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    for at in range(len(rows), -1, -1):  # from the end, so that calls do not nest
        for state in after:
            best(at, state, 0)
    return best(0, "", 0)


def plain(rows):
    """The report of one conversation from its rows ``(turn, role, text)``."""
    space = " \t\n\x0b\x0c\r"
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        left = text.strip(space)
        fault = None
        if not left:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif left[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, lines = cheapest(tuple(marked))
    faults = Counter(f for *_, f in marked)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, *_ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, conversations=150):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(pick.randrange(9)):
            role = pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"])
            text = pick.choice(["Yes.", "No", "Why?", "  ", "", None, "Go on!  \n", "Ö…", "a.b", "x" * 50_000 + "."])
            rows.append((conv, pick.choice([None, *range(8)]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = reported(turns.repaired_conversations(df))
    wanted = {}
    for conv in {r[0] for r in rows}:
        wanted[conv] = plain([r[1:] for r in rows if r[0] == conv])
    assert found == wanted


def test_damage_and_lost_conversations(spark):
    rows = random_rows(3) + [(10**6 + i, 0, "user", "Hm.") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = hurt(rows)
    damaged = turns.damaged(df)
    assert Counter(map(tuple, damaged.collect())) == Counter(left)
    found = reported(turns.repaired_conversations(damaged, of=df))
    assert found.keys() == {r[0] for r in rows}
    gone = found.keys() - {r[0] for r in left}
    assert gone
    for conv, report in found.items():
        own = [r[1:] for r in left if r[0] == conv]
        assert report == (plain(own) if own else (0, 0, 0, 0, 0, 0, "", NOTHING))


def test_rows_of_the_repair(spark):
    df = spark.createDataFrame([(7, 1, "assistant", "Yes."), (7, 2, "assistant", "Yes."), (7, 5, "user", "Why")], SCHEMA)
    found = [(r["edit"], r["turn"], r["role"], r["new_role"], r["fault"]) for r in turns.repair(df).collect()]
    assert found == [
        ("I", 0, None, "user", None), ("K", 1, "assistant", "assistant", None),
        ("D", 2, "assistant", None, "duplicate"), ("D", 5, "user", None, "truncated"),
    ]


def test_long_conversation_crosses_batches(spark):
    """One conversation of many Arrow batches, whose first edit hangs on its last turn."""
    pick = random.Random(5)
    rows = [(1, i, pick.choice(["user", "assistant"]), f"{i}{pick.choice(['.', '', '?'])}") for i in range(900)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(901)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = reported(turns.repaired_conversations(df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[2][5:7] == (2, "K" * 901 + "I")
    for conv in (1, 2):
        assert found[conv] == plain([r[1:] for r in rows if r[0] == conv])


def test_one_shuffle(spark):
    df = spark.createDataFrame(random_rows(4), SCHEMA)
    plan = turns.reports(turns.repair(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repaired_conversations(turns.damaged(empty), of=empty).collect() == []
    rows = random_rows(6, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 as conv_key", "2 as edit", "3 as _case", "4 as `a.b`", "5 as fault", "6 as cost")
    wanted = reported(turns.repaired_conversations(turns.damaged(df), of=df))
    assert reported(turns.repaired_conversations(turns.damaged(more), of=more)) == wanted
    texts = spark.createDataFrame([("x", 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert reported(turns.repaired_conversations(texts))["x"][6] == "KI"
