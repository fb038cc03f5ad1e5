"""Conversation repair against a plain search for the cheapest, then least edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerfold.llm import repair
from ledgerfold.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, fault string, pos long, kind long"
SPACE = " \t\n\x0b\x0c\r"
COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def report(rows):
    """The contract read row by row, with a table over all turns and states that keeps whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def spread(table):
        for _ in range(3):
            for state, (cost, edits, lines) in list(table.items()):
                to = after[state]
                new = (cost + 2, edits + "I", [*lines, names[to] + ":"])
                if to not in table or new[:2] < table[to][:2]:
                    table[to] = new
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def put(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, edits, lines) in spread(best).items():
            put(state, (cost + 3, edits + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late, to = int(fault == "truncated"), after[state]
            put(to, (cost + 2 + late, edits + "R", [*lines, f"{names[to]}:{text}"]))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                put(role[:1], (cost + late, edits + "K", [*lines, f"{role}:{text}"]))
        best = new
    cost, audit, lines = min(v for s, v in spread(best).items() if s in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows):
    left = damage(rows)
    return {conv: report([r for r in left if r[0] == conv]) for conv in {r[0] for r in rows}}


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLS) for r in df.select("conv_id", *COLS).collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def wild(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Well then!", "", " \n", "cut off here", "Why?", "é ß.", "Yes. \t", "x" * 3000 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant", None]
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts)))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_wild_conversations(spark, block):
    rows = wild(5, 60, 14)
    df = table(spark, rows)
    assert got(repair.repair_conversations(repair.damaged(df), df, block)) == brute(rows)


def test_given_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_repair"](spark, data)) == brute(rows)


def test_one_conversation_over_many_blocks(spark):
    """Several levels of blocks, equal rows thousands of times, and the same result however rows and blocks are cut."""
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"t{i}.", f"t{i}", "same.", ""])) for i in range(600)]
    rows += [(7, 601, "user", "again and again.")] * 500 + [(7, 602, "user", " ")] * 300 + [(8, 1, "user", "Hi.")]
    df = table(spark, rows)
    want = brute(rows)
    for block, parts in ((4, 3), (64, 9), (repair.BLOCK, 1)):
        assert got(repair.repair_conversations(repair.damaged(df.repartition(parts)), df, block)) == want


def test_empty_and_all_dropped(spark):
    assert repair.repair_conversations(table(spark, [])).collect() == []
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = table(spark, [(dropped, 0, "user", "gone.")])
    assert got(repair.repair_conversations(repair.damaged(df), df)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_crossings_of_blocks_equal_those_of_turns():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, repair.CLASSES, 500)
    whole = repair.crossings(np.array([0, 500]), repair.COSTS[kinds], repair.RANKS[kinds], np.array([repair.START]), np.array([repair.FINAL]))
    starts = np.array([0, 7, 100, 101, 340, 500])
    cost, rank = repair.summaries(starts, repair.COSTS[kinds], repair.RANKS[kinds])
    coarse = repair.crossings(np.array([0, 5]), cost, rank, np.array([repair.START]), np.array([repair.FINAL]))
    assert (coarse == whole[starts]).all()
