"""Conversation repair against a plain search over all edits of each conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out[conv] += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: sorted(r, key=key) for c, r in out.items()}


def expected(turns):
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    # every sequence of edits, by state, with all that lead to it: (cost, audit, lines)
    at = {"": (0, "", ())}

    def put(to, state, cost, audit, lines):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, lines)

    after = lambda state, initial: initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None

    def inserts(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if after(state, role[0]):
                        put(states, role[0], cost + 2, audit + "I", (*lines, f"{role}:"))
        return states

    for (_, role, text), fault in zip(turns, faults, strict=True):
        to = {}
        for state, (cost, audit, lines) in inserts(at).items():
            put(to, state, cost + 3, audit + "D", lines)
            if fault in ("b", "d"):
                continue
            more = fault == "t"
            if after(state, role[:1]):
                put(to, role[0], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            for other in ("user", "assistant"):
                if after(state, other[0]):
                    put(to, other[0], cost + 2 + more, audit + "R", (*lines, f"{other}:{text}"))
        at = to
    ends = [v for s, v in inserts(at).items() if s in ("", "a")]
    cost, audit, lines = min(ends)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    turns = after_damage(rows)
    return {c: expected(turns.get(c, [])) for c in {r[0] for r in rows}}


def conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Is it?  ", "cut off", "", " \t\n", None, "a.b.c ", f"turn {turn}.", "x" * 300 + "."])
            rows.append((conv if rng.random() < 0.97 else None, turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, role, text))
    return rows


@pytest.mark.parametrize(("block", "hot"), [(512, 4), (3, 1_000_000), (3, 4), (1, 30)])
def test_against_all_edits(spark, block, hot):
    rows = conversations(random.Random(block * 7 + hot), 60, 14)
    rows += [(999, t, ("user", "assistant")[t % 2], f"number {t % 37}{'.' * (t % 3 > 0)}") for t in range(150)]  # a long one
    rows += rows[:5]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(df, block=block, hot=hot).collect()}
    assert got == brute(rows)
    assert len({v[6][:1] for v in got.values()}) >= 4  # all four edits occur


def test_all_rows_dropped_and_empty_table(spark):
    turns = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(5, t, "user", "Hm.") for t in turns], SCHEMA)
    assert [tuple(r) for r in repair.repair_report(df).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(df.limit(0)).collect() == []


def test_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, t, ("user", "assistant")[t % 2], "word " * 200_000 + ".") for t in range(4)] + [(2, t, "assistant", f"{t}?") for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: F.lit("?") for c in "lot key _copy at again fault block rows full n b best audit cost state p _conv _block line".split()})
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(more, block=2).collect()}
    assert got == brute(rows)
