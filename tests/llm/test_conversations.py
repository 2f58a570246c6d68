"""Repair of conversations against a plain fold over (cost, audit)."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from twintext.llm import conversations
from twintext.llm.conversations import damaged, repair

SPACES = " \t\n\x0b\x0c\r"
NEXT = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def inserted(states):
    states = dict(states)
    for _ in range(3):
        for state, (cost, audit, out) in list(states.items()):
            for role in ("user", "assistant"):
                to = NEXT.get((state, role[0]))
                if to and (to not in states or (cost + 3, audit + "I") < states[to][:2]):
                    states[to] = (cost + 3, audit + "I", [*out, role + ":"])
    return states


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, count, states = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, {"n": (0, "", [])}
    for _, role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        after = {}

        def put(state, value, after=after):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for state, (cost, audit, out) in inserted(states).items():
            put(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault else 0
            if (to := NEXT.get((state, role[:1]))):
                put(to, (cost + late, audit + "K", [*out, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if (to := NEXT.get((state, new[0]))):
                    put(to, (cost + late + 3, audit + "R", [*out, f"{new}:{text}"]))
        states = after
    cost, audit, out = min((v for k, v in inserted(states).items() if k in "na"), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(df, **options):
    found = repair(df, **options)
    sums = {r[0]: tuple(r)[1:] for r in found.summary().collect()}
    shas = {r[0]: r[1] for r in found.digests().collect()}
    return {k: (*v, shas.get(k, hashlib.sha256(b"").hexdigest())) for k, v in sums.items()}


def check(spark, rows):
    groups = {}
    for conv, *turn in rows:
        groups.setdefault(conv, []).append(tuple(turn))
    got = repaired(spark.createDataFrame(rows, SCHEMA))
    assert got == {k: plain(v) for k, v in groups.items()}


def test_random_conversations_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "sage"], ["Good day.", "Why", "", " \n", "No!", None, "Sure? ", "a.", "b."]
    rows = [(c if c else None, rng.choice([None, 1, 2, 3, 7, 9]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    check(spark, rows)


@pytest.mark.parametrize("block", [3, 512])
def test_long_conversation_spans_blocks_and_partitions(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_TURNS", block)
    monkeypatch.setattr(conversations, "CHUNK", 50)
    rng = random.Random(block)
    rows = [(1, i // 2 * 3, rng.choice(["user", "assistant", "system"]), rng.choice([f"line {i}.", f"line {i}", "again.", ""])) for i in range(400)]
    rows += [(c, t, r, f"{r} {t}.") for c in range(2, 40) for t, r in enumerate(("user", "assistant", "user"))]
    check(spark, rows)


def test_repaired_turns_are_a_dialogue(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye")]
    found = repair(spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("edit", F.lit("y")))
    assert found.summary().collect()[0]["audit"] == plain([r[1:] for r in rows])[6]
    turns = [(r.role, r.text) for r in found.turns().orderBy("part", "line", "item").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)) and turns[0] == ("system", "Be brief.")


def test_empty_table(spark):
    found = repair(spark.createDataFrame([], SCHEMA))
    assert found.summary().collect() == [] and found.turns().collect() == [] and found.digests().collect() == []


def test_damage_by_checksum(spark):
    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    got = sorted((r.conv_id, r.turn, r.role, r.text, r.copies) for r in damaged(spark.createDataFrame(rows, SCHEMA)).where("conv_id is not null").collect())
    want = []
    for conv, turn, role, text in rows[:-1]:
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if h:
            want.append((conv, turn, "user" if h == 4 else role, "" if h == 1 else "One Two" if h == 2 else text, 2 if h == 3 else 1))
    assert got == sorted(want)
