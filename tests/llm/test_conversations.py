"""Conversation repair against a search over all edits, and chunks of long conversations against whole ones."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from premia.llm import conversations
from premia.llm.queries import QUERIES

WORDS = ["Good day.", "What now?", "no end", "", " \t\n", "Yes!  ", "Fine. "]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "ux"]


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns, most=3):
    """The cheapest audit by trying the insertions, deletions and roles of every prefix, best first by cost and audit."""

    faults = faults_of(turns)
    ways = {"S": (0, "")}
    step = {("S", "u"): "A", ("P", "u"): "A", ("E", "u"): "A", ("A", "a"): "E", ("S", "s"): "P"}

    def inserted(ways):
        out = dict(ways)
        for state, (cost, audit) in ways.items():
            for n in range(1, most + 1):
                for roles in itertools.product("ua", repeat=n):
                    now = state
                    for role in roles:
                        now = step.get((now, role)) if now else None
                    if now and (cost + 3 * n, audit + "I" * n) < out.get(now, (10**9, "")):
                        out[now] = cost + 3 * n, audit + "I" * n
        return out

    for (role, _), fault in zip(turns, faults):
        following = {}
        for state, (cost, audit) in inserted(ways).items():
            options = [(state, cost + 4, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                options += [(step.get((state, role[:1])), cost + more, audit + "K")]
                options += [(step.get((state, new)), cost + 3 + more, audit + "R") for new in "ua"]
            for now, *way in options:
                if now and tuple(way) < following.get(now, (10**9, "")):
                    following[now] = tuple(way)
        ways = following
    return min(way for state, way in inserted(ways).items() if state in "SE")


def mended(turns, audit):
    place, said, out = 0, "a", []
    for edit in audit:
        role, text = turns[place] if edit != "I" else ("", "")
        place += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if said == "u" else "user"
        said = role[:1]
        out.append((role, text))
    return out


def by_conversation(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.conv_id, []).append(row)
    return {k: sorted(rows, key=lambda row: row.step) for k, rows in found.items()}


def random_turns(rng, n):
    return [(rng.choice(ROLES[: rng.choice([2, 3, 8])]), rng.choice(WORDS + [f"text {rng.randrange(9)}.", f"t {rng.randrange(999)}."] * 4)) for _ in range(n)]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    found = {i: random_turns(rng, rng.randrange(1, 9)) for i in range(300)}
    found |= {1000 + i: random_turns(rng, rng.randrange(20, 60)) for i in range(20)}
    return found


@pytest.fixture(scope="module")
def table(spark, cases):
    rows = [(i, k, role, text, 1) for i, turns in cases.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, TEXT int")


@pytest.mark.parametrize("chunk", [512, 3])
def test_audits_are_the_cheapest(cases, table, chunk):
    got = by_conversation(conversations.repair(table, chunk))
    assert set(got) == set(cases)
    for i, turns in cases.items():
        rows = got[i]
        cost, audit = cheapest(turns)
        assert ("".join(row.edit for row in rows), sum(row.cost for row in rows)) == (audit, cost), (i, turns)
        assert [row.step for row in rows] == list(range(len(rows)))
        assert [(row.role, row.text) for row in rows if row.edit != "D"] == mended(turns, audit)
        assert [row.fault for row in rows if row.edit != "I"] == faults_of(turns)


@pytest.mark.parametrize("chunk", [512, 7])
def test_a_very_long_conversation(spark, chunk):
    """Roles that two ways of equal chance compete for until the very end; and one with dropped turns."""

    rng = random.Random(8)
    odd = [("tool", f"turn {i}.") for i in range(1501)]
    gone = [(("user", "assistant")[i % 2], f"turn {i}" + rng.choice("...,")) for i in range(1500) if rng.random() > 0.05]
    rows = [(c, i, role, text) for c, turns in ((1, odd), (2, gone)) for i, (role, text) in enumerate(turns)]
    got = by_conversation(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk))
    for c, turns in ((1, odd), (2, gone)):
        assert "".join(row.edit for row in got[c]) == cheapest(turns, 2)[1]


def test_summary(cases, table):
    got = {row.conv_id: row for row in conversations.summarize(conversations.repair(table)).collect()}
    for i, turns in cases.items():
        cost, audit = cheapest(turns)
        initials = [role[:1] for role, _ in turns]
        row = got[i]
        assert (row.cost, row.audit, row.gaps) == (cost, audit, 0)
        assert row.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        body = "\n".join(f"{role}:{text}" for role, text in mended(turns, audit))
        assert row.repaired_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_nulls_ties_repeats_and_empty_tables(spark, tmp_path):
    schema = "conv_id string, turn long, role string, text string, TURN int, step int"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [
        (None, None, None, None, 1, 1), (None, 4, "user", "Hm.", 1, 1), (None, 4, "user", "Hm.", 1, 1), (None, 9, "assistant", "So.", 1, 1),
        ("x", None, "system", "Be good.", 1, 1), ("x", None, "system", "Be good.", 1, 1), ("x", 2, "assistant", "ü" * 3_000_000 + ".", 1, 1), ("x", 1, "user", "?", 1, 1),
    ]
    got = by_conversation(conversations.repair(spark.createDataFrame(rows, schema)))
    assert [(row.edit, row.fault, row.turn) for row in got[None]] == [("D", "blank", None), ("K", None, 4), ("D", "duplicate", 4), ("K", None, 9)]
    assert [(row.edit, row.role, row.turn) for row in got["x"]] == [("K", "system", None), ("D", "system", None), ("K", "user", 1), ("K", "assistant", 2)]
    sums = {row.conv_id: row for row in conversations.summarize(conversations.repair(spark.createDataFrame(rows, schema))).collect()}
    assert sums[None].gaps == 9 - 4 + 1 - 2 and sums["x"].gaps == 0
    frame = spark.createDataFrame(rows[:4], schema).drop("TURN").toDF("conv_id", "role", "text", "step").withColumn("turn", F.lit(1)).withColumn("conv_id", F.lit(None).cast("long"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 1
