"""Conversation repair against a plain dynamic programme over whole audit strings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from simlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit, repaired rows) over all edits; rows are (role, text, fault)."""
    after = {0: 2, 1: 2, 3: 2, 2: 3}
    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", ())}

    def grow(found):
        for _ in range(3):
            for state, (cost, audit, out) in list(found.items()):
                to, way = after[state], (cost + 3, audit + "I", (*out, ("user" if after[state] == 2 else "assistant", "")))
                if to not in found or way < found[to]:
                    found[to] = way
        return found

    for role, text, fault in rows:
        # inserts before a row are tried from every state apart, so that no equal-cost audit is lost
        ways = []
        for state, way in best.items():
            for s, (cost, audit, out) in grow({state: way}).items():
                ways.append((s, (cost + 4, audit + "D", out)))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    ways.append((after[s], (cost + 3 + more, audit + "R", (*out, ("user" if after[s] == 2 else "assistant", text)))))
                    to = keep.get(role[:1], {}).get(s)
                    if to is not None:
                        ways.append((to, (cost + more, audit + "K", (*out, (role, text)))))
        best = {}
        for s, way in ways:
            if s not in best or way < best[s]:
                best[s] = way
    return min(way for state, start in best.items() for s, way in grow({state: start}).items() if s == 3 or s == 0)


def damaged(rows):
    out = []
    for ident, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (ident, turn, role, text)]
        draw = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        out += [(ident, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def expected(rows):
    out = {}
    spoilt = damaged(rows)
    for ident in {r[0] for r in rows}:
        own = sorted((r for r in spoilt if r[0] == ident), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(repair.SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        firsts = [r[2][:1] for r in own]
        cost, audit, left = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        out[ident] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def answers(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *extra)
    return {r[0]: tuple(r[1:]) for r in repair.digests(repair.damage(frame)).collect()}


TEXTS = ["Fine.", "Yes!", "cut off", "", " \n", None, "Fine.", "é?", "😀", "a.\x0b", "x "]
ROLES = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]


def random_rows(seed, conversations, most):
    draw = random.Random(seed)
    return [(c, draw.choice([None, draw.randrange(most)]) if draw.random() < 0.2 else t, draw.choice(ROLES), draw.choice(TEXTS)) for c in [None, -5, *range(conversations)] for t in range(draw.randrange(1, most))]


def test_against_all_edits(spark):
    rows = random_rows(1, 150, 9)
    assert answers(spark, rows, ("'x' as pos", "'y' as code", "1 as node")) == expected(rows)


def test_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(repair, "NODE_BITS", 1)
    rows = random_rows(2, 12, 70)
    assert answers(spark, rows) == expected(rows)


def test_long_texts_and_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", ("word " * 3000 if t % 50 == 7 else "said ") + str(t) + "." * (t % 3)) for t in range(600)]
    rows += [(2, 0, "user", "z" * 3_000_000), (2, 1, "assistant", " " * 2_000_000)]
    assert answers(spark, rows) == expected(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert answers(spark, [(gone, 0, "user", "x")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.digests(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_extreme_turns(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    got = repair.digests(spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(False))).first()
    assert got["gaps"] is None and got["audit"] == "KK"


@pytest.mark.parametrize("seed", range(3))
def test_halves_and_whole_agree(seed):
    draw = random.Random(seed)
    names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    for _ in range(150):
        codes = [draw.randrange(16) for _ in range(draw.randrange(0, 12))]
        letters, states, tail = repair.edits_of(codes)
        rows = [("suax"[c % 4], "t", names[c // 4]) for c in codes]
        cost, audit, left = cheapest(rows)
        assert "".join(letters) + tail == audit
        got = [r for i, c in enumerate(codes) for r in repair.outcome(letters[i] + (tail if i == len(codes) - 1 else ""), states[i], c % 4, "suax"[c % 4], "t")]
        assert [r[1:] for r in got] == list(left)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c.")]
    got = repair.repaired(spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(False))).orderBy("conv_id", "pos", "part").collect()
    assert [(r["conv_id"], r["op"], r["role"], r["text"]) for r in got] == [(1, "K", "user", "a."), (1, "R", "assistant", "b."), (2, "I", "user", ""), (2, "K", "assistant", "c.")]
