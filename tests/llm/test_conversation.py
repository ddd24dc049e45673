"""Conversation repair against a letter-by-letter search, for whole conversations and for blocks."""

import hashlib
import os
import random
import re
import zlib
from functools import lru_cache

import pytest

from driftlens.llm import conversation

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    """(conversation's id, rows) in order, by the query's own words."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        how = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        own += [(turn, role, text)] * (2 if how == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def brute(rows):
    """The result's columns by search over single letters."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def legal(made):
        return re.fullmatch("(s?(ua)*)?", made) or re.fullmatch("s?(ua)*u", made)

    @lru_cache(None)
    def best(i, last):
        """(cost, letters, repaired) from row i on; last: the two last initials, enough to go on."""
        if i == len(rows) and last in ("", "a"):
            found = [(0, "", ())]
        else:
            found = []
        room = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        options = []
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 if faults[i] == "truncated" else 0
            options.append((4, "D", i + 1, last, None))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in room:
                    options.append((extra, "K", i + 1, role[:1], (role, text)))
                options += [(extra + 3, "R", i + 1, r[0], (r, text)) for r in ("user", "assistant") if r[0] in room]
        for cost, letter, j, now, made in options:
            c, rest, text = best(j, now)
            found.append((cost + c, letter + rest, (*([made] if made else []), *text)))
        for r in ("user", "assistant"):  # an insertion, then something that takes a row or ends
            if r[0] in room:
                c, rest, text = after_insert(i, r[0], 1)
                found.append((3 + c, "I" + rest, ((r, ""), *text)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    @lru_cache(None)
    def after_insert(i, last, depth):
        found = [(0, "", ())] if i == len(rows) and last == "a" else []
        room = {"s": "u", "u": "a", "a": "u"}[last]
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 if faults[i] == "truncated" else 0
            c, rest, made = best(i + 1, last)
            found.append((4 + c, "D" + rest, made))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in room:
                    c, rest, made = best(i + 1, role[:1])
                    found.append((extra + c, "K" + rest, ((role, text), *made)))
                for r in ("user", "assistant"):
                    if r[0] in room:
                        c, rest, made = best(i + 1, r[0])
                        found.append((extra + 3 + c, "R" + rest, ((r, text), *made)))
        if depth < 3:
            for r in ("user", "assistant"):
                if r[0] in room:
                    c, rest, made = after_insert(i, r[0], depth + 1)
                    found.append((3 + c, "I" + rest, ((r, ""), *made)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    cost, audit, made = best(0, "")
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


def made_up(rng, convs, most):
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "User", None])
            text = rng.choice(["hm.", "so", "yes!", " \t", "", None, "no? ", "é ü\n.", "hm.", "why\x1c", "long " * 500 + "."])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("block_turns", [1024, 1, 3, 7])
def test_audits_equal_search(spark, block_turns):
    rows = made_up(random.Random(block_turns), 60, 14)
    turns = conversation.damaged(spark.createDataFrame(rows, TURNS)).repartition(5)
    got = {r["conv_id"]: r.asDict() for r in conversation.audits(turns, here_col="here", block_turns=block_turns).collect()}
    want = damage(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == brute(own), (conv, own)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", "so."), (1, 2, "tool", "yes."), (1, 3, "user", "yes."), (1, 4, "user", " ")]
    for block_turns in (1024, 2):
        got = sorted(conversation.repair(spark.createDataFrame(rows, TURNS), block_turns=block_turns).collect(), key=lambda r: r["turn"])
        audit = "".join(r["edit"] for r in got) + "I" * len(got[-1]["appended"] or [])
        assert audit == brute(damage_free(rows))["audit"]
        kept = [x for r in got for x in (r["inserted"], r["new_role"], *(r["appended"] or [])) if x]
        assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
        assert got[-1]["fault"] == "blank" and got[-1]["new_role"] is None


def damage_free(rows):
    return [r[1:] for r in rows]


def test_odd_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation.audits(none).count() == 0 and conversation.repair(none).count() == 0
    # Equal rows of one conversation over many blocks, and extra columns whose names clash.
    rows = [(7, 0, "user", "a.")] * 40 + [(7, 1, "assistant", "b.")]
    d = spark.createDataFrame(rows, TURNS)
    for c in ("conv", "c", "b", "block", "at", "end", "m", "first", "digest", "salt", "range"):
        d = d.selectExpr("*", f"'x' AS `{c}`")
    for block_turns in (1024, 4):
        got = conversation.audits(d, block_turns=block_turns).collect()
        assert len(got) == 1 and got[0]["duplicate"] == 39 and got[0]["audit"] == "K" + "D" * 39 + "K" and got[0]["cost"] == 156
    # A conversation of which nothing is left.
    gone = spark.createDataFrame([(1, 0, "user", "a.", False)] * 9, TURNS + ", here boolean")
    for block_turns in (1024, 4):
        r = conversation.audits(gone, here_col="here", block_turns=block_turns).first()
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in conversation.op12_conversation_repair(spark, SF).collect()}
    want = damage(rows)
    assert set(got) == set(want)
    for conv, own in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == brute(own)
