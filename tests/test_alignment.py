"""Alignments against the standard library's, which defines the same blocks in quadratic time."""

import difflib
import random
import time

import pytest

from driftlens.operators import alignment


def standard(a, b):
    found = difflib.SequenceMatcher(None, a, b, False).get_opcodes()
    return [{"op": op, "i1": i1, "i2": i2, "j1": j1, "j2": j2} for op, i1, i2, j1, j2 in found if op != "equal"]


def pairs():
    rng = random.Random(5)
    for k in (2, 3, 10, 1000):
        for _ in range(60):
            a = [rng.randrange(k) for _ in range(rng.randrange(150))]
            yield a, [rng.randrange(k) for _ in range(rng.randrange(150))]
            b = list(a)
            for _ in range(rng.randrange(12)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(4)] = [rng.randrange(k) for _ in range(rng.randrange(4))]
            yield a, b
    yield list("ab" * 200), list("ba" * 190)
    yield list("a" * 300), list("a" * 120)
    yield [*range(300)], [x if x % 2 else -x for x in range(300)]
    yield [*range(300)], [*range(299, -1, -1)]
    yield [], [1]
    yield [None, "x"], ["x", None]


def test_edits_equal_the_standard_ones(monkeypatch):
    for small in (0, 64, 4096):
        monkeypatch.setattr(alignment, "SMALL", small)
        for a, b in pairs():
            found = alignment.edits(a, b)
            assert found == standard(a, b), (a, b)
            assert alignment.applied(a, b, found) == b
    assert alignment.edits(None, None) == []


@pytest.mark.parametrize("kind", ["equal", "alternate", "edited", "reversed"])
def test_long_sequences_take_seconds(kind):
    n = 100_000
    a = ["x"] * n if kind == "equal" else [str(i) for i in range(n)]
    b = {"equal": ["x"] * (n - 7), "alternate": [x if i % 2 else "new" for i, x in enumerate(a)], "edited": [x for i, x in enumerate(a) if i % 97], "reversed": a[::-1]}[kind]
    began = time.monotonic()
    found = alignment.edits(a, b)
    assert time.monotonic() - began < 20
    assert alignment.applied(a, b, found) == b
