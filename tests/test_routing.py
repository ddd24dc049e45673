"""Routes by an index of trigrams against a test of all pairs; trees against a stack."""

import random

import pytest

from driftlens.operators import routing, snapshot

CHANGES = "category string, section string, title string, url string, key string"
ROUTES = "name string, recipients array<string>, sections array<string>, titles array<string>, extensions array<string>, include_page_text boolean"


def made_up(rng, n, m):
    words = ["Alpha", "beta", "ß", "Straße", "x", "yz", "Plans", " / en", "İ", "gamma ray", "Σίσυφος"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
    changes = [("documents_added", text() if rng.random() < 0.9 else None, text(), f"https://h/{i}{rng.choice(['.pdf', '.TXT', ''])}", f"k{i}") for i in range(n)]
    changes += [("page_text_changed", None, None, None, None), changes[0]]
    values = lambda: [rng.choice([*words, "ALPHA B", "STRASSE", "nothing", " ", "et"]) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    routes = [(f"r{i}", [f"{i}@x.y", "all@x.y"], values(), values(), rng.choice([[], [], ["pdf"], [".txt", "TXT"]]), rng.random() < 0.3) for i in range(m)]
    return changes, routes


def wanted(changes, routes):
    tidy = lambda v: [x for x in (" ".join(s.split()).casefold() for s in v) if x]
    out = []
    for c in changes:
        for r in routes:
            if c[0] == "page_text_changed":
                ok = r[5]
            else:
                suffix = "." + c[3].rpartition(".")[2].lower() if "." in c[3].rpartition("/")[2] else ""
                ok = all(not tidy(values) or any(v in (own or "").casefold() for v in tidy(values)) for own, values in ((c[1], r[2]), (c[2], r[3])))
                ok &= not r[4] or suffix in ["." + e.lstrip(".").lower() for e in r[4]]
            if ok:
                out.append((r[0], c[0], c[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [256, 0])
def test_routes_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(routing, "FEW", few)
    changes, routes = made_up(random.Random(few), 120, 60)
    c, r = spark.createDataFrame(changes, CHANGES), spark.createDataFrame(routes, ROUTES)
    want = wanted(changes, routes)
    assert sorted(((x["name"], x["category"], x["key"]) for x in routing.routed(c, r).collect()), key=str) == want
    got = {x["label"]: (x["recipients"], x["n"]) for x in routing.batches(c, r, ["all@x.y"]).collect()}
    assert got.pop("All monitored changes") == ("all@x.y", len(changes))
    assert got == {n: (f"{n[1:]}@x.y", sum(w[0] == n for w in want)) for n in {w[0] for w in want}}
    assert routing.routed(c.limit(0), r).count() == 0 and routing.routed(c, r.limit(0)).count() == 0


def test_plan_has_no_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(routing, "FEW", 0)
    changes, routes = made_up(random.Random(1), 50, 20)
    out = routing.routed(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(routes, ROUTES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_trees_equal_a_stack(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["g", "g", "g", "h", None]), pos, rng.choice([0, 1, 2, 3, 9]), rng.choice(["a", "b", "", None, "c d"])) for pos in range(400)]
    want, stacks = {}, {}
    for grid, pos, level, name in rows:
        stack = stacks.setdefault(grid, [])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, name))
        want[pos] = " / ".join(n for _, n in stack if n)
    tree = spark.createDataFrame(rows, "grid string, pos int, level int, name string").repartition(9)
    got = {r["pos"]: r["path"] for r in snapshot.flatten_tree(tree, ranges=ranges).collect()}
    assert got == want
