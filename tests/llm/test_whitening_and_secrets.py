"""Embedding whitening against numpy and exact integers; the secret ledger against plain patterns, over runs and rule versions."""

import dataclasses
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest

from driftlens.llm import secret_ledger, whitening
from driftlens.llm.secret_ledger import Ledger

SF = "/root/testdata/sf0.001"


def exact(rows):
    """vec_id -> deviation, quantised matrix, sums."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [v for _, v in kept]
    sums = [sum(c) for c in zip(*x, strict=True)]
    return [i for i, _ in kept], x, sums, [sum((len(x) * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]


def same_as_numpy(got, rows, number):
    ids, x, sums, dev = exact(rows)
    centre = np.array([[c - s / len(x) for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centre.T @ centre / len(x)
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1][:number], columns[:, ::-1][:, :number]
    want = centre @ columns / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(ids) and len(got) == len(ids) * number
    made = np.array([[by[i][k + 1]["whitened"] for k in range(number)] for i in ids])
    sign = np.sign((made * want).sum(0))
    assert np.abs(made * sign - want).max() < 1e-8
    assert [by[i][1]["deviation"] for i in ids] == dev and {r["n"] for r in got} == {len(x)}
    assert np.allclose([by[ids[0]][k + 1]["explained"] for k in range(number)], values / np.trace(cov), rtol=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


@pytest.mark.parametrize("dims", [1, 3, 8, 21])
def test_whitening_equals_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    odd = [(900, None), (901, [None] + [0.5] * (dims - 1)), (902, [float("nan")] + [0.5] * (dims - 1)), (903, [0.5] * (dims - 1) + [float("-inf")])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)
    for c in ("x", "v", "d", "keep_0", "n", "at", "tile", "component"):
        d = d.selectExpr("*", f"'clash' AS `{c}`")
    same_as_numpy(whitening.whiten(d, whitening.fit(d), ["vec_id"]).collect(), rows, min(8, dims))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        none = spark.createDataFrame(rows, schema)
        assert whitening.whiten(none, whitening.fit(none), ["vec_id"]).count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0])], schema)
    got = whitening.whiten(one, whitening.fit(one), ["vec_id"]).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got] == [(None, 1, 1, 0, None, None), (None, 2, 1, 0, None, None)]
    # A constant and a repeated dimension: one component; the vector of another length goes; equal rows stay.
    flat = spark.createDataFrame([(i % 4, [1.0, float(i % 4), float(i % 4)]) for i in range(8)] + [(9, [1.0])], schema)
    got = whitening.whiten(flat, whitening.fit(flat), ["vec_id"]).collect()
    assert len(got) == 24 and {r["component"] for r in got if r["whitened"] is not None} == {1} and max(r["identity_error"] for r in got) < 1e-12
    # Squares beyond 64 bits, and values far from zero.
    wide = spark.createDataFrame([(i, [1e12 * i, 3.0 * i * i]) for i in range(5)], schema)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(wide, whitening.fit(wide), ["vec_id"]).collect()}
    ids, _, _, dev = exact([(i, [1e12 * i, 3.0 * i * i]) for i in range(5)])
    assert got == {i: v if v < 1 << 63 else None for i, v in zip(ids, dev, strict=True)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_as_numpy(whitening.op11_embedding_whitening(spark, SF).collect(), rows, 8)


def base_spans(text):
    """The contract's words."""
    out = []
    for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


BITS = [
    "password", "PassWd", "secret", "ToKeN", "api_key", "apikey", "paſsword", "toKen", '"', "'", " ", "  ", ":", "=", " = ", "abc123", "x", "/+_.=-", "AKIA", "ABCDEFGH12345678", "akia", "deadbeef" * 2, "0123456789abcdef", "F", "é", "😀", "\n", "zz",
    "ghp_" + "a1" * 18, "eyJhbGciOi.eyJzdWIiOi.abcdefghi", "https://u:pw@h", "-----BEGIN RSA PRIVATE KEY-----\nMII=\n-----END RSA PRIVATE KEY-----",
]


def made_up(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)] + [None, "", "token: " + "a" * 200_000, "f" * 100_000]


def test_base_spans_equal_patterns(spark):
    texts = made_up(1500)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in ("blob", "todo", "spans", "done", "keep_0", "name"):
        d = d.selectExpr("*", f"'clash' AS `{c}`")
    folder = secret_ledger.shared_dir(spark) + "/ledger-base"
    got = {r["doc_id"]: r for r in secret_ledger.scanned(Ledger(spark, folder), d).collect()}
    assert len(got) == len(texts)
    more = 0
    for i, t in enumerate(texts):
        base, spans = base_spans(t), [s for s in got[i]["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == base
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        for s in spans:
            k, a, b = s.split(":")
            assert (t or "")[int(a) : int(b)]
            more += k in ("forge", "bearer", "login", "private")
    assert more > 100
    assert not any(s["spans"] for s in secret_ledger.scanned(Ledger(spark, folder + "2"), spark.createDataFrame([(1, "clean words, a token of thanks: no."), (2, "https://host/a@b")], "doc_id long, text string")).collect())


def counted(spark, run):
    return {(r["blob"], rule) for r in spark.read.parquet(run).collect() for rule in r["rules"]}


def test_ledger_scans_unseen_pairs_only(spark):
    folder = secret_ledger.shared_dir(spark) + "/ledger-runs"
    versions = [("a", 1, "token = abcdef1"), ("b", 1, "token = abcdef1"), ("a", 2, "nothing"), ("c", 1, None)]
    d = lambda rows: spark.createDataFrame(rows, "path string, version long, text string")
    ledger = Ledger(spark, folder)
    assert ledger.findings().count() == 0
    first = counted(spark, ledger.update(d(versions)))
    assert len(first) == 3 * len(secret_ledger.RULES)  # copies are one blob
    assert counted(spark, ledger.update(d(versions))) == set()
    later = [*versions, ("a", 3, "f" * 30), ("d", 1, "nothing")]
    assert len(counted(spark, ledger.update(d(later)))) == len(secret_ledger.RULES)
    found = {(r["path"], r["version"]): secret_names(r) for r in ledger.join_back(d(later), ["path", "version"]).collect()}
    assert found == {("a", 1): ["assign:0:15"], ("b", 1): ["assign:0:15"], ("a", 2): [], ("c", 1): [], ("a", 3): ["hex:0:30"], ("d", 1): []}
    # A run that was broken off isn't read.
    os.makedirs(folder.removeprefix("file://") + "/run-broken")
    assert len(ledger.runs()) == 3
    # A rule's new version is scanned alone, and its former findings are gone.
    changed = tuple(dataclasses.replace(r, least=40, version=2) if r.name == "hex" else r for r in secret_ledger.RULES)
    newer = Ledger(spark, folder, changed)
    assert {rule for _, rule in counted(spark, newer.update(d(later)))} == {"hex@2"}
    found = {r["path"]: secret_names(r) for r in newer.join_back(d(later).filter("version <> 2"), ["path", "version"]).collect() if r["version"] != 1}
    assert found == {"a": []}
    assert {r["path"]: secret_names(r) for r in newer.join_back(d(later).filter("version = 1"), ["path", "version"]).collect()}["b"] == ["assign:0:15"]
    with pytest.raises(ValueError):
        Ledger(spark, folder, (secret_ledger.BASE[0],) * 2)
    none = d([])
    assert secret_ledger.scanned(Ledger(spark, folder + "-none"), none, "path").count() == 0


def secret_names(row):
    return [f"{s['name']}:{s['at']}:{s['end']}" for s in row["spans"]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_secret_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = secret_ledger.op13_secret_scan(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(",".join(base_spans(texts[r["doc_id"]])).encode()).hexdigest()
