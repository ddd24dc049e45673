"""Whole runs: scans assembled, schema upgrades, details, pages, dry runs, deliveries that stop between steps, locks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from driftlens.config import Config
from driftlens.sources.state import Lock
from driftlens.streaming.delivery import Outbox, Spool
from driftlens.streaming.monitor import SCHEMA_VERSION, Monitor, Outcome

UNITS = "struct<kind:string,units:array<struct<pos:int,sheet:string,cell:string,text:string>>,reason:string>"
DOC = f"key string, identity string, url string, title string, section string, sha256 string, pos long, analysis {UNITS}"


def docs(spark, *rows):
    made = [(k, None, f"https://h/{k}.txt", k.upper(), "S", sha, i, ("lines", [(j, None, None, x) for j, x in enumerate(lines)], None)) for i, (k, sha, lines) in enumerate(rows)]
    return spark.createDataFrame(made, DOC)


def page(spark, text):
    return spark.createDataFrame([(text,)], "page_text string")


def test_details_pages_and_dry_runs(spark, tmp_path):
    m = Monitor(spark, f"file://{tmp_path}/m", ["root@x.test"])
    old = {"documents": docs(spark, ("a", "1", ["one", "two"]), ("b", "2", ["x"])), "page": page(spark, "the old words stand")}
    new = {"documents": docs(spark, ("a", "9", ["one", "<three>"]), *((f"n{i}", "5", []) for i in range(1203))), "page": page(spark, "the new words stand")}
    assert m.run(lambda: old, "r0") == "initialised"
    dry = m.run(lambda: new, "d", dry_run=True)
    assert dry == "dry_run" and isinstance(dry, Outcome) and dry.changes.count() == 1206
    assert not os.path.exists(tmp_path / "m/outbox")
    outcome = m.run(lambda: new, "r1")
    assert outcome == "changed" and outcome.changes.count() == 1206
    said = sorted((r["key"], r["detail"]) for r in m.store.read("details").collect())
    assert said == [("", "Changed: old → new"), ("a", "Line(s) 2 changed — Removed: two Added: <three>")]
    html = (tmp_path / "m/reports/changed-r1.html").read_text()
    assert "additional changes are on the pages below" in html and "Changed: old → new" in html and "category=documents_added" in html
    pages = [f.read_text() for f in (tmp_path / "m/reports/changed-r1").rglob("part-*") if f.suffix == ".txt"]
    assert sum(p.count("<tr>") for p in pages) == 1206 and max(p.count("<tr>") for p in pages) <= 1000
    assert sum("Added: &lt;three&gt;" in p for p in pages) == 1
    assert m.status().first()["events"] == 1 and m.run(lambda: new, "r2") == "unchanged"


def test_a_schema_upgrade_is_silent(spark, tmp_path):
    m = Monitor(spark, f"file://{tmp_path}/m", ["root@x.test"])
    old, new = ({"documents": docs(spark, ("a", "1", [])), "page": page(spark, t)} for t in ("t", "u"))
    first = m.baseline(old) | {"header": spark.range(1).select(F.lit(2).alias("schema_version"))}
    m.store.commit(m.store.write(first))
    assert m.run(lambda: new, "r0") == "unchanged"  # version 2 held another page text
    assert m.store.read("header").first()[0] == SCHEMA_VERSION
    assert m.run(lambda: old, "r1") == "changed"
    bare = {k: v for k, v in m.baseline(old).items() if k != "header"}  # a baseline of the first version names none
    m.store.commit(m.store.write(bare))
    more = {"documents": docs(spark, ("a", "2", []), ("b", "1", [])), "page": page(spark, "v")}
    assert [r["category"] for r in m.run(lambda: more, "r2").changes.collect()] == ["documents_modified"]


def test_a_scan_is_assembled(spark, tmp_path):
    c = Config("https://h/page", ["root@x.test"], extra_documents=[{"url": "/extra.txt#x", "title": "Extra"}], dynamic_documents=[{"title": "M", "source_url": "src", "match_host": "h"}])
    m = Monitor.of(spark, f"file://{tmp_path}/m", c)
    links = spark.createDataFrame([("https://h/a.txt", "A", "S", 0)], "url string, title string, section string, pos long")
    found = spark.createDataFrame([("src", "https://h/m.txt", "h", "/m.txt")], "source_url string, url string, host string, path string")

    def scan(shas, failed=(), none=False):
        return {
            "page_links": links, "found_links": found.limit(0) if none else found, "fetched": spark.createDataFrame([(f"https://h/{k}.txt", v) for k, v in shas.items()], "url string, sha256 string"),
            "failures": spark.createDataFrame([(f"https://h/{k}.txt", "down") for k in failed], "url string, error string"),
        }

    assert m.run(lambda: scan({"a": "1", "extra": "2", "m": "3"}), "r0") == "initialised"
    assert {r["key"] for r in m.store.read("documents").collect()} == {"https://h/a.txt", "https://h/extra.txt", "dynamic:M"}
    # What fails is carried and told to the owner, not told as removed.
    m.owner = "owner@x.test"
    assert m.run(lambda: scan({"a": "1"}, ["extra"], none=True), "r1") == "unchanged"
    told = [r for r in m.outbox().collect() if r["label"] == "Document warning"]
    assert len(told) == 1 and told[0]["n"] == 2 and "down" in told[0]["message"]
    out = m.run(lambda: scan({"a": "4", "extra": "2", "m": "3"}), "r2")
    assert [(r["category"], r["key"]) for r in out.changes.collect()] == [("documents_modified", "https://h/a.txt")]


def test_a_narrower_filter_tells_removals(spark, tmp_path):
    c = Config("https://h/", ["root@x.test"])
    both = docs(spark, ("a", "1", []), ("b", "2", []))
    Monitor.of(spark, f"file://{tmp_path}/m", c).run(lambda: both, "r0")
    c.set_filter("titles", ["a"])
    m = Monitor.of(spark, f"file://{tmp_path}/m", c)
    assert [r["key"] for r in m.run(lambda: both, "d", dry_run=True).changes.collect()] == ["b"]
    m.filter_baseline = True
    assert m.run(lambda: both, "d", dry_run=True).changes.count() == 0
    m.filter_baseline = False
    assert m.run(lambda: both, "r1") == "changed" and m.run(lambda: both, "r2") == "unchanged"


class Stop(Exception):
    pass


@pytest.mark.parametrize("stop", ["after the outbox", "while sending", "after sending", "never"])
def test_each_message_is_sent_once(spark, tmp_path, stop):
    root = f"file://{tmp_path}/m"
    box, spool = Outbox(spark, root), Spool(spark, f"{root}/spool")
    rows = spark.createDataFrame([("A / b", "x@y.z;a@b.c", 2, None), ("A / b", "other@y.z", 1, None), ("C", "c@y.z", 3, "said")], "label string, recipients string, n long, message string")
    calls = []

    def send(message):
        calls.append(message["delivery"])
        if stop == "while sending" and len(calls) == 2:
            raise Stop
        spool(message)
        if stop == "after sending" and len(calls) == 2:
            raise Stop

    assert box.deliver(send) == 0
    for _ in range(2):  # the run again, from its beginning
        box.post(rows, "r1")
        try:
            if stop == "after the outbox" and not calls:
                calls.append(None)
                raise Stop
            box.deliver(send)
        except Stop:
            continue
    assert box.deliver(send) == 0 and box.pending().count() == 0 and box.rows().count() == 3
    got = spool.rows().collect()
    assert sorted((r["label"], r["recipients"], r["n"]) for r in got) == [("A / b", "other@y.z", 1), ("A / b", "x@y.z;a@b.c", 2), ("C", "c@y.z", 3)]
    assert sorted(r["delivery"] for r in got) == sorted(r["delivery"] for r in box.sent().collect())


def test_routed_changes_of_a_run(spark, tmp_path):
    from driftlens.config import Route

    c = Config("https://h/", ["root@x.test"], routes=[Route("r", ["s@x.test"], titles=["A"])], confirmation_delay_seconds=0)
    m = Monitor.of(spark, f"file://{tmp_path}/m", c)
    m.run(lambda: docs(spark, ("a", "1", [])), "r0")
    m.run(lambda: docs(spark, ("a", "2", []), ("b", "1", [])), "r1")
    assert [(r["run_id"], r["label"], r["key"]) for r in m.routed().collect()] == [("r1", "r", "a")]


def test_stale_locks_are_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    first = Lock(spark, path, stale=0.5)
    first.__enter__()
    with pytest.raises(RuntimeError):
        Lock(spark, path, stale=60).__enter__()
    time.sleep(1.2)
    with Lock(spark, path, stale=0.5) as second:
        first.__exit__()  # not its lock any more
        assert second.holder() == second.token
    assert second.holder() is None
