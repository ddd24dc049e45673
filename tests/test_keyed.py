"""Keyed state of a stream against the batch run, with restarts, suppression and timers."""

import time

import pytest

from driftlens.operators import diff
from driftlens.streaming import keyed

COLS = "key string, url string, title string, section string, sha256 string"


def listing(spark, rows):
    return spark.createDataFrame([(k, f"u/{k}" if len(r) < 3 else r[2], r[1], "s", r[0]) for k, r in rows.items()], COLS)


OLD = {"same": ("1", "A"), "gone": ("2", "B"), "edit": ("3", "C"), "flap": ("4", "D"), "name": ("5", "E"), "link": ("6", "F"), "late": ("7", "G"), "back": ("8", "H")}
FIRST = {"same": ("1", "A"), "edit": ("3x", "C"), "flap": ("4x", "D"), "name": ("5", "E2"), "link": ("6", "F", "v/link"), "late": ("7x", "G"), "new": ("9", "I")}
SECOND = {"same": ("1", "A"), "edit": ("3x", "C"), "flap": ("4", "D"), "name": ("5", "E2"), "link": ("6", "F", "v/link"), "late": ("7y", "G"), "new": ("9", "I"), "back": ("8", "H")}


def rows_of(df):
    cols = ["category", "key", "old_title", "new_title", "old_url", "new_url"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def wait_until(done, seconds=60):
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.5)


@pytest.mark.parametrize("restart", [False, True])
def test_stream_gives_the_rows_of_the_batch_run(spark, tmp_path, restart):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    sides = [listing(spark, r) for r in (OLD, FIRST, SECOND)]

    def go():
        stream = spark.readStream.schema(keyed.FEED).option("maxFilesPerTrigger", 1).parquet(source)
        keyed.wait_for(keyed.started(keyed.documents(stream, 0), out, check))

    for n, side in enumerate(sides):
        keyed.feed(side, sides[max(0, n - 2) : n], n).coalesce(1).write.mode("append").parquet(source)
        if restart:
            go()
            time.sleep(0.01)
    go()
    got = spark.read.parquet(out)
    want = diff.documents(*[s.selectExpr("*", "0L AS pos") for s in (sides[0], sides[2])])
    assert rows_of(got.filter("outcome = 'confirmed'")) == rows_of(want.filter("category <> 'documents_moved'"))
    assert {r["key"] for r in got.filter("outcome = 'suppressed'").collect()} == {"flap", "back"}
    assert {r["category"] for r in got.filter("key = 'late'").collect()} == {"documents_modified"}


def test_a_timer_confirms_and_hearts_beat(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    keyed.feed(listing(spark, OLD), [], 0).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(keyed.FEED).parquet(source)
    query = keyed.started(keyed.documents(stream, 0, wait_seconds=2), out, check, processingTime="500 milliseconds")
    checks = spark.readStream.schema(keyed.FEED).parquet(source).selectExpr("'m' AS monitor")
    beats = keyed.started(keyed.heartbeats(checks, 1 / 86400), str(tmp_path / "beats"), str(tmp_path / "beats-check"), processingTime="500 milliseconds")
    try:
        wait_until(lambda: query.lastProgress and query.lastProgress["numInputRows"] == 0)
        keyed.feed(listing(spark, {**OLD, "edit": ("3x", "C")}), [], 1).coalesce(1).write.mode("append").parquet(source)
        wait_until(lambda: spark.read.schema(keyed.CHANGE).parquet(out).count())
        wait_until(lambda: spark.read.schema("at_ms bigint").parquet(str(tmp_path / "beats")).count() >= 2)
    finally:
        query.stop()
        beats.stop()
    assert [(r["outcome"], r["category"], r["key"], r["snapshot"]) for r in spark.read.parquet(out).collect()] == [("confirmed", "documents_modified", "edit", -1)]
    rows = spark.read.parquet(str(tmp_path / "beats")).collect()
    assert len(rows) >= 2 and all(r["at_ms"] - r["since_ms"] >= 1000 for r in rows) and sum(r["checks"] for r in rows) >= len(OLD)


def test_listings_are_written_by_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    """Not by one task that reads all documents of a snapshot."""
    from driftlens.plans import flows

    docs = spark.range(0, 110, 1, 4).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'src1' AS source", "4L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(flows, "scratch", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(flows.fx, "table", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").repartition(4, "doc_id"))
    got = flows.confirmation_streamed(spark, str(tmp_path))
    feed = spark.read.schema(keyed.FEED).parquet(str(tmp_path / "feed")).selectExpr("snapshot", "input_file_name() AS file").distinct().collect()
    assert all(len({r["file"] for r in feed if r["snapshot"] == k}) > 1 for k in range(3))
    want = diff.documents(*flows.pair(spark, str(tmp_path)))
    assert rows_of(got) == rows_of(want.filter("category = 'documents_modified'"))
