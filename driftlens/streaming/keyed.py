"""Baseline, confirmation and heartbeat as keyed state of a stream.

A stream of snapshot rows has one state a document: the baseline row and, while
a change waits for its second look, the row that differs. State is dealt by the
document's key and lives in the state store, so a batch costs its own rows; no
snapshot is read again, and a restart goes on from the checkpoint.

* A first snapshot's rows become baselines and tell nothing.
* A row that differs from its baseline waits. The next look decides: one that
  reads as the baseline suppresses the change, any other is confirmed as it
  stands then, whatever the first look was.
* ``wait_seconds`` confirms without a second look by a processing-time timer,
  for feeds that only hold what has changed.

A document that a listing lacks has no row there. ``feed`` adds a row for it
from the two listings before (a removal needs two looks), a narrow anti join.

Moves pair documents of two keys and so aren't a key's own state: ``diff.moves``
pairs the removed and added rows of a batch of confirmed changes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = ("url", "title", "section", "sha256")
FEED = "snapshot bigint, key string, url string, title string, section string, sha256 string, gone boolean"
SIDE = "gone boolean, url string, title string, section string, sha256 string"
STATE = ", ".join(f"{p}_{c}" for p in ("base", "next") for c in SIDE.split(", ")) + ", waits boolean"
CHANGE = "outcome string, snapshot bigint, category string, key string, old_key string, " + ", ".join(f"{p}_{c} string" for c in VALUES for p in ("old", "new"))
CONFIRMED, SUPPRESSED = "confirmed", "suppressed"


def feed(listing: DataFrame, before: list[DataFrame], snapshot: int) -> DataFrame:
    """The rows (``FEED``) of a listing (key, url, title, section, sha256), and one for each key that only the listings ``before`` have."""
    rows = listing.select(F.lit(snapshot).cast("long").alias("snapshot"), "key", *VALUES, F.lit(False).alias("gone"))
    if not before:
        return rows
    known = before[0].select("key")
    for other in before[1:]:
        known = known.unionByName(other.select("key"))
    lost = known.distinct().join(listing.select("key"), "key", "left_anti")
    return rows.unionByName(lost.select(F.lit(snapshot).cast("long").alias("snapshot"), "key", *[F.lit(None).cast("string").alias(c) for c in VALUES], F.lit(True).alias("gone")))


def told(outcome: str, snapshot: int, key: str, old: tuple, new: tuple) -> Iterator[Row]:
    """A row for each category in which two sides (gone, url, title, section, sha256) differ."""
    if old[0] and new[0]:
        return
    if old[0] or new[0]:
        kinds = ["documents_added" if old[0] else "documents_removed"]
    else:
        tests = (("documents_modified", 4), ("documents_renamed", 2), ("documents_relinked", 1))
        kinds = [kind for kind, at in tests if old[at] != new[at]]
    sides = [v for pair in zip(old[1:], new[1:], strict=True) for v in pair]
    for kind in kinds:
        yield Row(outcome=outcome, snapshot=snapshot, category=kind, key=key, old_key=None if old[0] else key, **dict(zip([c.split()[0] for c in CHANGE.split(", ")][5:], sides, strict=True)))


def differ(a: tuple, b: tuple) -> bool:
    """Whether two sides differ in anything that is a change (a section alone isn't)."""
    return a[0] != b[0] or (not a[0] and (a[1], a[2], a[4]) != (b[1], b[2], b[4]))


GONE = (True, None, None, None, None)


class Documents(StatefulProcessor):
    """State and timers of the documents of one stream."""

    def __init__(self, first: int, wait_seconds: float | None):
        self.first, self.wait = first, wait_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", STATE)

    def held(self) -> tuple[tuple, tuple | None]:
        """(baseline, waiting row or None); without state the document is new to a known collection."""
        if not self.state.exists():
            return GONE, None
        row = self.state.get()
        return tuple(row[:5]), tuple(row[5:10]) if row[10] else None

    def hold(self, base: tuple, waits: tuple | None) -> None:
        if base[0] and waits is None:
            self.state.clear()  # a document that is gone costs nothing
        else:
            self.state.update((*base, *(waits or GONE), waits is not None))

    def drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        base, waits = self.held()
        for row in sorted(rows, key=lambda r: (r["snapshot"], r["gone"])):
            seen = (bool(row["gone"]), *(row[c] for c in VALUES))
            if row["snapshot"] == self.first:
                base, waits = seen, None
                continue
            if waits is None:
                if not differ(base, seen):
                    base = seen
                    continue
                waits = seen
                if self.wait is not None:
                    self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + self.wait * 1000))
                continue
            if self.wait is not None:
                self.drop_timers()
            if differ(base, seen):
                yield from told(CONFIRMED, row["snapshot"], key[0], base, seen)
            else:
                yield from told(SUPPRESSED, row["snapshot"], key[0], base, waits)
            base, waits = seen, None
        self.hold(base, waits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        base, waits = self.held()
        if waits is not None:
            yield from told(CONFIRMED, -1, key[0], base, waits)
            self.hold(waits, None)

    def close(self) -> None:
        pass


class Heartbeats(StatefulProcessor):
    """One state a monitor: when it last told that checks run. A check starts the clock; a timer tells when it is due."""

    def __init__(self, every_seconds: float):
        self.every = int(every_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms bigint, checks bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        checks = sum(1 for _ in rows)
        now = int(timerValues.getCurrentProcessingTimeInMs())
        if self.last.exists():
            at, before = self.last.get()
            self.last.update((at, before + checks))
        else:
            self.last.update((now, checks))
            self.handle.registerTimer(now + self.every)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        at, checks = self.last.get()
        self.last.update((now, 0))
        self.handle.registerTimer(now + self.every)
        yield Row(monitor=key[0], since_ms=at, at_ms=now, checks=checks)

    def close(self) -> None:
        pass


def documents(rows: DataFrame, first: int, wait_seconds: float | None = None) -> DataFrame:
    """Outcomes (``CHANGE``) of a stream of ``FEED`` rows whose first snapshot is ``first``."""
    mode = "none" if wait_seconds is None else "processingTime"
    return rows.groupBy("key").transformWithState(Documents(first, wait_seconds), CHANGE, "append", mode)


def heartbeats(checks: DataFrame, days: float) -> DataFrame:
    """monitor, since_ms, at_ms, checks: a row whenever ``days`` have passed since the last one; ``checks`` has monitor, a row a check."""
    return checks.groupBy("monitor").transformWithState(Heartbeats(days * 86400), "monitor string, since_ms bigint, at_ms bigint, checks bigint", "append", "processingTime")


def started(out: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of outcomes as Parquet; state needs the store that knows several values a key."""
    conf = out.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def wait_for(query: StreamingQuery, seconds: float = 600) -> None:
    """Until the stream has read all there is; an error of the stream is raised."""
    end = time.monotonic() + seconds
    while not query.awaitTermination(10):
        if time.monotonic() > end:
            query.stop()
            raise TimeoutError("the stream did not end")
