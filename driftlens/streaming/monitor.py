"""The monitor: compare, confirm, route, send, then commit; in batch or as a stream of snapshots.

A snapshot comes as finished tables, or as what a scan brings (page_links,
fetched, failures, found_links), which ``assembled`` joins with the baseline,
the extra documents and the rules.

Order of effects: outbox rows first, the pointer to the new baseline last. The
outbox is partitioned by (run_id, label) and a run's partitions are replaced, so
a run that stops between them writes the same rows again; ``streaming.delivery``
sends each row once. A stream hands every micro-batch of snapshot rows to the
same function by ``foreachBatch``; ``streaming.keyed`` keeps state a document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROUTE, Config
from ..functions.predicates import Exclusions, Filters, is_excluded, link_matches, matches_fixed
from ..operators import assembly, dedup, diff, routing
from ..plans import report
from ..sources.state import Lock, Store, delete, has, read_json, write_json, write_text
from ..sources.tables import kept
from .delivery import Outbox, replaced

Snapshot = DataFrame | dict[str, DataFrame]
#: Version of the snapshots that this library writes; a baseline without one is of the first.
SCHEMA_VERSION = 3
#: Tables of a snapshot that aren't part of the baseline, and those of a scan that isn't assembled yet.
BESIDE = ("errors", "changes", "details")
SCAN = ("page_links", "fetched", "failures", "found_links")
#: Changes that the run's own page lists; all of them are in the pages beside it.
LISTED = 200


class Outcome(str):
    """What a run came to; ``changes`` are those that it found, if any."""

    changes: DataFrame | None = None

    @classmethod
    def of(cls, name: str, changes: DataFrame | None) -> Outcome:
        made = cls(name)
        made.changes = changes
        return made


def tables_of(snapshot: Snapshot) -> dict[str, DataFrame]:
    """A snapshot's tables (documents, and if there are links, folders, page, errors)."""
    return snapshot if isinstance(snapshot, dict) else {"documents": snapshot}


@dataclass
class Monitor:
    """``owner`` gets failures, document warnings and heartbeats privately; routes and recipients get changes."""

    spark: SparkSession
    root: str
    recipients: list[str] = field(default_factory=list)
    routes: DataFrame | None = None
    owner: str = ""
    heartbeat_days: float = 0
    exclusions: Exclusions | None = None
    filters: Filters = Filters()
    history_limit: int = 100
    retry_attempts: int = 1
    retry_delay: float = 5
    confirmation_delay: float = 0
    sleep: Callable = time.sleep
    #: Extra documents (url, title, section) and rules of dynamic ones (title, source_url, match_host, match_path).
    extra: DataFrame | None = None
    rules: DataFrame | None = None
    page_url: str = ""
    #: Whether filters hold for the baseline as well, so that a narrower filter tells no removals.
    filter_baseline: bool = False

    @classmethod
    def of(cls, spark: SparkSession, root: str, config: Config, exclusions: Exclusions | None = None) -> Monitor:
        c = config.validate()
        return cls(
            spark, root, c.recipients, c.route_rows(spark), c.failure_recipient, c.heartbeat_days, exclusions, c.filters(), int(c.history_limit),
            max(1, int(c.retry_attempts)), c.retry_delay_seconds, c.confirmation_delay_seconds,
            extra=c.extra_rows(spark), rules=c.rule_rows(spark), page_url=c.page_url,
        )

    def assembled(self, snapshot: Snapshot) -> dict[str, DataFrame]:
        """A snapshot's tables; of a scan, the documents and errors that it comes to, written once."""
        tables = dict(tables_of(snapshot))
        if "fetched" not in tables:
            return tables
        before = self.store.read("documents")
        empty = "identity string, url string, title string, section string, sha256 string, pos bigint"
        made = assembly.assemble(
            tables["page_links"], tables["fetched"], tables.get("failures", self.spark.createDataFrame([], "url string, error string")), self.spark.createDataFrame([], empty) if before is None else before,
            self.extra, self.rules if "found_links" in tables else None, tables.get("found_links"), self.filters, self.exclusions, self.page_url,
        )
        rest = {k: v for k, v in tables.items() if k not in SCAN}
        return rest | {"documents": kept(made.documents.drop("carried", "reused"), "assembled"), "errors": kept(made.errors, "errors")}

    def wanted(self, snapshot: Snapshot, filtered: bool = True) -> dict[str, DataFrame]:
        """The snapshot's tables without excluded documents and, if filtered, without documents and links that the filters don't match."""
        tables = dict(tables_of(snapshot))
        at = [F.col(c) for c in ("section", "title", "url")]
        docs = tables["documents"].filter(matches_fixed(*at, self.filters)) if filtered else tables["documents"]
        tables["documents"] = docs if self.exclusions is None else docs.filter(~is_excluded(at[0], at[2], self.exclusions))
        if filtered and "links" in tables:
            tables["links"] = tables["links"].filter(link_matches(at[0], at[1], self.filters))
        return tables

    def baseline(self, snapshot: Snapshot) -> dict[str, DataFrame]:
        """What is stored of a snapshot: its wanted tables, and the version of their schema."""
        tables = {k: v for k, v in self.wanted(snapshot).items() if k not in BESIDE}
        return tables | {"header": self.spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"))}

    @property
    def store(self) -> Store:
        return Store(self.spark, f"{self.root}/state", {"documents": "key"})

    @property
    def runtime_path(self) -> str:
        return f"{self.root}/runtime.json"

    def runtime(self) -> dict:
        return {"consecutive_failures": 0, "last_error": ""} | (read_json(self.spark, self.runtime_path, {}) or {})

    def before(self, names) -> tuple[dict[str, DataFrame], int]:
        """The baseline's tables of these names and their schema's version."""
        held = self.store.tables()
        version = 1 if held else SCHEMA_VERSION
        if "header" in held:
            version = self.store.read("header").first()["schema_version"]
        return {k: self.store.read(k) for k in names if k in held}, version

    def changes(self, snapshot: Snapshot) -> DataFrame:
        """Changes against the baseline; without one, everything is new. Exclusions hold for both, filters for the snapshot."""
        new = {k: v for k, v in self.wanted(snapshot).items() if k not in BESIDE}
        old, version = self.before(new)
        old = {"documents": new["documents"].limit(0)} | old
        return diff.snapshots(self.wanted(old, self.filter_baseline), new, version, SCHEMA_VERSION)

    def details(self, snapshot: Snapshot, found: DataFrame) -> DataFrame:
        """key, place, detail of modified documents and, under an empty key, of the page's text."""
        new = self.wanted(snapshot)
        return diff.details(found, self.before(new)[0], new)

    def run(self, snapshot: Callable[[], Snapshot], run_id: str, again: Callable[[], Snapshot] | None = None, dry_run: bool = False) -> Outcome:
        """One scheduled run under the lock: check, then the runtime record; a failure is recorded, told to the owner and raised.

        A dry run changes nothing and returns its changes with the outcome.
        """
        began = time.monotonic()
        with Lock(self.spark, f"{self.root}/lock"):
            try:
                found = self.assembled(retry(snapshot, self.retry_attempts, self.retry_delay, self.sleep))
                outcome, changed = self.check(found, run_id, again, dry_run)
                if dry_run:
                    return Outcome.of(outcome, changed)
                errors = found.get("errors")
                if errors is not None:
                    self.warn(errors, run_id)
                if outcome == "unchanged" and (errors is None or errors.isEmpty()):
                    self.heartbeat(run_id)
                count = 0 if changed is None else changed.count()
            except Exception as e:
                if dry_run:
                    raise
                state = self.runtime()
                write_json(self.spark, self.runtime_path, state | {"consecutive_failures": state["consecutive_failures"] + 1, "last_error": str(e)})
                self.log(run_id, "failed", "Check failed", [str(e)])
                self.tell("Monitor failure", f"The check or its notice failed. Error: {e}", run_id)
                raise
            done = {"consecutive_failures": 0, "last_error": "", "last_success_at": now(), "last_change_count": count, "last_duration_seconds": round(time.monotonic() - began, 2)}
            write_json(self.spark, self.runtime_path, self.runtime() | done | {"last_document_count": self.store.read("documents").count()})
        return Outcome.of(outcome, changed)

    def check(self, snapshot: Snapshot, run_id: str, again: Callable[[], Snapshot] | None = None, dry_run: bool = False) -> tuple[str, DataFrame | None]:
        """(outcome, changes): initialised, unchanged, suppressed, changed or dry_run."""
        tables = self.assembled(snapshot)
        if dry_run:
            return "dry_run", self.changes(tables)
        if self.store.current() is None:
            self.store.commit(self.store.write(self.baseline(tables)))
            return "initialised", None
        found = self.changes(tables)
        if found.isEmpty():  # or of an older schema, whose differences mean nothing
            self.store.commit(self.store.write(self.baseline(tables)))
            return "unchanged", None
        outcome = "changed"
        if again is not None:  # the second look is compared with the same baseline and replaces the first
            self.sleep(self.confirmation_delay)
            second = retry(again, self.retry_attempts, self.retry_delay, self.sleep)
            tables = self.assembled(second)
            found = self.changes(tables)
            outcome = "suppressed" if found.isEmpty() else "changed"
        version = self.store.write(self.baseline(tables) | {"changes": found})
        if outcome == "changed":
            found = self.store.read("changes", version)
            self.details(tables, found).write.parquet(f"{self.store.root}/{version}/details")
            said = self.store.read("details", version)
            pages = report.change_pages(found, said, f"{self.root}/reports/changed-{run_id}")
            self.send(found, run_id)
            lines = [r["line"] for r in dedup.summary(found).orderBy("place").collect()]  # a row a category
            self.log(run_id, outcome, "Changes confirmed" if again is not None else "Changes found", lines, report.change_report(found, "Changes", LISTED, said, pages=f"changed-{run_id}" if pages else None))
        else:
            self.log(run_id, outcome, "Transient change suppressed", ["The second look was as the baseline."])
        self.store.commit(version)
        return outcome, found if outcome == "changed" else None

    def send(self, found: DataFrame, run_id: str) -> None:
        routes = self.routes if self.routes is not None else empty_routes(self.spark)
        if not self.recipients and routes.isEmpty():
            raise ValueError("changes but no recipients")
        out = routing.batches(found, routes, self.recipients)
        self.outgoing.post(out.withColumn("message", F.lit(None).cast("string")), run_id)
        own = routing.routed(found, routes).select(F.col("name").alias("label"), *diff.SUBJECT)
        replaced(own.withColumn("run_id", F.lit(run_id)), f"{self.root}/routed")

    @property
    def outgoing(self) -> Outbox:
        return Outbox(self.spark, self.root)

    def routed(self) -> DataFrame:
        """The changes of each batch (run_id, label)."""
        return self.spark.read.parquet(f"{self.root}/routed")

    def tell(self, label: str, message: str, run_id: str, n: int = 1) -> None:
        """A private row for the owner, if there is one."""
        if self.owner:
            self.outgoing.post(self.spark.range(1).select(F.lit(label).alias("label"), F.lit(self.owner).alias("recipients"), F.lit(n).cast("bigint").alias("n"), F.lit(message).alias("message")), run_id)

    def warn(self, errors: DataFrame, run_id: str) -> None:
        """Documents that could not be read (title, error, pos); their earlier rows are carried by ``carry_forward``."""
        told = routing.error_digest(errors).first()
        if told["n"]:
            self.tell("Document warning", f"The check continued without {told['n']} document(s). {told['digest']}", run_id, told["n"])

    def heartbeat(self, run_id: str) -> None:
        """Tells the owner after ``heartbeat_days`` without changes that checks run; the first run only starts the clock."""
        last = self.runtime().get("last_heartbeat_at")
        due = routing.heartbeat_due(F.lit(last), F.lit(now()), self.heartbeat_days)
        if not self.spark.range(1).select(due.alias("due")).first()["due"]:
            return
        if last is not None:
            self.tell("Heartbeat", "Checks run; nothing has changed.", run_id)
            self.log(run_id, "heartbeat", "Heartbeat sent", [])
        write_json(self.spark, self.runtime_path, self.runtime() | {"last_heartbeat_at": now()})

    def outbox(self) -> DataFrame:
        return self.outgoing.rows()

    def log(self, run_id: str, kind: str, title: str = "", details: list[str] | None = None, page: str | None = None) -> None:
        """Adds an event to the log, a table of the newest ``history_limit`` events, and saves its report; reports of events that leave it go."""
        name = f"{kind}-{run_id}.html" if page else None
        if page:
            write_text(self.spark, f"{self.root}/reports/{name}", page)
        row = self.spark.createDataFrame([(run_id, kind, title, details or [], name)], "seq string, kind string, title string, details array<string>, report string")
        row = row.select(F.current_timestamp().alias("event_ts"), "*")
        log = Store(self.spark, f"{self.root}/log")
        before, version = log.read("events"), log.current()
        if before is not None:
            row = row.unionByName(before)
        log.commit(log.write({"events": dedup.newest(row, self.history_limit).coalesce(1)}))
        if before is not None:
            kept = log.read("events").filter("report IS NOT NULL").select("report")
            for r in before.select("report").filter("report IS NOT NULL").join(kept, "report", "left_anti").collect():  # events that left
                delete(self.spark, f"{self.root}/reports/{r['report']}")
                delete(self.spark, f"{self.root}/reports/{r['report'].removesuffix('.html')}")
            delete(self.spark, f"{self.root}/log/{version}")

    def history(self, most: int = 100) -> DataFrame:
        """event_ts, seq, kind, title, details, report of the newest events."""
        return dedup.newest(Store(self.spark, f"{self.root}/log").read("events"), most)

    def status(self) -> DataFrame:
        """One row: documents of the baseline, the newest event if there is one, and the runtime record."""
        state = self.runtime()
        docs = self.store.read("documents")
        n = docs.count() if docs is not None else 0
        events = self.history(self.history_limit).collect() if has(self.spark, f"{self.root}/log/current.json") else []  # the log holds no more
        event = (events[0]["event_ts"], events[0]["kind"]) if events else (None, None)
        row = (*event, len(events), n, state["consecutive_failures"], state["last_error"], state.get("last_success_at"), state.get("last_heartbeat_at"))
        return self.spark.createDataFrame([row], "event_ts timestamp, kind string, events int, documents bigint, consecutive_failures int, last_error string, last_success_at string, last_heartbeat_at string")

    def stream(self, snapshots: DataFrame, checkpoint: str, by: str = "snapshot_id"):
        """Checks every snapshot of a stream of document rows, those of a batch in ascending order."""

        def one(batch: DataFrame, epoch: int) -> None:
            batch.persist()
            for r in batch.select(by).distinct().orderBy(by).collect():  # a few snapshots a batch
                self.check(batch.filter(F.col(by) == r[0]).drop(by), run_id=f"{epoch}-{r[0]}")
            batch.unpersist()

        return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def empty_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ROUTE)


def retry(operation: Callable, attempts: int = 3, delay: float = 5.0, sleep: Callable | None = None):
    """Calls again after delay, 2 x delay, ... for sinks on the driver; executors have task retries."""
    for k in range(1, attempts + 1):
        try:
            return operation()
        except Exception:
            if k == attempts:
                raise
            (sleep or time.sleep)(delay * 2 ** (k - 1))
