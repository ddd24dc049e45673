"""Deliveries: an outbox whose partitions are replaced, a ledger of what was sent, and a sender that takes the rest.

A message is known by the digest of its run, label and recipients. The steps
are: write the outbox (a run's partitions replace those of a broken attempt),
send what the ledger lacks, enter it into the ledger. A stop before the ledger's
entry makes the next sender offer the same message under the same id; ``Spool``
creates a file for each id and never a second one, and any other transport can
drop an id that it knows. So each message arrives once, wherever a run stops.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import _fs, has

MESSAGE = "label string, recipients string, n bigint, message string, run_id string"
SENT = "delivery string, sent_at timestamp"


def replaced(rows: DataFrame, path: str, by: tuple[str, ...] = ("run_id", "label")) -> None:
    """Writes rows as partitions; those that exist are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delivery_id() -> F.Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("run_id", "label", "recipients")])), 256)


def pending(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    """The outbox's messages, with their id (delivery), that the ledger doesn't have."""
    return outbox.withColumn("delivery", delivery_id()).dropDuplicates(["delivery"]).join(sent.select("delivery"), "delivery", "left_anti")


class Spool:
    """A transport that leaves each message as a file named by its id, from which a mailer takes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, message: dict) -> None:
        """Writes beside, then renames; a message that is there stays as it is."""
        where, fs = _fs(self.spark, f"{self.folder}/{message['delivery']}.json")
        if fs.exists(where):
            return
        beside, _ = _fs(self.spark, f"{self.folder}/.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(message, ensure_ascii=False, default=str).encode()))
        out.close()
        if not fs.rename(beside, where):
            fs.delete(beside, False)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(MESSAGE + ", delivery string").json(f"{self.folder}/*.json")


class Outbox:
    """Messages of runs, the ledger of those sent, and the sender, below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path, self.ledger = spark, f"{root}/outbox", f"{root}/sent"

    def post(self, rows: DataFrame, run_id: str) -> None:
        replaced(rows.withColumn("run_id", F.lit(run_id)).select(*[c.split()[0] for c in MESSAGE.split(", ")]), self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(MESSAGE).parquet(self.path) if has(self.spark, self.path) else self.spark.createDataFrame([], MESSAGE)

    def sent(self) -> DataFrame:
        return self.spark.read.schema(SENT).parquet(self.ledger) if has(self.spark, self.ledger) else self.spark.createDataFrame([], SENT)

    def pending(self) -> DataFrame:
        return pending(self.rows(), self.sent())

    def deliver(self, send: Callable[[dict], None]) -> int:
        """Sends what is pending, each message entered when it went; returns their number. One message a recipient group, so they are few."""
        number = 0
        for row in self.pending().orderBy("run_id", "label", "recipients").toLocalIterator():
            message = row.asDict()
            send(message)
            self.enter(message["delivery"])
            number += 1
        return number

    def enter(self, delivery: str) -> None:
        row = self.spark.range(1).select(F.lit(delivery).alias("delivery"), F.current_timestamp().alias("sent_at"))
        row.coalesce(1).write.mode("append").parquet(self.ledger)
