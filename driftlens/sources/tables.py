"""Written tables in the folder that driver and executors share: they cut lineage, so a lost executor costs its tasks only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on one machine, a folder that goes with the process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local" or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = made = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _OWN[context.applicationId]


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read from there."""
    where = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)
