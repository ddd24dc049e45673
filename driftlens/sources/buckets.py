"""Baselines dealt by their key: tables in buckets, so that a comparison doesn't shuffle the old side.

A baseline is written once and compared again and again. Written in buckets of
its key it is read as if it had been shuffled already: only the new snapshot is,
into the baseline's buckets. The number of buckets follows the rows and is
stored beside the table; a baseline is replaced as a whole, so a table that grew
moves to a larger number with its next version, and readers never mix numbers.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import last_wins
from . import state

#: Rows of a bucket, about; a bucket is one task of a comparison.
BUCKET_ROWS = 1 << 20


def number_for(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows: powers of two times the session's shuffle partitions, so few numbers occur."""
    number = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while number * BUCKET_ROWS < rows:
        number *= 2
    return number


def name_of(path: str) -> str:
    return "buckets_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write(rows: DataFrame, path: str, key: str = "key", buckets: int | None = None) -> None:
    """Writes rows (a row a key) as a table in buckets of the key."""
    spark = rows.sparkSession
    number = buckets or number_for(spark, rows.count())
    # One task a bucket: without this every task would write a file for every bucket.
    dealt = rows.repartition(number, key)
    spark.sql(f"DROP TABLE IF EXISTS {name_of(path)}")
    dealt.write.mode("overwrite").format("parquet").bucketBy(number, key).sortBy(key).option("path", path).saveAsTable(name_of(path))
    state.write_json(spark, f"{path}.buckets.json", {"key": key, "buckets": number, "schema": rows.schema.json()})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table, known to Spark as one in buckets; sessions that didn't write it register it from what is stored beside."""
    told = state.read_json(spark, f"{path}.buckets.json")
    if told is None:
        return spark.read.parquet(path)
    name = name_of(path)
    if not spark.catalog.tableExists(name):
        schema = StructType.fromJson(json.loads(told["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{told['key']}`) SORTED BY (`{told['key']}`) INTO {told['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def is_bucketed(spark: SparkSession, path: str) -> bool:
    return state.has(spark, f"{path}.buckets.json")


def baseline(documents: DataFrame, key: str = "key") -> DataFrame:
    """One row a key, the last one (by pos), ready to be written in buckets."""
    tidy = documents if "pos" in documents.columns else documents.withColumn("pos", F.lit(0).cast("long"))
    return last_wins(tidy, [key])
