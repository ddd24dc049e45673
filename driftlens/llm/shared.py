"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on one machine (tests), a folder that goes with the process."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the numbers 1, 2, ... of the rows of each key to a written table, without gathering a key's rows.

    A scan's task numbers its own rows of a key; prefix sums of the tasks' counts give the rest. The table must be
    one that ``written`` made: its scan has the same rows in the same order each time.
    """
    own = [F.col(k).alias(f"own_{i}") for i, k in enumerate(keys)]
    ids = [f"own_{i}" for i in range(len(keys))]
    rows = table.select(F.struct(*table.columns).alias("row"), *own, F.monotonically_increasing_id().alias("at")).withColumn("task", F.shiftright("at", 33))
    counts = rows.groupBy(*ids, "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*ids).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*[F.col(i).alias(f"{i}_") for i in ids], F.col("task").alias("task_"), "begin")
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*ids, "task").orderBy("at")))
    same = " AND ".join([*(f"{i} <=> {i}_" for i in ids), "task = task_"])
    return placed.join(begin, F.expr(same)).select("row.*", (F.col("begin") + F.col("nth")).alias(name))
