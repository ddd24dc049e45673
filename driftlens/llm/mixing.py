"""Mixing sources to target weights (operator 7).

Every source gets a share of all words by its weight, at most ``epochs_most``
times its own words; what exceeds that goes to the other sources by weight
(the level at which all shares fit is found exactly). A document has a
hash-random key; within its source documents are range-sorted by (key, id,
digest): the table is dealt by ranges of that order and written, each range's
words are summed, and the sums of earlier ranges and of earlier documents of
the range give the exact prefix sum. The source's budget cuts there. Budgets
above the source's size repeat whole epochs first. Documents stay whole: the
last one is taken if its middle lies within the budget, so a source misses its
target by half a document at most.

No step gathers a source, an id or a group of equal rows in one task: fully
equal rows are counted, dealt in parts of at most ``part_rows`` and numbered,
and the number is the last part of the order. Only narrow columns are shuffled. Sizes and
targets are per-source aggregates, a row a source.

Defined results: null and empty texts and those of blanks have size 0 and are
taken 0 times; very long texts count whole; a null source is a source of its
own, the last; null ids have one key; ties of the key (repeated ids) are
ordered by id and text digest, fully equal rows are interchangeable; an empty
table gives an empty result; extra columns of any name are ignored (``mix``
returns them). Reruns agree, for keys depend on ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, written

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def size_of(text_col: str = "text") -> F.Column:
    """Number of runs of [^\\x20\\x09-\\x0D]: starts of words, counted without making the words."""
    blank = " \t\n\x0b\x0c\r"
    shape = F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), blank, " " * 6), "[^ ]+", "x")
    return (F.length(shape) - F.length(F.translate(shape, "x", ""))).cast("long")


def key_of(id_col: str, seed: str = SEED) -> F.Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def targets(sources: DataFrame, epochs_most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to (source, source_size): one row a source.

    Sources sorted by cap / weight fill up in that order; the level is the one
    at which the sources below stand at their caps and the rest share by weight.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(x) for x in weights])
    ranked = sources.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(epochs_most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
        .withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    share = F.when(F.col("ratio") <= F.coalesce("final", F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return levels.select("source", "source_size", "weight", share.alias("target"))


ORDER = ["source", "key", "id", "digest", "place"]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs_most: int = 3, weights: tuple[int, ...] = WEIGHTS, range_rows: int = 50_000, part_rows: int = 1_000, seed: str = SEED) -> DataFrame:
    """Per row: id, source, size, source_size, target, key, digest, copies, taken; equal rows differ in place (from 0)."""
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"),
        key_of(id_col, seed).alias("key"), F.xxhash64(text_col).alias("digest"),
    )
    equal = written(narrow.groupBy("id", "source", "size", "key", "digest").agg(F.count(F.lit(1)).alias("times")), "sizes")
    sums = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    shares = written(targets(sums, epochs_most, weights), "targets")
    n = equal.agg(F.sum("times"), F.max("times")).first()
    each = lambda d, last: d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = each(equal.filter(F.col("times") <= part_rows), F.col("times") - 1).withColumn("place", F.col("nth"))
    if (n[1] or 0) > part_rows:  # parts of equal rows are dealt before they become rows
        parts = equal.filter(F.col("times") > part_rows).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {part_rows}")))).repartition("id", "digest", "part")
        parts = each(parts, F.least(F.lit(part_rows).cast("long"), F.col("times") - F.col("part") * part_rows) - 1)
        rows = rows.unionByName(parts.withColumn("place", F.col("part") * part_rows + F.col("nth")).drop("part"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n[0] or 0) // range_rows))
    dealt = rows.drop("times", "nth").repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.monotonically_increasing_id())
    ordered = written(dealt.withColumn("range", F.shiftright("at", 33)), "ranges")  # the task's number and the place in it
    ranges_of = ordered.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges_of.withColumn("before_range", F.coalesce(F.sum("range_size").over(by_range), F.lit(0))).select(F.col("source").alias("s"), F.col("range").alias("r"), "before_range")
    within = Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(before, F.expr("source <=> s AND `range` = r")).drop("s", "r")
    out = out.join(shares.select(F.col("source").alias("s"), "source_size", "target"), F.expr("source <=> s"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    prefix = F.col("before_range") + F.col("own")
    last = (2 * prefix + F.col("size") <= 2 * rest) & (rest > 0)
    copies = F.when(F.col("size") > 0, epochs + last.cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("id", "source", "size", "source_size", "target", "key", "digest", "place", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with the columns of docs.

    What is taken depends on the source and the order alone, so the plan is
    reduced to one cut a source, and texts aren't shuffled if the sources fit a
    broadcast. Only rows equal to the one at the cut are numbered.
    """
    seed = options.get("seed", SEED)
    rows = plan(docs, id_col, text_col, source_col, **options).filter("size > 0")
    order = F.struct("key", "id", "digest", "place")
    base = rows.groupBy("source").agg(F.min("copies").alias("base"), F.max("copies").alias("top"), F.max(F.struct("copies", order.alias("at"))).alias("last"))
    cuts = written(base.select(F.col("source").alias("cut_source"), "base", "top", F.struct("last.at.key", "last.at.id", "last.at.digest").alias("cut"), F.col("last.at.place").alias("cut_place")), "cuts")
    full = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    own = F.struct(key_of(id_col, seed).alias("key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    packed = docs.filter(full).select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), own.alias("own"))  # names can't clash
    named = packed.join(cuts, F.expr("source <=> cut_source"))
    at_cut = (F.col("own") == F.col("cut")) & (F.col("top") > F.col("base"))
    copies = F.when((F.col("own") <= F.col("cut")) | (F.col("top") == F.col("base")), F.col("top")).otherwise(F.col("base"))
    clear = named.filter(~at_cut).select("row", copies.alias("copies"))
    border = written(named.filter(at_cut).select("row", "source", "base", "top", "cut_place"), "border")  # equal in source, id and text
    border = numbered(border, ["source"], "place").select("row", F.when(F.col("place") - 1 <= F.col("cut_place"), F.col("top")).otherwise(F.col("base")).alias("copies"))
    each = clear.unionByName(border).filter("copies > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(cap) OVER b, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (total - capped) / CAST(open_weight AS DOUBLE) AS level FROM l),
f AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS final FROM m),
t AS (SELECT source, source_size, CASE WHEN ratio <= coalesce(final, 'infinity'::DOUBLE) THEN CAST(cap AS DOUBLE) ELSE weight * final END AS target FROM f),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN budget - epochs * source_size > 0 AND 2 * prefix + size <= 2 * (budget - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
