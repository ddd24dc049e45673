"""Sharding (operator 10): a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Rows belong to logical partitions (a hash of the id decides, so any layout of
the input gives the same result). For each partition the numbers of its rows
that go to each shard are drawn from the multivariate hypergeometric
distribution of the capacity that is left; row and column sums are exact.
Rows are permuted within their partition (sorted by a hash-random key), the
first c[p, 0] go to shard 0 and so on; after this exchange they are permuted
again within the shard, which gives gapless slots.

The law is ``rows``: shard sizes differ by one at most. Partitions and the
slices of a shard's second permutation hold about ``range_rows`` rows. The
matrix is drawn in two levels: the driver draws the counts of groups of
``GROUP`` partitions, and a task for each group draws its partitions' counts
with the group's counts as margins, which is the same distribution. Fully equal
rows are counted, and parts of at most ``PART`` of them are dealt as one, so no
task gets a shard or a hot key whole. Only narrow columns are shuffled;
``write_shards`` moves texts once.

Defined results: null ids form one id for hashing (the text's digest and a
row's size still order them); a null text has size 1 and a null text_crc32; a
very long text is one row like any other; repeated rows are placed one by one;
an empty table gives no rows; extra columns of any name are ignored. Reruns
agree: fully equal rows are interchangeable.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, written

SEED = 20240607
#: Partitions of a group of the matrix, and fully equal rows that are dealt as one.
GROUP, PART = 1024, 500


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def matrix(counts: list[int], left: list[int], seed: list[int]) -> np.ndarray:
    """Exact numbers of rows from each partition to each shard; ``left`` are the columns' sums."""
    left = np.array(left, np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), len(left)), np.int64)
    for p, n in enumerate(counts):
        rest, remain = int(n), int(left.sum())
        for s in range(len(left)):  # one hypergeometric draw after the other: conditional margins
            good = int(left[s])
            if rest <= 0:
                break
            out[p, s] = x = _draw(rng, good, remain - good, rest)
            rest -= x
            remain -= good
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number for any population, by inversion.

    Probabilities follow from ratios of neighbouring ones around the mode, which lose nothing in large populations.
    What lies beyond 12 deviations (and 40) has less than 10**-30, far below the step of the random number, 2**-53.
    """
    if n >= good + bad:
        return good
    if not good or not bad:
        return min(n, good)
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 40 + int(12 * (n * (good / total) * (bad / total)) ** 0.5)
    lo, hi = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    x = np.arange(lo, hi, dtype=np.float64)
    log_p = np.r_[0.0, np.cumsum(np.log((good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))))]
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(min(np.searchsorted(p, rng.random() * p[-1], "right"), len(p) - 1))


def drawn(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, cuts (running sums of its counts by shard) for a table (part, n)."""
    spark = counts.sparkSession
    grouped = counts.withColumn("group", F.expr(f"part div {GROUP}"))
    sums = sorted((r["group"], r["n"]) for r in grouped.groupBy("group").agg(F.sum("n").alias("n")).collect())  # a row for GROUP partitions
    table = matrix([n for _, n in sums], capacities(sum(n for _, n in sums), shards), [seed])
    margins = spark.createDataFrame([(g, row.tolist()) for (g, _), row in zip(sums, table, strict=True)], "group bigint, margin array<bigint>")

    def draw(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        own = matrix(pdf.n.tolist(), list(pdf.margin.iloc[0]), [seed, int(pdf.group.iloc[0])])
        return pd.DataFrame({"part": pdf.part, "cuts": np.cumsum(own, axis=1).tolist()})

    return grouped.join(margins, "group").groupBy("group").applyInPandas(draw, "part bigint, cuts array<bigint>")


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 20_000, seed: int = SEED) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot."""
    text = F.col(text_col).cast("binary")
    named = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text_col).alias("digest"),
    )
    who = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    equal = named.groupBy("id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("times"))
    equal = written(equal.withColumn("first", F.xxhash64(F.lit(seed), who)).withColumn("second", F.xxhash64(F.lit(seed + 1), who, "digest")), "rows")
    n = equal.agg(F.sum("times")).first()[0]
    if not n:
        return equal.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, -(-n // range_rows))
    cut = equal.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {PART}")))).withColumn("times", F.least(F.lit(PART).cast("long"), F.col("times") - F.col("nth") * PART))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "first", "digest", "nth"), F.lit(parts).cast("long")))
    cuts = written(drawn(cut.groupBy("part").agg(F.sum("times").alias("n")), shards, seed), "matrix")
    # The rows of a part are dealt before parts of equal rows become single rows.
    dealt = cut.repartition("part").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    # Equal ids and equal rows have random places of their own, too.
    order = Window.partitionBy("part").orderBy(F.xxhash64("first", "digest", "nth", "copy"), "first", "digest", "size", "nth", "copy")
    placed = dealt.withColumn("rn", F.row_number().over(order)).join(cuts, "part")
    placed = placed.withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rn"))))
    slices = max(1, -(-n // (shards * range_rows)))
    bits = max(0, (slices - 1).bit_length())
    single = F.xxhash64("second", "nth", "copy")
    placed = placed.select("id", "size", "text_crc32", single.alias("second"), "shard").withColumn("slice", F.shiftrightunsigned("second", 64 - bits).cast("int") if bits else F.lit(0))
    placed = written(placed, "placed")
    begin = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    again = Window.partitionBy("shard", "slice").orderBy("second", "id", "size")
    out = placed.withColumn("own", F.row_number().over(again) - 1).join(begin, ["shard", "slice"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("begin") + F.col("own")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs with shard and slot, partitioned by shard, sorted by slot within files.

    Rows of equal id and text are numbered on both sides, so each takes a slot of its own. Columns of docs named shard or slot are replaced.
    """
    key = ["key_id", "key_crc"]
    places = assign(docs, shards, id_col, text_col).select(F.col("id").alias("key_id"), F.col("text_crc32").alias("key_crc"), "shard", "slot")
    places = numbered(written(places, "places"), key, "nth")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    named = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("key_id"), F.crc32(F.col(text_col).cast("binary")).alias("key_crc"))
    named = numbered(written(named, "texts"), key, "nth")
    n = named.alias("n").join(places.alias("p"), F.expr("n.key_id <=> p.key_id AND n.key_crc <=> p.key_crc AND n.nth = p.nth")).select("n.row.*", "p.shard", "p.slot")
    files = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    n.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = assign(docs)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
