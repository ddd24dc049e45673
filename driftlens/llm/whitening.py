"""Embedding whitening (operator 11): covariance from upper-triangle aggregates, components from LAPACK.

Entries are quantised (``x = floor(1024 * c) + 100000``), so that counts, sums
and squared deviations are exact integers. The steps:

1. one aggregation of each dimension's sum (in two parts, so that no sum
   overflows), smallest and largest value;
2. one aggregation of the centred products of every dimension pair of the upper
   triangle. The triangle is cut into tiles of ``TILE`` x ``TILE`` pairs; a
   vector visits each tile, and generated SQL expressions ``sum(l3 * r5)`` add
   the products of the tile's pairs. All pairs are in this one aggregation, but
   the plan has ``TILE``**2 sums whatever the number of dimensions: one sum a
   pair, 2,080 at 64 dimensions, exceeds what generated code may hold and ran
   interpreted at a millisecond a vector. Visits aren't shuffled; tasks send a
   row a tile;
3. the symmetric eigenproblem of the covariance on the driver (dimensions
   squared, whatever the number of rows);
4. one aggregation of the whitened values' own covariance, which measures
   ``identity_error``; projection by blocks of vectors.

Defined results: rows whose vector is null, or holds a null or non-finite entry,
are dropped; so are those with an entry whose quantised value exceeds 2**53 in
size, empty vectors, and vectors of another length than most rows have (the
larger length on a tie). Components whose eigenvalue is within rounding of zero
(constant or dependent dimensions, a single row) have a null ``whitened``; a
trace of zero has a null ``explained``; ``identity_error`` is taken over the
other components and is null if there are none. ``deviation`` is null where it
exceeds 64 bits. Ties and repeated rows are rows like any other; null ids are
kept; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 8
#: Entries are quantised to this many steps a unit, from this origin.
STEPS, ORIGIN = 1024, 100_000
#: Quantised values are whole numbers up to this size in double precision.
LARGEST = float(1 << 53)
LOW_BITS = 24


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: n rows, exact sums and ranges a dimension, covariance, components by falling eigenvalue."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # a column each

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is above rounding."""
        if not len(self.eigenvalues):
            return 0
        least = max(self.eigenvalues[0], 0.0) * self.dims * np.finfo(float).eps * 16
        return int((self.eigenvalues > least).sum())


def quantised(rows: DataFrame, vec_col: str, keep: list[str]) -> DataFrame:
    """keep_0, ..., and x: the vectors as whole numbers; rows with an entry that isn't a usable number are dropped."""
    made = rows.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v"))
    # NaN is the largest double, so one comparison leaves it out as well; a null entry isn't at most anything.
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) <= (LARGEST - ORIGIN) / STEPS, F.lit(False))) & (F.size("v") > 0)
    return made.filter(fine).withColumn("x", F.expr(f"transform(v, c -> CAST(floor({STEPS} * c) AS BIGINT) + {ORIGIN})")).drop("v")


def common_length(vecs: DataFrame) -> int:
    """The length that most vectors have, 0 without any."""
    found = vecs.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def moments(vecs: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """n, and the exact sum, smallest and largest value of each dimension, of vectors of length d."""
    mask = (1 << LOW_BITS) - 1
    each = vecs.select(F.posexplode("x").alias("at", "x"))
    sums = [F.sum(F.shiftright("x", LOW_BITS)).alias("high_part"), F.sum(F.col("x").bitwiseAND(F.lit(mask))).alias("low_part")]
    made = each.groupBy("at").agg(F.count(F.lit(1)).alias("n"), *sums, F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    return made[0]["n"], [(r["high_part"] << LOW_BITS) + r["low_part"] for r in made], [r["low"] for r in made], [r["high"] for r in made]


def means(sums: list[int], n: int) -> list[tuple[int, float]]:
    """Whole and fractional parts of the means."""
    return [(s // n, s % n / n) for s in sums]


def centred(vecs: DataFrame, sums: list[int], n: int) -> DataFrame:
    """x as doubles d less the means, whose whole parts are taken off exactly."""
    told = ", ".join(f"struct({whole}L AS whole, {rest!r}D AS rest)" for whole, rest in means(sums, n))
    return vecs.withColumn("d", F.expr(f"zip_with(x, array({told}), (a, m) -> CAST(a - m.whole AS DOUBLE) - m.rest)")).drop("x")


def products(rows: DataFrame, d: int) -> np.ndarray:
    """Sums of the products of all dimension pairs of d (arrays of doubles of length d), a symmetric matrix."""
    side = -(-d // TILE)
    tiles = [(i, j) for i in range(side) for j in range(i, side)]
    visits = f"explode(array({', '.join(f'struct({TILE * i} AS l, {TILE * j} AS r)' for i, j in tiles)}))"
    padded = f"concat(d, array_repeat(0D, {side * TILE - d}))" if d % TILE else "d"
    tile = rows.selectExpr(f"{padded} AS d").selectExpr("d", f"{visits} AS tile")
    own = [f"d[tile.{s} + {i}] AS {s}{i}" for s in "lr" for i in range(TILE)]
    sums = [F.expr(f"sum(l{i} * r{j})").alias(f"s{i}_{j}") for i in range(TILE) for j in range(TILE)]
    made = tile.selectExpr("tile.l AS at_l", "tile.r AS at_r", *own).groupBy("at_l", "at_r").agg(*sums).collect()
    out = np.zeros((side * TILE, side * TILE))
    for r in made:
        out[r["at_l"] : r["at_l"] + TILE, r["at_r"] : r["at_r"] + TILE] = np.array(r[2:]).reshape(TILE, TILE)
    return (np.triu(out) + np.triu(out, 1).T)[:d, :d]


def fit(rows: DataFrame, vec_col: str = "embedding") -> Whitening:
    """Learns from all usable vectors."""
    vecs = quantised(rows, vec_col, [])
    d = common_length(vecs)
    if not d:
        return Whitening(0, [], [], [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    vecs = vecs.filter(F.size("x") == d)
    n, sums, low, high = moments(vecs, d)
    cov = products(centred(vecs, sums, n), d) / n
    values, columns = np.linalg.eigh(cov)
    return Whitening(n, sums, low, high, cov, values[::-1].copy(), columns[:, ::-1].copy())


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Exact sums of (n * x - S)**2, in 64 bits where the fitted ranges allow it."""
    ends = zip(model.low, model.high, model.sums, strict=True)
    if sum(max(abs(model.n * lo - s), abs(model.n * hi - s)) ** 2 for lo, hi, s in ends) < 1 << 63:
        # Each value less the mean's whole part first: n * x itself may exceed 64 bits.
        whole = np.array([s // model.n for s in model.sums], np.int64)
        rest = np.array([s % model.n for s in model.sums], np.int64)
        return pa.array((((x - whole) * model.n - rest) ** 2).sum(1))
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def projected(x: np.ndarray, model: Whitening, number: int) -> np.ndarray:
    """Whitened values of the first components (vectors x number)."""
    parts = means(model.sums, model.n)
    centre = (x - np.array([w for w, _ in parts])).astype(np.float64) - np.array([r for _, r in parts])
    return centre @ (model.components[:, :number] / np.sqrt(model.eigenvalues[:number]))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def identity_error(vecs: DataFrame, model: Whitening, number: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened values, as they come out, minus the identity."""
    live = min(number, model.rank)
    if not live:
        return None

    def run(batches):
        for batch in batches:
            w = projected(matrix(batch.column(0), model.dims), model, live)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, live, dtype=np.int32)), pa.array(w.ravel()))], names=["d"])

    w = vecs.select("x").mapInArrow(run, "d array<double>")
    totals = w.select(F.posexplode("d").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w")).collect()
    centre = {r["at"]: r["w"] / model.n for r in totals}
    told = ", ".join(f"{centre[k]!r}D" for k in range(live))
    again = w.select(F.expr(f"zip_with(d, array({told}), (a, m) -> a - m)").alias("d"))
    return float(np.abs(products(again, live) / model.n - np.eye(live)).max())


def whiten(rows: DataFrame, model: Whitening, keep: list[str], vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each usable vector of the model's length and each of the first components: the kept columns,
    component, n, deviation, whitened, explained, identity_error."""
    number = min(components, model.dims)
    kinds = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not number:
        names = [k.split() for k in kinds.split(", ")]
        return rows.select(*keep).limit(0).select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in names])
    vecs = quantised(rows, vec_col, keep).filter(F.size("x") == model.dims)
    error, live = identity_error(vecs, model, number), min(number, model.rank)
    trace = float(np.trace(model.covariance))
    share = [max(float(v), 0.0) / trace if trace > 0 else None for v in model.eigenvalues[:number]]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(len(keep)), model.dims)
            each = np.repeat(np.arange(len(x)), number)
            w = np.full((len(x), number), np.nan)
            w[:, :live] = projected(x, model, live)
            made = [
                *(batch.column(i).take(pa.array(each)) for i in range(len(keep))), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)), deviations(x, model).take(pa.array(each)), pa.array(w.ravel(), from_pandas=True),
                pa.array(share * len(x), pa.float64()), pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(made, names=[*(f"keep_{i}" for i in range(len(keep))), *(k.split()[0] for k in kinds.split(", "))])

    held = ", ".join([f"keep_{i} {vecs.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep))] + [kinds])
    made = vecs.select(*[f"keep_{i}" for i in range(len(keep))], "x").mapInArrow(run, held)
    return made.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[k.split()[0] for k in kinds.split(", ")])


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows, fit(rows), ["vec_id"])
