"""Quality classifier (operator 1): hashed word n-gram logistic regression, FTRL-proximal.

A text becomes tokens (runs of word characters, runs of other visible
characters). Features are hashed n-grams of the tokens and of their shapes
(case, digits, length class; a symbol run is its own shape), with the value
sqrt(count / all counts), so that every feature vector has length 1. Weights
are learned by follow-the-regularised-leader updates, one text at a time, and
a score is the logistic of a sparse dot product.

Learning uses at most ``Settings.most_rows`` labelled rows, those with the
smallest hash of their id, whatever their texts' lengths (the only bound);
features are made on the executors and written to the shared folder, and the
updates run on the driver, which holds one slice of the feature rows at a time
if all of them are large. Scoring reads every whole text and doesn't shuffle.

Defined results: null and empty texts have no features and score the logistic
of the bias alone; with no labelled text at all every score is 0.5; very long
texts are learned from and scored whole; texts with several label rows count
once for each; equal labelled rows tie and each counts; repeated rows each get
a row; an empty table gives no rows; extra columns of any name are ignored.
``predicted`` is 1 from a score of 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import Block, doc_of, is_space, map_texts, mix, ngrams
from .shared import drop, written

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    most_rows: int = 4000
    epochs: int = 4
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    word_lengths: tuple[int, ...] = (1, 2)
    shape_lengths: tuple[int, ...] = (1, 2, 3, 5)
    threshold: float = 0.7


def features(texts: list[str | None], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, value and start pointers of each text's distinct features, buckets ascending."""
    block = Block(texts)
    c = block.cps
    upper = (c >= 65) & (c <= 90)
    digit = (c >= 48) & (c <= 57)
    word = upper | digit | ((c >= 97) & (c <= 122)) | (c == 95) | (c > 0x7F)
    symbol = ~(word | is_space(c) | (c < 32))
    kind = word.astype(np.int8) + 2 * symbol
    cut = np.zeros(len(c), bool)
    cut[1:] = kind[1:] != kind[:-1]
    starts, ends = block.runs(kind > 0, cut)
    ptr = block.ptr(starts)
    h = block.hashes(starts, ends)
    count = lambda flags: (p := np.r_[0, np.cumsum(flags)])[ends] - p[starts]
    size = ends - starts
    ups, digits = count(upper), count(digit)
    shape = np.minimum(size, 12) // 3 + 8 * (ups > 0) + 16 * ((ups > 1) & (2 * ups > size)) + 32 * (digits > 0)
    shapes = np.where(word[starts], mix(shape.astype(U64) + U64(77)), h) if len(starts) else h
    same = np.zeros(len(h), U64)
    same[1:] = h[1:] == h[:-1]
    shapes = mix(shapes + same)  # a stutter has a shape of its own
    keys, n_docs = [], doc_of(ptr)
    for lengths, values, salt in ((settings.word_lengths, h, 1), (settings.shape_lengths, shapes, 2)):
        for n in lengths:
            g, at = ngrams(values, ptr, n)
            bucket = mix(g + U64(salt * 1000 + n)) >> U64(64 - settings.bits)
            keys.append((n_docs[at].astype(U64) << U64(32)) | bucket)
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(keys)])
    keys = keys[new]
    doc = (keys >> U64(32)).astype(np.int64)
    total = np.bincount(doc, weights=counts, minlength=block.n)
    value = np.sqrt(counts / total[doc]) if len(keys) else np.zeros(0)
    at = np.searchsorted(doc, np.arange(block.n + 1))
    return (keys & U64(0xFFFFFFFF)).astype(np.int32), value.astype(np.float32), at


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


class Ftrl:
    """Follow-the-proximally-regularised-leader for logistic loss."""

    def __init__(self, settings: Settings):
        self.s = settings
        size = 1 << settings.bits
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, at) -> np.ndarray:
        s, z = self.s, self.z[at]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 0.3)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


#: Bytes of feature rows that the driver holds; beyond, each epoch reads them again, slice by slice.
HELD_BYTES = 64 << 20


def epoch(rows: DataFrame, whole: list | None) -> Iterator:
    """The feature rows in order of their place: held ones, or slices read one after the other."""
    if whole is not None:
        yield from whole
        return
    last = rows.agg(F.max("place")).first()[0]
    for at in range(0, last + 1, 64):  # at most most_rows / 64 slices
        yield from sorted(rows.filter(F.col("place").between(at, at + 63)).collect(), key=lambda r: r["place"])


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """Learns from labelled rows where ``learn`` (over the labels' columns) holds."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        own = own.filter(learn)
    own = own.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The first labelled rows by hash, as narrow rows; equal ones are counted, so the driver gets most_rows rows at most.
    key = F.xxhash64(F.lit(11), "id", "y")
    few = own.join(texts.select("id", F.xxhash64("text").alias("digest")), "id").select("id", "y", "digest", key.alias("key")).orderBy("key", "id", "y", "digest").limit(settings.most_rows)
    picked = few.groupBy("key", "id", "y", "digest").agg(F.count(F.lit(1)).alias("times")).collect()
    model = Ftrl(settings)
    if picked:
        spark = docs.sparkSession
        picked = sorted((r["key"], r["id"], r["y"], r["digest"], r["times"]) for r in picked)
        chosen = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(picked)], T.StructType([T.StructField("place", T.IntegerType()), *few.select("id", "y", "digest").schema.fields, T.StructField("times", T.LongType())]))
        found = texts.withColumn("digest", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "digest"])  # most_rows rows
        found = found.groupBy("place", "y", "times").agg(F.first("text").alias("text"))  # copies of a chosen row are one

        def kernel(some):
            bucket, value, at = features(some, settings)
            cut = lambda a: [a[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            return [cut(bucket), cut(value)]

        rows = map_texts(found, "text", ["place", "y", "times"], [("bucket", "binary", pa.binary()), ("value", "binary", pa.binary())], kernel)
        rows = written(rows, "features")
        small = rows.agg(F.sum(F.octet_length("bucket") + F.octet_length("value"))).first()[0] <= HELD_BYTES
        whole = sorted(rows.collect(), key=lambda r: r["place"]) if small else None
        for _ in range(settings.epochs):
            for r in epoch(rows, whole):
                for _ in range(r["times"]):
                    model.update(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["value"], np.float32), float(r["y"]))
        drop(rows)
    w = model.weights(np.arange(len(model.z)))
    return Model(w[:-1].astype(np.float32), float(w[-1]) * 0.3, settings)


def score(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Per row: id_cols, score (0 to 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input's size

    def kernel(texts):
        m = shared.value
        bucket, value, at = features(texts, m.settings)
        part = np.r_[0.0, np.cumsum(m.weights[bucket].astype(np.float64) * value)]
        dot = part[at[1:]] - part[at[:-1]] + m.bias
        p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
        return [p, (p >= m.settings.threshold).astype(np.int32)]

    return map_texts(docs, text_col, id_cols, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], kernel)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
