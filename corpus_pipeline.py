"""Corpus pipeline: language ID, quality rules, near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. ``run`` writes each stage's rows as Parquet in the shared
folder and rereads them for the next. ``ORACLE_SQL`` is None: SQL doesn't
express language ID, near-dedup or BPE; ``tests/llm/test_pipeline.py`` compares
every stage's rows with brute force (n-grams as strings, SQL of the quality
rules and of mixing, all pairs, tiktoken).

Defined results: null and empty texts, those without a letter and those of no
learned language go at the first stage; very long texts are read whole; of
equal texts, repeated rows and ties the smallest doc_id stays, of fully equal
rows one; empty tables stay empty; extra columns of any name pass through all
stages but the last, which returns doc_id, source, one row a taken copy, and
its ids' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, language_id, mixing, near_dup, quality_rules
from driftlens.llm.shared import written

#: A text stays if so large a share of its n-grams is known to the language that it is given.
LEAST_KNOWN = 0.25


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language; learns from the rows that the operator may learn from."""
    model = language_id.fit(docs, language_id.learnable())
    packed = docs.select(F.struct(*docs.columns).alias("row"))  # names can't clash
    found = language_id.identify(packed, model, ["row"], "row.text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN)).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256, round_trip of each taken row."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, ["doc_id", "source"], digests=True)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
