"""Language identification (operator 9) with language-bitmask Bloom filters.

A filter is an array of bit masks, one bit a language: a slot's mask holds all
languages that set it, so one lookup (the AND of two slots) returns every
language that may contain a character n-gram. A text's n-grams are looked up,
the hits are counted for each language, each count is corrected for that
language's false-positive rate, and the largest corrected share decides.

Learning: from about ``Settings.docs_per_language`` texts a language (those
whose id hashes low enough, whatever their lengths; this bound is the only
sample). An n-gram enters the filter of a language if enough of its texts have
it (all texts of a language that has fewer), relative to the language where it
is most frequent; masks are put together on the executors, a row a slot.
Languages are the distinct non-null ``lang`` values; more than 64 use several
mask words, more than ``Settings.most_languages`` are an error.

Defined results: ``und`` with score 0 for a null text or one without a letter;
a text with letters but without any known n-gram gets the language with most
sampled texts, ties by name, with score 0; equal shares: first by name. With
nothing to learn from, every text is ``und``. Very long texts are learned from
and scored whole. Repeated rows each get a row; an empty table gives no rows;
extra columns of any name are ignored. Scoring doesn't shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block, map_texts, mix
from .shared import drop, written

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 1000  # bound of the learning sample (expected number; the hash decides)
    most_languages: int = 4096  # the table has a mask word for 64 languages
    lengths: tuple[int, ...] = (3, 4)
    least_docs: int = 3
    least_share: float = 0.15  # of the share of texts in the language where the n-gram is most frequent
    bits: int = 20  # slots of the filter: 2**bits


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower-case code point of every letter and mark; a blank for everything else."""
    import regex

    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, 32, np.uint32)
    for m in regex.finditer(r"[\p{L}\p{M}]+", everything):
        for ch in m.group():
            low = ch.lower()
            out[ord(ch)] = ord(low) if len(low) == 1 else ord(ch)
    return out


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    import regex

    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", everything):
        a, b = (x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1))
        out[a : b + 1] = True
    return out


_STEP = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63)]


def grams(texts: list[str | None], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams within words (with a blank at each side), their documents, and whether each text has a letter."""
    block = Block([f" {t} " if t else "" for t in texts])
    letters = block.sums(letter_table()[block.cps]) > 0
    c = fold_table()[block.cps]
    blank = c == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~block.first[1:]  # one blank after each word
    keep |= block.first
    c, doc = c[keep], np.repeat(np.arange(block.n), block.sums(keep))
    v = c.astype(U64) + U64(1)
    hashes, docs = [], []
    for n in lengths:
        m = len(v) - n + 1
        if m <= 0:
            continue
        h = np.full(m, U64(n))
        for j in range(n):
            h += v[j : j + m] * _STEP[j]
        ok = doc[: m] == doc[n - 1 :]
        for j in range(1, n - 1):  # blanks at the ends only
            ok &= c[j : j + m] != 32
        hashes.append(mix(h[ok]))
        docs.append(doc[:m][ok])
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(docs), letters


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64((1 << bits) - 1)
    return (h & mask).astype(np.intp), ((h >> U64(32)) & mask).astype(np.intp)


@dataclass
class Model:
    languages: list[str]
    fallback: str
    table: np.ndarray  # (words, 2**bits) of uint64
    false_rate: np.ndarray
    settings: Settings


def languages_of(texts: DataFrame, s: Settings) -> dict[str, int]:
    """Number of texts of each language; more languages than the table may have are an error."""
    rows = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(s.most_languages + 1).collect()
    if len(rows) > s.most_languages:
        raise ValueError(f"more than {s.most_languages} languages; raise Settings.most_languages")
    return {r["lang"]: r["n"] for r in rows}


def fit(docs: DataFrame, learn: F.Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learns from the rows where ``learn`` holds and the language isn't null."""
    spark = docs.sparkSession
    some = docs if learn is None else docs.filter(learn)
    # Texts whose id hashes below the fraction that leaves docs_per_language of them: no ranking, no shuffle of texts.
    part = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(id_col).cast("string")), 11) * F.lit(2.0**-53)
    able = some.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), part.alias("at"))
    number = languages_of(able, settings)
    rows = [(x, min(1.0, settings.docs_per_language / n), min(settings.least_docs, n)) for x, n in number.items()]
    cut = F.broadcast(spark.createDataFrame(rows, "lang string, part double, least int"))  # at most most_languages rows
    first = able.join(cut, "lang").filter("at < part").select("lang", "least", "text")

    def distinct(texts):
        h, doc, _ = grams(texts, settings.lengths)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        # A null entry for each text counts the texts.
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        values = np.insert(h.view(np.int64), at[:-1], 0)
        null = np.insert(np.zeros(len(h), bool), at[:-1], True)
        return [pa.ListArray.from_arrays(pa.array((at + np.arange(len(texts) + 1)).astype(np.int32)), pa.array(values, mask=null))]

    found = map_texts(first, "text", ["lang", "least"], [("grams", "array<bigint>", pa.list_(pa.int64()))], distinct)
    counts = (
        found.select("lang", "least", F.explode("grams").alias("gram"))
        .groupBy("lang", "least", "gram").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= F.col("least")) | F.col("gram").isNull())
    )
    counts = written(counts, "grams")
    size = {r["lang"]: r["n"] for r in counts.filter("gram IS NULL").select("lang", "n").collect()}  # a row a language
    languages = sorted(size)
    table = np.zeros((max(1, -(-len(languages) // 64)), 1 << settings.bits), U64)
    if languages:
        known = F.broadcast(spark.createDataFrame([(x, i, size[x]) for i, x in enumerate(languages)], "lang string, number int, texts bigint"))
        share = counts.filter("gram IS NOT NULL").join(known, "lang").select("gram", "number", (F.col("n") / F.col("texts")).alias("share"))
        best = share.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("number", "share")).alias("each"))  # languages at most
        good = best.select("gram", F.explode(F.filter("each", lambda x: x["share"] >= settings.least_share * F.col("most"))).alias("x")).select("gram", "x.number")
        low = F.lit((1 << settings.bits) - 1)
        both = F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
        masks = good.select(F.expr("number div 64").alias("word"), F.explode(both).alias("slot"), bit.alias("bit")).groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
        made = masks.toArrow()  # at most a row for each entry of the table
        table[made["word"].to_numpy(), made["slot"].to_numpy()] = made["mask"].to_numpy().view(U64)
    drop(counts)
    rate = np.array([(((table[i // 64] >> U64(i % 64)) & U64(1)).mean()) ** 2 for i in range(len(languages))])
    fallback = min(languages, key=lambda x: (-size[x], x)) if languages else "und"
    return Model(languages, fallback, table, rate, settings)


def decide(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and known share of each text."""
    h, doc, letters = grams(texts, model.settings.lengths)
    n = len(texts)
    total = np.bincount(doc, minlength=n)
    a, b = slots(h, model.settings.bits)
    share = np.zeros((len(model.languages), n))
    for w in range(model.table.shape[0]):
        masks = model.table[w][a] & model.table[w][b]
        for i in range(w * 64, min(len(model.languages), w * 64 + 64)):
            hits = np.bincount(doc[((masks >> U64(i % 64)) & U64(1)).astype(bool)], minlength=n)
            raw = hits / np.maximum(total, 1)
            share[i] = np.clip((raw - model.false_rate[i]) / max(1e-9, 1 - model.false_rate[i]), 0, 1)
    if not len(model.languages):
        return ["und"] * n, np.zeros(n), np.zeros(n)
    best = share.argmax(0)
    top = share[best, np.arange(n)]
    score = np.where(top > 0, top / np.maximum(share.sum(0), 1e-12), 0.0)
    names = []
    for i in range(n):
        if not letters[i]:
            names.append("und")
            score[i] = 0.0
        else:
            names.append(model.languages[best[i]] if top[i] > 0 else model.fallback)
    return names, score, np.where(letters, top, 0.0)


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Per row: id_cols, lang_pred, score (the winner's part of all corrected shares), known (the winner's corrected share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits words of masks, whatever the input's size

    def kernel(texts):
        names, score, known = decide(texts, shared.value)
        return [names, score, known]

    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("known", "double", pa.float64())]
    return map_texts(docs, text_col, id_cols, fields, kernel)


def learnable(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, learnable())
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "known")
