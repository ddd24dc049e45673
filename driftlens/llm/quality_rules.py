"""Repetition rules (operator 5): characters inside duplicated word n-grams and lines.

Words are ``[^\\x20\\x09-\\x0D]+``. Rolling hashes of several n-gram lengths are
compared inside each text in numpy; an n-gram found twice or more marks its
words, and the marked share of the word characters is the coverage at that
length. Lines split at ``\\n``; a line with a word that equals an earlier line
is a duplicate. Symbols ``[#*$%&|<>]`` are counted beside.

Base rule: fails below 10 words or when words in repeated 5-word windows
exceed 20 % of the words. The method's own verdict adds, on whole texts, the
coverage limits of ``DEFAULT_LIMITS``.

Defined results: null and empty texts have no words, so they fail the base
rule with all counts 0; repeated rows each get their own row; only the named
columns are read, so extra columns of any name are ignored. No shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block, doc_of, is_space, map_texts, mix, ngrams, repeated, segment_sums

U64 = np.uint64
# The symbols that are counted.
SYMBOLS = np.array(sorted(map(ord, "#*$%&|<>")), np.uint32)


@dataclass(frozen=True)
class Limits:
    """Most of a text's word characters that may lie in duplicated n-grams or lines, and most symbols a word."""

    coverage: dict[int, float] = field(default_factory=lambda: {3: 0.60, 5: 0.24, 8: 0.22, 10: 0.20})
    line_coverage: float = 0.30
    symbols_per_word: float = 0.30


DEFAULT_LIMITS = Limits()


def measure(texts: list[str | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text; cover_<n> are characters of words in n-grams found twice or more."""
    block = Block(texts)
    c = block.cps
    word = ~is_space(c)
    starts, ends = block.runs(word)
    ptr = block.ptr(starts)
    n_words = np.diff(ptr)
    size = ends - starts
    out = {"n_words": n_words, "word_chars": segment_sums(size, ptr), "n_symbols": block.sums(np.isin(c, SYMBOLS))}
    hashes = block.hashes(starts, ends)
    doc = doc_of(ptr)
    salt = mix(np.arange(block.n, dtype=U64) + U64(1))
    for n in lengths:
        grams, at = ngrams(hashes, ptr, n)
        hit = at[repeated(mix(grams + salt[doc[at]]))]
        step = np.zeros(len(starts) + 1, np.int64)
        step[: len(starts)] += np.bincount(hit, minlength=len(starts))[: len(starts)]
        step -= np.bincount(hit + n, minlength=len(starts) + 1)[: len(starts) + 1]
        inside = np.cumsum(step[:-1]) > 0
        out[f"cover_{n}"] = segment_sums(size * inside, ptr)
        if n == 5:
            out["n_repeat_words"] = segment_sums(inside, ptr)
    # Lines with a word.
    feed = c == 10
    line_start, line_end = block.runs(np.ones(len(c), bool), cut=np.r_[False, feed[:-1]] if len(c) else feed)
    bounds = line_end - (feed[line_end - 1] if len(line_end) else 0)
    words_before = np.zeros(len(c) + 1, np.int64)
    np.cumsum(word, out=words_before[1:])
    chars = words_before[bounds] - words_before[line_start]
    real = chars > 0
    line_start, bounds, chars = line_start[real], bounds[real], chars[real]
    line_ptr = block.ptr(line_start)
    line_doc = doc_of(line_ptr)
    keys = mix(block.hashes(line_start, bounds) + salt[line_doc])
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    if len(keys):
        same = keys[order][1:] == keys[order][:-1]
        again[order[1:][same]] = True  # stable: the first of equal lines comes first
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=block.n)
    out["dup_line_chars"] = np.bincount(line_doc[again], weights=chars[again], minlength=block.n).astype(np.int64)
    return out


def rules(docs: DataFrame, id_cols: list[str], text_col: str = "text", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Per row: id_cols, the counts, coverage shares, base_failed, kept, and reasons (array of failed rules)."""
    lengths = tuple(sorted({5, *limits.coverage}))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"cover_{n}" for n in lengths)]

    def kernel(texts):
        found = measure(texts, lengths)
        return [found[k] for k in counts]

    out = map_texts(docs, text_col, id_cols, [(k, "bigint", pa.int64()) for k in counts], kernel)
    share = lambda k: F.col(k) / F.greatest(F.col("word_chars"), F.lit(1))
    failed = {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "duplicate_lines": share("dup_line_chars") > limits.line_coverage,
        "symbols": F.col("n_symbols") > limits.symbols_per_word * F.col("n_words"),
    } | {f"coverage_{n}": share(f"cover_{n}") > most for n, most in limits.coverage.items()}
    return (
        out.withColumn("base_failed", failed["few_words"] | failed["repeated_words"])
        .withColumn("reasons", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in failed.items()])))
        .withColumn("kept", F.size("reasons") == 0)
    )


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The rows that the rules keep, with their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))  # names can't clash
    return rules(packed, ["row"], f"row.{text_col}", limits).filter("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rules(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(limits: Limits = DEFAULT_LIMITS) -> str:
    """DuckDB SQL for the query's rows: the same n-grams as strings, by windows over each row's words."""
    blank = r"[\x20\x09-\x0D]"
    lengths = sorted({5, *limits.coverage})
    chars = f"length(regexp_replace(X, '{blank}', '', 'g'))"
    grams = ", ".join(" || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, n))]) + f" AS g{n}" for n in lengths)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS h{n}" for n in lengths)
    inside = ", ".join(f"bool_or(h{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in lengths)
    sums = ", ".join(f"sum(CASE WHEN in{n} THEN length(w) ELSE 0 END) AS cover{n}" for n in lengths)
    over = [f"coalesce(cover{n}, 0)::DOUBLE / greatest(word_chars, 1) > {most}::DOUBLE" for n, most in limits.coverage.items()]
    over.append(f"dup_chars::DOUBLE / greatest(word_chars, 1) > {limits.line_coverage}::DOUBLE")
    over.append(f"n_symbols > {limits.symbols_per_word}::DOUBLE * n_words")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: {chars.replace("X", "x")} > 0) AS lines FROM d),
c AS (SELECT doc_id, r, words, CAST(len(words) AS BIGINT) AS n_words, CAST({chars.replace("X", "t")} AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  {chars.replace("X", "t")} - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: {chars.replace("X", "x")})), 0) AS dup_chars FROM l),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM c),
g AS (SELECT r, i, w, {grams} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, w, {twice} FROM g),
m AS (SELECT r, w, {inside} FROM h),
s AS (SELECT r, count(CASE WHEN in5 THEN 1 END) AS repeat, {sums} FROM m GROUP BY r),
f AS (SELECT c.*, CAST(coalesce(repeat, 0) AS BIGINT) AS n_repeat_words, {" OR ".join(over)} AS over FROM c LEFT JOIN s ON c.r = s.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM b
"""


ORACLE_SQL = _sql()
