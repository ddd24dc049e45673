"""License scan (operator 4) by diagonal voting.

Texts become lower-cased words; rolling hashes of word k-grams (k = 2 for
phrases, 3 for notices) are joined in Spark to the positions where templates
have them. A match at word w of the text and gram g of the template votes for
diagonal w - g. Votes are summed by diagonal, neighbouring diagonals (words
inserted or left out) are merged, and a span is verified by the share of the
template's gram places that it holds, in a bounded width. A phrase stands
where one diagonal has all its grams.

Every k-gram of every whole text goes to the join. The template table has a few
hundred rows, fixed in this module, and is broadcast; what matches nothing ends
in the task that joined it, so only votes and one marker a row are shuffled.
Votes are keyed by the id columns and a digest of the text, which stay the same
when a lost task is run again; equal rows are one key, and their markers say
how many they are. Sets of grams and templates are bit masks of as many words
as the templates need.

Defined results: a null text counts as empty; an empty text has 0 words, no
label, null positions and score 0; very long texts are scanned whole;
overlapping places count one by one; repeated rows and ties each get a row; an
empty table gives no rows; extra columns of any name are ignored. Votes of one
text meet in one task, summed by diagonal before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Block, doc_of, map_texts, mix, ngrams

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of public licenses and notices, and the labels they add.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied",
        "apache-2.0-notice",
    ),
    ("released under the mit license", "mit-statement"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software",
        "mit-text",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl-notice",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        "bsd-text",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "isc-text",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-statement"),
    ("distributed under the terms of the gnu general public license", "gpl-statement"),
]
PHRASE_K, NOTICE_K = 2, 3
#: Diagonals at most so far apart are merged; a span may be so much wider than its template.
GAP, WIDTH = 3, 1.5
#: Share of a notice's gram places that verifies a span.
LEAST_SHARE = 0.7
#: Bits of a word of a mask.
BITS = 60


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, and start pointers."""
    block = Block(texts)
    c = block.cps
    upper = (c >= 65) & (c <= 90)
    c = np.where(upper, c + np.uint32(32), c)
    word = ((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122)) | (c > 0x7F)
    starts, ends = block.runs(word)
    return block.hashes(starts, ends, block.prefix(c) if len(c) else np.zeros(1, np.uint64)), block.ptr(starts)


def grams_of(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, different for each k, and their positions."""
    g, at = ngrams(h, ptr, k)
    return mix(g + np.uint64(k)), at


def template_rows() -> list[tuple[int, int, int, int, int, str, bool]]:
    """(k, hash, template, gram position, grams, label, is base) of every template gram."""
    out = []
    for t, (text, label, base) in enumerate([(p, x, True) for p, x in PHRASES.items()] + [(p, x, False) for p, x in NOTICES]):
        k = PHRASE_K if base else NOTICE_K
        g, at = grams_of(*words_of([text]), k)
        out += [(k, int(h), t, int(i), len(g), label, base) for h, i in zip(g.view(np.int64), at, strict=True)]
    return out


def rolled(texts: list[str | None]) -> list:
    """Per text: number of words; 0 and then the hashes of all its grams, the shorter ones first."""
    h, ptr = words_of(texts)
    number = np.diff(ptr)
    docs, hashes = [np.arange(len(texts))], [np.zeros(len(texts), np.uint64)]
    for k in sorted({PHRASE_K, NOTICE_K}):
        g, at = grams_of(h, ptr, k)
        hashes.append(g)
        docs.append(doc_of(ptr)[at])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return [number, pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.concatenate(hashes)[order].view(np.int64)))]


def bit(at: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def masks(at: F.Column, number: int, name: str, when: F.Column | None = None) -> list[F.Column]:
    """Aggregates of a set of numbers below ``number``, as words of BITS bits."""
    here = F.lit(True) if when is None else when
    return [F.coalesce(F.bit_or(F.when(here & (F.floor(at / BITS) == w), bit(at % BITS))), F.lit(0).cast("long")).alias(f"{name}_{w}") for w in range(words(number))]


def words(number: int) -> int:
    return max(1, -(-number // BITS))


def names_of(templates: list, base: bool | None, name: str = "mask") -> F.Column:
    """Sorted distinct labels of the templates in a set of masks, joined by commas."""
    found = {t: (label, own) for _, _, t, _, _, label, own in templates}
    some = [F.when(F.col(f"{name}_{t // BITS}").bitwiseAND(F.lit(1 << t % BITS)) != 0, F.lit(label)) for t, (label, own) in found.items() if base is None or own == base]
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*some)))), ",")


def scan(docs: DataFrame, id_cols: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per row: id_cols, n_words, n_base, first_word, last_word, base_labels, labels, score.

    With ``spans`` also the verified places: array of (first, last, label, is_base, share), by position.
    """
    spark, rows = docs.sparkSession, template_rows()
    most = max(grams for _, _, _, _, grams, _, _ in rows)
    ids = [f"id_{i}" for i in range(len(id_cols))]
    named = docs.select(*[docs[c].alias(i) for c, i in zip(id_cols, ids, strict=True)], F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("digest"), docs[text_col].alias("text"))
    found = map_texts(named, "text", [*ids, "digest"], [("n_words", "bigint", pa.int64()), ("hashes", "array<bigint>", pa.list_(pa.int64()))], rolled)
    key = [*ids, "digest", "n_words"]
    # A few hundred rows, fixed in this module.
    templates = F.broadcast(spark.createDataFrame(rows, "k int, hash bigint, template int, gram bigint, grams bigint, label string, is_base boolean"))
    each = found.select(*key, F.posexplode("hashes").alias("at", "hash"))
    each = each.join(templates, "hash", "left").filter("at = 0 OR template IS NOT NULL")  # the marker of a row, or a vote
    # Grams of PHRASE_K words stand first, so the others follow their number.
    pos = F.col("at") - 1 - F.when(F.col("k") == max(PHRASE_K, NOTICE_K), F.greatest(F.col("n_words") - min(PHRASE_K, NOTICE_K) + 1, F.lit(0))).otherwise(0)
    each = each.withColumn("pos", pos).withColumn("diagonal", F.col("pos") - F.col("gram"))
    by = [*key, "template", "label", "is_base", "grams"]
    voted = each.groupBy(*by, "diagonal").agg(F.count(F.lit(1)).alias("n"), *masks(F.col("gram"), most, "held"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # Equal rows voted together: a row's votes are their part.
    per_row = Window.partitionBy(*key)
    voted = voted.withColumn("times", F.max(F.when(F.col("template").isNull(), F.col("n"))).over(per_row))
    voted = voted.withColumn("n", F.expr("n div times"))
    # Neighbouring diagonals of a notice; a lone vote of a longer notice doesn't join them.
    is_base = F.coalesce("is_base", F.lit(True))
    strong = voted.withColumn("weak", ~is_base & (F.col("n") < 2) & (F.col("grams") > 3))
    line = Window.partitionBy(*key, "template", "weak").orderBy("diagonal", "lo")
    near = (F.col("diagonal") - F.lag("diagonal").over(line) <= GAP) & ~is_base & (F.col("lo") - F.lag("lo").over(line) <= WIDTH * F.col("grams"))
    merged = strong.withColumn("jump", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("jump").over(line))
    names = [f"held_{w}" for w in range(words(most))]
    places = merged.groupBy(*by, "times", "weak", "part").agg(
        F.min("diagonal").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        *[F.bit_or(c).alias(c) for c in names], F.max("n").alias("n"),
    )
    number = sum((F.bit_count(c) for c in names), F.lit(0))
    narrow = F.col("hi") - F.col("lo") + 1 <= WIDTH * F.col("grams") + GAP
    share = F.when(F.col("weak"), 0.0).when(F.col("is_base"), (F.col("n") == F.col("grams")).cast("double")).when(narrow, F.least(F.lit(1.0), number / F.col("grams"))).otherwise(0.0)
    places = places.withColumn("share", F.coalesce(share, F.lit(0.0)))
    places = places.withColumn("ok", F.coalesce(F.col("share") >= F.when(F.col("is_base"), 1.0).otherwise(LEAST_SHARE), F.lit(False)))
    base = F.col("ok") & is_base
    aggregates = [
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        *masks(F.col("template"), len(PHRASES) + len(NOTICES), "mask", F.col("ok")), F.max("share").alias("score"),
    ]
    if spans:
        k = F.when(F.col("is_base"), PHRASE_K).otherwise(NOTICE_K)
        aggregates.append(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct(F.col("lo").alias("first"), (F.col("hi") + k - 1).alias("last"), "label", "is_base", "share")))).alias("spans"))
    out = places.groupBy(*key, "times").agg(*aggregates)
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(
        *[F.col(i).alias(c) for i, c in zip(ids, id_cols, strict=True)], "n_words", "n_base", "first_word", "last_word",
        names_of(rows, True).alias("base_labels"), names_of(rows, None).alias("labels"), "score", *["spans"] * spans,
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, ["doc_id"])
