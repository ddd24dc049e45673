import collections
import hashlib
import os

import pytest

from .test_text_operators import SF, brute_classes, brute_grams, brute_languages, vocab_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def language_kept(rows):
    """Ids of texts in a learned language, by sets of n-grams as strings; and those too near to the limit to tell."""
    known, _ = brute_languages(rows)
    kept, near = set(), set()
    for r in rows:
        hits, grams = collections.Counter(), brute_grams(r["text"])
        for g, n in grams.items():
            hits.update({x: n for x in known.get(g, ())})
        share = max(hits.values(), default=0) / max(1, sum(grams.values()))
        if abs(share - corpus_pipeline.LEAST_KNOWN) < 0.01:
            near.add(r["doc_id"])
        elif share >= corpus_pipeline.LEAST_KNOWN:
            kept.add(r["doc_id"])
    return kept, near


def by_sql(sql, docs, columns):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    return c.sql(sql).select(*columns).fetchall()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark):
    """Every stage's rows, on what its predecessor kept: strings, SQL, all pairs and tiktoken."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p

    from driftlens.llm import mixing, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_dedup", "mixing", "byte_bpe"]
    before = {r["doc_id"]: r for r in docs.collect()}
    same = lambda rows: all(before[r["doc_id"]] == r for r in rows)

    one = stages["language_id"](spark, docs, SF).cache()
    rows = one.collect()
    kept, near = language_kept(list(before.values()))
    ids = {r["doc_id"] for r in rows}
    assert one.columns == columns and same(rows) and len(ids) == len(rows) and ids - near == kept and len(near) <= 2

    two = stages["quality_rules"](spark, one, SF).cache()
    rows = two.collect()
    want = {i for i, k in by_sql(quality_rules.ORACLE_SQL, one, ["doc_id", "kept"]) if k}
    assert two.columns == columns and same(rows) and sorted(r["doc_id"] for r in rows) == sorted(want)

    three = stages["near_dedup"](spark, two, SF).cache()
    groups = brute_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = three.collect()
    assert three.columns == columns and same(rows) and sorted(r["doc_id"] for r in rows) == sorted(i for i, g in groups.items() if i == g)

    four = stages["mixing"](spark, three, SF).cache()
    rows = four.collect()
    want = collections.Counter({i: taken // size for i, size, taken in by_sql(mixing.ORACLE_SQL, three, ["doc_id", "size", "taken"]) if taken})
    assert four.columns == columns and same(rows) and collections.Counter(r["doc_id"] for r in rows) == want

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    five = corpus_pipeline.run(spark, SF).collect()
    told = collections.Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in five)
    ids_of = {i: enc.encode_ordinary(before[i]["text"]) for i in want}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert told == collections.Counter((r["doc_id"], r["source"], len(x := ids_of[r["doc_id"]]), sha(",".join(map(str, x)).encode()), sha(r["text"].encode())) for r in rows)


def test_odd_tables(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names; an empty table."""
    word = lambda k: ("river forest market winter doctor garden letter summer bridge silver".split() * 3)[k % 30] + ("" if k < 10 else "abcdefghij"[k % 10] * (k % 4) + str(k))
    long_ = " ".join(word(k * 7919 % 40_009) for k in range(40_000))
    good = " ".join(word(k) for k in range(10, 60))
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "!!! 12", "en", "a", 6, "x"), (4, long_, "en", None, 1, "x"), (5, good, "en", "b", 1, "x"), (5, good, "en", "b", 1, "x"),
        (6, good, "en", "b", 1, "x"), (None, good + " more words of another end", "en", None, 5, "x"), (7, "same " * 200, "en", "b", 1, "x"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __own string")
    for c in ("__copy", "__digest", "row", "node", "id", "own", "key"):
        d = d.withColumn(c, d["__own"])
    docs = d
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == d.columns, name
    got = collections.Counter((r["doc_id"], r["__copy"]) for r in docs.collect())
    assert set(got) == {(4, "x"), (5, "x")}  # of the copies the first id stays; what is no language, empty or repeated goes
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").filter("round_trip").count() == sum(got.values())
    docs = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
