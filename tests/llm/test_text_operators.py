"""The ten operators against brute force, round trips, held-out accuracy and odd tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftlens.llm import bpe, chat, fingerprint, kernels, language_id, license_scan, mixing, near_dup, quality_model, quality_rules, shared, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for on with as by at from this have not are but".split()


CLASHES = (
    "node key size bucket rn shard rank score __text labels next kept row lang_pred base top __own __copy __source __digest __id __node __0 __t "
    "id own digest place copies taken nth at range times part nd r x p a b c n k hashes id_0 row_id cut last"
).split()


def vocab_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", str(rng.randrange(9999))]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing extra columns."""
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("the", "teh", 1), "en", "b", 1), (4, None, "en", "b", None), (5, "", None, "c", 0), (6, " \n\t ", "en", None, 4),
        (None, prose(rng, 50), "en", "a", 9), (8, prose(rng, 30_000), "de", "a", 9), (9, "!!! 123  ", "en", "c", 3), (10, "mit license", "en", "c", 3), (10, "mit license", "en", "c", 3), (11, "gnu", None, None, None),
    ]
    d = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_rolling_hashes_and_runs():
    texts = ["ab  cd ab", None, "", "ab"]
    b = kernels.Block(texts)
    s, e = b.runs(~kernels.is_space(b.cps))
    h = b.hashes(s, e)
    assert (e - s).tolist() == [2, 2, 2, 2] and b.ptr(s).tolist() == [0, 3, 3, 3, 4]
    assert h[0] == h[2] == h[3] != h[1]
    g, at = kernels.ngrams(h, b.ptr(s), 2)
    assert at.tolist() == [0, 1]
    assert list(kernels.blocks(["x" * 10] * 5, 20)) == [(0, 2), (2, 4), (4, 5)]


def test_bpe_equals_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p
    import regex

    path = vocab_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bpe.vocabulary(path)
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "é", "1", "½", "!", "😀", "\x1c", "\x85", "́", "中", "\r\n", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", "a" * 5000, "ab" * 3000, "é" * 500 + " " * 500, "!" * 2000, *("a" + chr(c) + "b " + chr(c) + "1" for c in range(0x3000))]
    for t, (raw, ids, offs, first) in zip(texts, bpe.encode_block(texts, v), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t or "")
        assert v.decode(ids, first, offs) == (t or "").encode() == raw
        assert len(offs) == len(first) and (len(offs) == 0 or offs[0] == first[0] == 0)
        pieces = regex.findall(p.PATTERN, t or "")
        assert offs.tolist() == np.cumsum([0, *(len(x.encode()) for x in pieces)])[:-1].tolist()


def test_scan_is_associative():
    ids = np.array([random.Random(2).randrange(len(bpe.monoid()[1])) for _ in range(1500)], np.uint8)
    product = bpe.monoid()[0]
    want, acc = [], 0
    for i in ids:
        acc = product[acc, i]
        want.append(acc)
    assert bpe.scan(ids).tolist() == want


def test_bpe_table(odd, none, spark):
    path = vocab_path()
    out = bpe.decode(bpe.encode(odd, path, ["doc_id", "text"]), path, out="back").collect()
    assert len(out) == 12 and all(r["back"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in out)
    assert bpe.encode(none, path, ["doc_id"], digests=True).count() == 0
    for a, b in ((0, 5), (3, 17), (100, 700), (10**7, 10**8), (4, 4)):  # byte spans by the retained offsets
        for r in bpe.decode_span(bpe.encode(odd, path, ["doc_id", "text"]), path, a, b, out="back").collect():
            assert r["back"] == (r["text"] or "").encode()[a:b].decode("utf-8", "replace")
    r = bpe.encode(odd.filter("doc_id = 1"), path, ["doc_id", "text"], digests=True).first()
    assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bpe_query_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def brute_rules(t):
    w, seen, cover, lines, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), collections.defaultdict(list), set(), set(), 0
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for v in seen.values():
        if len(v) > 1:
            cover |= {i + j for i in v for j in range(5)}
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_rules(odd, none):
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a\na\n \n \na"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(300))) for _ in range(800)]
    m = quality_rules.measure(texts, (5, 10))
    for i, t in enumerate(texts):
        assert brute_rules(t) == tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    got = quality_rules.rules(odd, ["doc_id", "text"]).collect()
    assert len(got) == 12
    for r in got:
        n, *_, rep = brute_rules(r["text"])
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and (not r["base_failed"] or not r["kept"])
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3}
    assert quality_rules.keep_good(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_rules_equal_sql(spark, odd):
    import duckdb

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rng = random.Random(5)
    texts = ["", *("".join(rng.choice(["aa", "b", "cd\n", "\n", "é😀", "#", "x2"]) + rng.choice([" ", " ", "\r\n", "\v"]) for _ in range(rng.randrange(120))) for _ in range(200))]
    made = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    tables = [spark.read.parquet(f"{SF}/documents.parquet"), odd.select("doc_id", "text"), made]
    for docs in tables:
        c = duckdb.connect()
        c.register("documents", docs.select("doc_id", "text").toArrow())
        want = collections.Counter(c.sql(quality_rules.ORACLE_SQL).select(*cols).fetchall())
        assert want == collections.Counter(map(tuple, quality_rules.rules(docs, ["doc_id"]).select(*cols).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_held_out(spark, odd, none):
    out = language_id.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.95 and out.score.between(0, 1).all()
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), language_id.learnable())
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd, model, ["doc_id", "text"]).collect()}
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) for (_, t), r in got.items())
    assert language_id.identify(none, model, ["doc_id"]).count() == 0
    empty = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, empty, ["doc_id"]).collect()} == {"und"}
    two = spark.createDataFrame([(i, ("the cat " if i % 2 else "le chat noir ") * (8_000 if i % 2 else 4), "en" if i % 2 else "fr", None, 1) for i in range(8)], DOCS)
    both = language_id.fit(two)  # all texts of one language are very long
    assert both.languages == ["en", "fr"] and language_id.decide(["a cat", "le noir"], both)[0] == ["en", "fr"]
    with pytest.raises(ValueError):
        language_id.fit(two, settings=language_id.Settings(most_languages=1))
    many = language_id.fit(spark.createDataFrame([(i, prose(random.Random(i // 4), 60) + chr(0x3B1 + i // 4) * 3, f"l{i // 4:03}", None, 1) for i in range(280)], DOCS), settings=language_id.Settings(least_docs=1))
    assert len(many.languages) == 70 and many.table.shape[0] == 2


def brute_grams(t):
    """Counts of n-grams within blank-padded words of folded letters and marks."""
    import regex

    out = collections.Counter()
    for w in regex.findall(r"[\p{L}\p{M}]+", t or ""):
        w = f" {''.join(c.lower() if len(c.lower()) == 1 else c for c in w)} "
        for n in (3, 4):
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def brute_languages(rows, s=language_id.Settings()):
    """Languages of each n-gram, and the number of learnable texts of each language."""
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]
    df, size = collections.defaultdict(collections.Counter), collections.Counter(r["lang"] for r in learn)
    for r in learn:
        for g in brute_grams(r["text"]):
            df[g][r["lang"]] += 1
    known = {}
    for g, n in df.items():
        share = {x: k / size[x] for x, k in n.items() if k >= min(s.least_docs, size[x])}
        known[g] = {x for x, v in share.items() if v >= s.least_share * max(share.values())} if share else set()
    return known, size


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_id_equals_brute_force(spark):
    """The query's decisions against sets of n-grams as strings, without filters."""
    sf = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    known, size = brute_languages(rows)
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    differ = 0
    for r in rows:
        hits, grams = collections.Counter(), brute_grams(r["text"])
        for g, n in grams.items():
            hits.update({x: n for x in known.get(g, ())})
        best = max(sorted(size), key=lambda x: hits[x]) if hits else None
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if hits:
            differ += mine["lang_pred"] != best
            assert abs(mine["known"] - hits[mine["lang_pred"]] / sum(grams.values())) < 0.02  # the filters' false positives are taken off
    assert differ <= len(rows) // 200  # near ties only


def brute_ftrl(rows, s):
    """FTRL-proximal on dictionaries, by its published formula; a bias with the value 0.3."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= s.l1 else -(z[f] - math.copysign(s.l1, z[f])) / ((s.beta + math.sqrt(n[f])) / s.alpha + s.l2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))

    for _ in range(s.epochs):
        for x, y in rows:
            p = chance(x)
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * weight(f)
                n[f] += g * g
    return chance


def test_quality_classifier_equals_brute_force(spark, monkeypatch):
    """Scores against plain FTRL; one label has very long texts only; feature rows are read slice by slice."""
    monkeypatch.setattr(quality_model, "HELD_BYTES", 0)
    rng = random.Random(21)
    rows = [(i, prose(rng, 4_000 if i % 2 else 60) + (" good" if i % 2 else " bad bad"), i % 2) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[3][:2]], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], "x") for r in rows], "doc_id long, quality int, __id string")
    s = quality_model.Settings()
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs, quality_model.fit(docs, labels), ["doc_id"]).collect()}
    key = docs.join(labels, "doc_id").select("doc_id", F.xxhash64(F.lit(11), "doc_id", "quality").alias("key")).orderBy("key", "doc_id").collect()
    bucket, value, at = quality_model.features([r[1] for r in rows], s)
    made = [{"bias": 0.3} | dict(zip(bucket[a:b].tolist(), value[a:b].tolist(), strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
    chance = brute_ftrl([(made[r["doc_id"]], rows[r["doc_id"]][2]) for r in key], s)
    assert all(abs(got[i] - chance(made[i])) < 1e-3 for i, _, _ in rows)
    assert np.mean([got[i] > 0.5 for i, _, y in rows if y]) > 0.95 and np.mean([got[i] < 0.5 for i, _, y in rows if not y]) > 0.95


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_classifier(spark, odd, none):
    sf = SF.replace("0.001", "0.01")
    out = quality_model.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), np.sort(out[out.quality == 0].score.to_numpy())
    assert np.searchsorted(bad, good).mean() / len(bad) >= 0.95
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (1, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd, labels)
    assert quality_model.score(odd, model, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == 12
    blank = quality_model.fit(none, labels)
    assert {r["score"] for r in quality_model.score(odd, blank, ["doc_id"]).collect()} == {0.5}


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    at, labels = [], set()
    for p, label in license_scan.PHRASES.items():
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_notices_equal_brute_force(spark):
    """Share of a notice's places whose three-word gram the text has, for notices with words left out."""
    rng = random.Random(32)
    rows, want = [], {}
    for k, (text, label) in enumerate(license_scan.NOTICES * 8):
        w = text.split()
        gone = set(rng.sample(range(len(w)), rng.randrange(0, max(1, len(w) // 12) + 1)))
        left = [x for i, x in enumerate(w) if i not in gone]
        lines = collections.Counter(sum(j < i for j in gone) for i in range(len(w) - 2) if not gone & {i, i + 1, i + 2})
        share = sum(n for n in lines.values() if n > 1 or len(w) <= 5) / (len(w) - 2)  # a place alone on its diagonal doesn't count
        rows.append((k, " ".join(["zz"] * 7 + left + ["yy"] * 5)))
        want[k] = (label, share)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], spans=True).collect():
        label, share = want[r["doc_id"]]
        near = 1e-9 + 2 / (len(license_scan.NOTICES[r["doc_id"] % len(license_scan.NOTICES)][0].split()) - 2)  # grams that a notice has twice
        assert (label in r["labels"].split(",")) == (share >= license_scan.LEAST_SHARE) or abs(share - license_scan.LEAST_SHARE) <= near
        for span in r["spans"]:
            if span["label"] == label:
                assert abs(span["share"] - share) <= near and 7 <= span["first"] <= 12


def test_license_masks_grow(spark, monkeypatch):
    """More templates and grams than a mask word holds."""
    rng = random.Random(31)
    notices = [(" ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(300 if k % 9 == 0 else 12)), f"l{k:03}") for k in range(150)]
    monkeypatch.setattr(license_scan, "NOTICES", notices)
    df = spark.createDataFrame([(k, f"before {text} after") for k, (text, _) in enumerate(notices)], "doc_id long, text string")
    assert all(r["labels"] == notices[r["doc_id"]][1] and r["score"] == 1.0 for r in license_scan.scan(df, ["doc_id"]).collect())


def test_license_scan(spark, odd, none):
    rng = random.Random(3)
    some = ["gnu", "general", "public", "license", "Apache", "cc", "BY", "mit", "the", "x9", "é", "-", "MIT license"]
    texts = [None, ""] + [" ".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(500)]
    notice = license_scan.NOTICES[3][0].split()
    texts += [" ".join(["before"] * 5 + notice[:20] + ["inserted"] + notice[20:40] + notice[42:] + ["after"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df, ["doc_id"], spans=True).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert brute_license(t) == (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
    last = got[len(texts) - 1]
    assert last["labels"] == "mit-text" and last["spans"][0]["first"] == 5 and 0.7 <= last["score"] < 1
    for i in range(len(texts) - 1):  # no notice in these
        assert got[i]["labels"] == got[i]["base_labels"] and (got[i]["score"] == 1.0) >= (got[i]["n_base"] > 0)
    once = collections.Counter(map(str, license_scan.scan(df, ["doc_id"]).collect()))
    twice = collections.Counter(map(str, license_scan.scan(df.unionByName(df).repartition(3), ["doc_id"]).collect()))
    assert twice == once + once  # equal rows each get theirs
    assert license_scan.scan(odd, ["doc_id", "score"]).count() == 12 and license_scan.scan(none, ["doc_id"]).count() == 0


def brute_classes(rows, s=near_dup.Settings(), pairs=None):
    grams = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    df = collections.Counter(g for c in grams.values() for g in c)
    n = len(rows)
    idf = lambda k: 1 + math.log((1 + n) / (1 + k)) / math.log(1 + n)
    weight = {g: idf(k) / idf(1) for g, k in df.items()}
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, ta) in enumerate(rows):
        for b, tb in rows[k + 1 :]:
            if ta is None or tb is None:
                continue
            low = sum(min(x, grams[b][g]) * weight[g] for g, x in grams[a].items() if g in grams[b])
            high = sum(x * weight[g] for i in (a, b) for g, x in grams[i].items()) - low
            if ta == tb or (high and low / high >= 0.8):
                if pairs is not None and ta != tb:
                    pairs.append((a, b))
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_near_dup_classes(spark, odd, none):
    rng = random.Random(6)
    rows, n = [], 0
    for g in range(12):
        base = prose(rng, 150).split()
        for k in range(14):
            w = base[:]
            for _ in range(k):  # from exact copies to texts below the threshold
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "a b"), (n + 5, "a  b"), (n + 6, "a b c")]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = []
    want = brute_classes(rows, pairs=pairs)
    assert got == want
    found = {r["doc_id"]: r for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for p in pairs for i in p} >= {i for i, r in found.items() if r["links"]} >= {i for i, r in found.items() if r["class_texts"] > 1}
    out = near_dup.classes(odd).collect()
    assert len(out) == 12 and {r["doc_id"]: r["class_id"] for r in out}[3] == 1
    kept = near_dup.keep_one(odd)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert kept.columns == odd.columns and [i for _, i in ids] == [1, 4, 5, 6, 8, 9, 10, 11, 0]
    assert near_dup.classes(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_near_dup_classes_of_repeated_lines(spark):
    """Counts weigh in the candidate search as they do in the similarity."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for g in range(24):
        again = [word() for _ in range(10)] * 200 if g % 2 else [word()] * 2000
        rows += [(2 * g + k, " ".join(again + [word() for _ in range(60 if g < 12 else 300)])) for k in (0, 1)]  # 0.94; below 0.8
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) == 36


def test_sampling_follows_counts_and_weights():
    s = near_dup.Settings()
    rng = random.Random(14)
    w = np.where(np.random.default_rng(14).random(2 << s.counters) < 0.3, 0.05, 1).astype(np.float32)
    agree, sim = [], []
    for k in range(60):
        texts = [" ".join(["line of six words in it"] * 3 * k + [str(rng.randrange(10**9)) for _ in range(20)]) for _ in range(2)]
        sig = near_dup.signature(*near_dup.shingles(texts, 5), w, s)
        agree.append((sig[0] == sig[1]).mean())
        sim.append(near_dup.similarities(texts[:1], texts[1:], w, s)[0])
    assert np.abs(np.array(agree) - sim).max() < 0.2 and abs(np.mean(agree) - np.mean(sim)) < 0.02


def test_remaining_pairs_are_exact(spark):
    """The prefix filter finds every pair above the threshold among texts that are all apart."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((f"{i:02}", f"{i:02}", " ".join(w)))
    rows = list({t: (a, b, t) for a, b, t in rows}.values())
    s = near_dup.Settings()
    weight = np.random.default_rng(8).uniform(0.5, 1, 2 << s.counters).astype(np.float32)
    found = near_dup.remaining(spark.createDataFrame(rows, "node string, root string, text string"), spark.sparkContext.broadcast(weight), s)
    got = {(r["a"], r["b"]) for r in found.collect()}
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    sim = near_dup.similarities([a[2] for a, _ in pairs], [b[2] for _, b in pairs], weight, s)
    want = {tuple(sorted((a[0], b[0]))) for (a, b), x in zip(pairs, sim, strict=True) if x >= s.similarity}
    assert want and want <= got


def test_rare_shingles_weigh_more(spark):
    """Smoothed inverse document frequencies, as exact ones by strings, for rare and common shingles."""
    rng = random.Random(17)
    rows = [(i, f"one two three four five {' '.join(f'w{rng.randrange(10**9)}' for _ in range(30))}" + (" six seven eight nine ten" if i % 4 == 0 else "")) for i in range(400)]
    s = near_dup.Settings()
    table = near_dup.frequencies(spark.createDataFrame(rows, "doc_id long, text string"), "text", s)
    of = lambda t: float(near_dup.weights_of(near_dup.shingles([t], 5)[0], table, s)[0])
    every, some, rare = of("one two three four five"), of("six seven eight nine ten"), of(" ".join(rows[7][1].split()[8:13]))
    want = lambda df: (1 + math.log(401 / (1 + df)) / math.log(401)) / (1 + math.log(401 / 2) / math.log(401))
    assert every < some < rare == 1.0
    assert abs(every - want(400)) < 0.03 and abs(some - want(100)) < 0.03


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_dup_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pairs = []
    brute_classes(rows, pairs=pairs)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op3_minhash_near_dup(spark, SF).collect()}
    text = dict(rows)
    pairs += [(a, b) for k, (a, ta) in enumerate(rows) for b, tb in rows[k + 1 :] if ta is not None and ta == tb]
    assert pairs and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.95
    for a, b in ((a, b) for a in got for b in got if a < b and got[a] == got[b]):
        assert set(text[a].split()) & set(text[b].split())


def test_equal_rows_of_a_class(spark):
    """Of rows with equal id and text the same one stays whatever the layout."""
    df = spark.createDataFrame([(1, "a b c d e f", str(k)) for k in range(20)] + [(2, "a b c d e f", "z"), (3, None, "n"), (3, None, "m")], "doc_id long, text string, __digest string")
    kept = [sorted(map(tuple, near_dup.keep_one(df.repartition(k)).collect()), key=str) for k in (1, 5)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3, 3]


def test_components_of_chains(spark):
    rng = random.Random(9)
    names = [f"n{i:03}" for i in range(120)]
    rng.shuffle(names)
    links = spark.createDataFrame([(a, b) for k, (a, b) in enumerate(zip(names, names[1:], strict=False)) if k != 60], "a string, b string")
    got = {r["node"]: r["root"] for r in near_dup.components(links).collect()}
    halves = [names[:61], names[61:]]
    for h in halves:
        assert {got.get(x, x) for x in h} == {min(h)}


def test_sampling_estimates_similarity():
    s = near_dup.Settings()
    rng = random.Random(10)
    a = prose(rng, 3000).split()
    b = a[:]
    for i in range(0, 3000, 60):
        b[i] = "other"
    w = np.ones(2 << s.counters, np.float32)
    texts = [" ".join(a), " ".join(b)]
    sig = near_dup.signature(*near_dup.shingles(texts, 5), w, s)
    assert abs((sig[0] == sig[1]).mean() - near_dup.similarities(texts[:1], texts[1:], w, s)[0]) < 0.15


def paragraphs(t):
    out = set()
    for x in re.split(r"[.!?]+\s+|[\r\n]+|[。！？｡．؟۔।॥။።]+\s*", t):
        units = [x]
        if len(x) > 512:
            units = re.split(r"(?<=\s)(?=\S)", x, flags=re.A)
            units = units if 32 * len(units) >= len(x) else list(x)
        at = 0
        for i in range(4, len(units)):
            if xxhash.xxh64_intdigest("".join(units[i - 4 : i]).encode(), 42) % 16 == 0:
                out.add("".join(units[at:i]))
                at = i
        out.add("".join(units[at:]))
    return out - {""}


def digests_of(t):
    return {xxhash.xxh64_intdigest(x.encode(), 42) for x in paragraphs(t)}


def peel_printed(printed):
    """Digests of a printed fingerprint, by plain peeling; None if it can't be peeled."""
    bits, cells = printed.split("/")
    table = {}
    for c in filter(None, cells.split(";")):
        at, *n, k = c.split(".")
        table[int(at, 16)] = [int(n[0]) if n else 1, int(k, 16)]
    found = set()
    while lone := next((v[1] for v in table.values() if v[0] == 1), None):
        found.add(lone)
        for r in range(3):
            v = table[((lone >> 21 * r) & ((1 << int(bits)) - 1)) << 2 | r]
            v[0], v[1] = v[0] - 1, v[1] ^ lone
    return None if any(v[0] for v in table.values()) else found


def brute_fingerprints(rows):
    """(id, text) -> expected values, in a list for equal rows; rows in descending order of the id, ties by digest."""
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, -np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)), reverse=True)
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    out = collections.defaultdict(list)
    for k, (i, t) in enumerate(down):
        t, nxt = t or "", down[(k + 1) % len(down)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, b, c = map(digests_of, (t, edited, nxt))
        signed = lambda x: sorted(v - (v >> 63 << 64) for v in x)
        out[i].append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9), len(a), signed(a - b), signed(b - a)))
    return out


def same_fingerprints(spark, rows, kind="long", layout=1):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(layout)
    got = collections.defaultdict(list)
    for r in fingerprint.fingerprints(df).collect():
        got[r["doc_id"]].append((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["n_paragraphs"], list(r["only_text"]), list(r["only_edited"])))
    want = brute_fingerprints(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def fingerprint_rows(rng):
    texts = [". ".join(prose(rng, 8) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "é😀x", "é😀x"]
    return list(enumerate(texts))


def test_fingerprints(spark, odd, none):
    rows = fingerprint_rows(random.Random(11))
    same_fingerprints(spark, rows)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[62]["fingerprint"] == got[63]["fingerprint"] != got[1]["fingerprint"]
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, t in rows:  # the likenesses follow from the printed fingerprints
        a, b, c = (peel_printed(x) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[(i - 1) % len(rows)]["fingerprint"]))
        assert a == digests_of(t or "")
        assert abs(got[i]["near_edited"] - like(a, b)) < 1e-9 and abs(got[i]["near_next"] - like(a, c)) < 1e-9
    assert fingerprint.fingerprints(odd).count() == 12 and fingerprint.fingerprints(none).count() == 0
    assert fingerprint.fingerprints(spark.createDataFrame([(7, "a. b")], "doc_id long, text string")).first()["near_next"] == 1.0


def test_fingerprints_of_other_ids(spark, monkeypatch):
    rows = fingerprint_rows(random.Random(12))
    same_fingerprints(spark, [(f"é{i:03}", t) for i, t in rows], "string", 3)
    # A hot id, and equal rows above the number that is counted.
    monkeypatch.setattr(fingerprint, "COPIES", 3)
    same = [(None, t) for _, t in rows[:40]] + [(5, "a. b. c")] * 11 + [(5, "x. y")] * 2 + [(9, "q. r")] * 4 + rows[50:]
    same_fingerprints(spark, same, layout=4)
    same_fingerprints(spark, [(3, "one. two")] * 9)


def test_fingerprints_that_need_larger_sketches(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, ". ".join(prose(rng, 4) for _ in range(3 * i))) for i in range(25)] + [(30, "\n".join(str(k) for k in range(9_000)))]
    monkeypatch.setattr(fingerprint, "SPREAD", 0)  # all first sketches have 3 x 4 cells
    monkeypatch.setattr(fingerprint, "LEAST", 4)
    same_fingerprints(spark, rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mixing(spark, odd, none):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op7_mixing(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert got.equals(want)
    out = mixing.plan(odd, range_rows=1).toPandas()
    assert len(out) == 12 and (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby(out.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(g["size"].max(), 1)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == out.copies.sum()
    assert set(map(str, mixed.collect())) <= set(map(str, odd.collect()))
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert spark.createDataFrame([(" a\tb\x0bc d ",), (None,)], "text string").select(mixing.size_of()).toPandas().iloc[:, 0].tolist() == [3, 0]


def test_mixing_of_hot_rows(spark, monkeypatch):
    """Equal rows and repeated ids lie in many ranges, and the cut may fall among equal rows."""
    rows = [(7, "a b c", "x")] * 3_000 + [(None, f"w{k} z", "y") for k in range(1_500)] + [(k, "p q", "z") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tables = {}

    def kept(d, name):
        tables[name] = shared.written(d, name)
        return tables[name]

    monkeypatch.setattr(mixing, "written", kept)
    out = mixing.plan(df, range_rows=100, part_rows=50).toPandas()
    assert len(out) == len(rows)
    size = tables["ranges"].groupBy("range").count().toPandas()["count"]
    assert len(size) >= 40 and size.max() <= 300  # of 4,600
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3
    monkeypatch.undo()
    assert mixing.mix(df, range_rows=100).groupBy("source").count().orderBy("source").collect() == [(s, g.copies.sum()) for s, g in out.groupby("source")]


def test_chat_blocks_give_the_same_rows(spark):
    """All block sizes, against plain dynamic programming with the stated tie rule; roles, actions and text."""
    rng = random.Random(7)
    names = ["oops", "system", " User", "ASSISTANT", None]
    rows = [(c if c else None, rng.choice([i, i, None]), rng.choice(names), rng.choice(["t", None, "x" * 20_000 if c == 3 else "u"])) for c in range(40) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("block", "conv", "at", "start", "none", "c", "code", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    cols = ["conv", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
    want = collections.Counter()
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is None, t or 0, r is not None, r or "", np.uint64(xxhash.xxh64_intdigest((x or "").encode(), 42)).astype(np.int64), t, r, x or ""))
    for c, turns in groups.items():
        turns.sort(key=lambda t: t[:5])
        given = [chat.ROLES.index(n) if (n := (t[6] or "").strip().lower()) in chat.ROLES[1:] else 0 for t in turns]
        best = {0: (0, [])}
        for g in given:
            new = {}
            for q in (1, 2, 3):
                ways = []
                for s, (cost, path) in best.items():
                    w, action, inserted = chat.STEPS[g][s][q]
                    if w < chat.INF:
                        ways.append((cost + w, action, s, [*path, (s, q, w, action, inserted)]))
                if ways:
                    top = min(ways, key=lambda w: w[:3])
                    new[q] = (top[0], top[3])
            best = new
        q = min(best, key=lambda s: (best[s][0] + int(chat.END_COST[s]), s))
        for k, (t, (s, q_, w, action, inserted)) in enumerate(zip(turns, best[q][1], strict=True)):
            last = k == len(turns) - 1
            tag = lambda r: f"<|{chat.ROLES[r]}|>\n"
            said = "\n" + t[7] if "merge" in chat.ACTIONS[action] else ("<|end|>\n" if s else "") + "".join(tag(p) + "<|end|>\n" for p in inserted) + tag(q_) + t[7]
            if last:
                said += "<|end|>\n" + "".join(tag(p) + "<|end|>\n" for p in chat.ENDS[q_])
            want[c, t[5], t[6], chat.ROLES[q_], chat.ACTIONS[action], len(inserted), w + (int(chat.END_COST[q_]) if last else 0), said] += 1
    for turns in (1024, 9, 4):
        assert collections.Counter(map(tuple, chat.repair(df, block_turns=turns).select(*cols).collect())) == want


def test_chat_repair(spark):
    rng = random.Random(5)
    names = ["oops", "system", " User", "ASSISTANT"]

    def brute(roles):
        cost = {chat.START: 0}
        for r in roles:
            new = {}
            for s, x in cost.items():
                for q in (1, 2, 3):
                    own = 0 if q == r else chat.COST_RELABEL
                    ways = [own + chat.COST_MERGE] if q == s else []
                    if (path := chat.between(s, q)) is not None:
                        ways.append(own + chat.COST_INSERT * len(path))
                    for y in ways:
                        new[q] = min(new.get(q, 10**9), x + y)
            cost = new
        return min(x + chat.COST_INSERT * len(chat.ENDS[s]) for s, x in cost.items())

    rows, want = [], {}
    for c in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        want[c] = brute(roles)
        rows += [(c, i, names[r], f"t{i}", "clash") for i, r in enumerate(roles)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    for turns in (1024, 7):
        for r in chat.render(df, block_turns=turns).collect():
            assert r["cost"] == want[r["conv_id"]]
            said = ["start", *re.findall(r"<\|(system|user|assistant)\|>", r["rendered"])]
            assert said[-1] == "assistant" and all(chat.ROLES.index(b) in chat.NEXT[chat.ROLES.index(a)] for a, b in zip(said, said[1:], strict=False))
    odd = spark.createDataFrame([(None, None, None, None), (1, None, "user", "x"), (1, 0, "user", None), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert chat.repair(odd).count() == 4 and chat.repair(odd.limit(0)).count() == 0


def test_sharding(spark, odd, none):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    a, b = (sharding.assign(df.repartition(k), 8, range_rows=50).toPandas().sort_values("id") for k in (3, 5))
    assert (a[["id", "shard", "slot"]].to_numpy() == b[["id", "shard", "slot"]].to_numpy()).all()
    n = a.groupby("shard").size()
    assert n.max() - n.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in a.groupby("shard"))
    assert abs(np.corrcoef(a.id, a.shard)[0, 1]) < 0.15 and abs(np.corrcoef(a.id, a.slot)[0, 1]) < 0.15
    m = sharding.matrix([10, 0, 25, 7], sharding.capacities(42, 4), [1])
    assert m.sum(1).tolist() == [10, 0, 25, 7] and sorted(m.sum(0).tolist()) == [10, 10, 11, 11] and (m >= 0).all()
    out = sharding.assign(odd).toPandas()
    assert len(out) == 12 and (out["size"] >= 1).all()
    assert sharding.assign(none).count() == 0


def test_draws_of_all_sizes():
    rng = np.random.default_rng(3)
    for good, bad, n in ((40, 70, 30), (5, 3, 4), (1, 9, 5), (300, 2, 290)):
        p = np.array([math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) if n - x >= 0 else 0 for x in range(min(n, good) + 1)])
        got = np.bincount([sharding._draw(rng, good, bad, n) for _ in range(20_000)], minlength=len(p)) / 20_000
        assert np.abs(got - p).max() < 0.015
    big = np.array([sharding._draw(rng, 10**11, 7 * 10**11, 20_000) for _ in range(2_000)])
    assert abs(big.mean() - 2500) < 6 and abs(big.var() / 2187.5 - 1) < 0.15
    assert sharding._draw(rng, 10**9, 5, 10**9 + 2) in range(10**9 - 3, 10**9 + 1) and sharding._draw(rng, 4, 0, 3) == 3


def test_two_levels_keep_the_margins(spark, monkeypatch):
    """The matrix of groups and their partitions has exact sums, and cells follow the hypergeometric distribution."""
    monkeypatch.setattr(sharding, "GROUP", 3)
    rows = [(p, 5 + p % 4) for p in range(10)]
    counts = spark.createDataFrame(rows, "part bigint, n bigint")
    total, seen = sum(n for _, n in rows), []
    for seed in range(60):
        m = np.array([np.diff([0, *r["cuts"]]) for r in sorted(sharding.drawn(counts, 4, seed).collect())])
        assert m.sum(1).tolist() == [n for _, n in rows] and m.sum(0).tolist() == sharding.capacities(total, 4) and (m >= 0).all()
        seen.append(m)
    share = np.mean(seen, axis=0) / np.array([n for _, n in rows])[:, None]
    assert np.abs(share - 0.25).max() < 0.12


def brute_sharding(rows, shards, seed=sharding.SEED):
    """Any rows: only the law, the sizes and the slots are determined; places must be a permutation that ignores ids."""
    n = len(rows)
    return sorted([n // shards + (s < n % shards) for s in range(shards)], reverse=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sharding_query_against_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op10_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        t = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t) if rows[r["doc_id"]] is not None else None)
        assert r["law"] == "rows" and r["grown_shard"] is None
    places = collections.defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert [len(places[s]) for s in range(8)] == brute_sharding(rows, 8) and all(sorted(v) == list(range(len(v))) for v in places.values())


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    df = spark.createDataFrame([(7, "same")] * 10_000 + [(None, f"t{k}") for k in range(5_000)], "doc_id long, text string")
    found = {}

    def counted(counts, shards, seed):
        found["parts"] = counts.toPandas()
        return drawn(counts, shards, seed)

    drawn = sharding.drawn
    monkeypatch.setattr(sharding, "drawn", counted)
    out = sharding.assign(df, 4, range_rows=500).toPandas()
    assert found["parts"].n.max() <= 3_000 and len(found["parts"]) >= 25 and len(out) == 15_000
    hot = out[out["size"] == 5].groupby("shard").size()
    assert len(hot) == 4 and hot.max() - hot.min() < 300  # equal rows are spread over all shards
    slots = out[(out["size"] == 5) & (out.shard == 0)].slot
    assert slots.std() > 900  # and over all slots


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/out", 3)
    out = spark.read.parquet(f"{tmp_path}/out")
    places = [(r["shard"], r["slot"]) for r in out.select("shard", "slot").collect()]
    assert sorted(places) == [(s, k) for s in range(3) for k in range(4)]  # repeated rows have a slot each
    assert set(out.columns) == {*odd.columns, "slot"}


def test_weighted_sampling_of_real_weights():
    """Agreement equals the weighted Jaccard similarity for real weights on both sides, also where only weights differ."""
    rng = np.random.default_rng(21)
    s = near_dup.Settings(bands=256, rows=16)
    for k in range(6):
        keys = np.sort(rng.integers(0, 1 << 52, 60).astype(np.uint64))
        table = rng.uniform(0.5, 1, 2 << s.counters).astype(np.float32)
        counts = [rng.integers(1, 2 + 3 * k, 60), rng.integers(1, 2 + 3 * k, 60)]
        held = [keys[:50], keys[10 * (k % 3) :]]
        counts = [counts[0][:50], counts[1][10 * (k % 3) :]]
        both = np.concatenate([held[0], held[1] | np.uint64(1 << 52)])
        ptr = np.array([0, len(held[0]), len(both)])
        sig = near_dup.signature(both, np.concatenate(counts), ptr, table, s)
        weights = [dict(zip(h.tolist(), (c * near_dup.weights_of(h, table, s)).tolist(), strict=True)) for h, c in zip(held, counts, strict=True)]
        every = set(weights[0]) | set(weights[1])
        low, high = (sum(f(weights[0].get(x, 0), weights[1].get(x, 0)) for x in every) for f in (min, max))
        assert abs((sig[0] == sig[1]).mean() - low / high) < 4 * (0.25 / s.samples) ** 0.5
    r, _, log_c, b = near_dup.variates()
    assert abs(r.mean() - 2) < 1e-3 and abs(r.var() - 2) < 2e-2 and abs(b.mean() - 0.5) < 1e-6 and np.allclose(np.log(r), log_c, atol=1e-5)


def test_texts_without_western_sentence_ends(spark):
    """Other scripts' sentence ends and cuts by content keep what an edit leaves."""
    rng = random.Random(23)
    letter = lambda: chr(rng.randrange(0x4E00, 0x9000))
    chinese = ["".join("".join(letter() for _ in range(12)) + rng.choice("。！？") for _ in range(200)) for _ in range(2)]
    bare = ["".join(letter() for _ in range(6000)), " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))]
    rows = list(enumerate([*chinese, *bare, "short"]))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0.25 < got[i]["near_edited"] < 0.55 for i in range(4)) and got[4]["n_paragraphs"] == 1
    same_fingerprints(spark, rows)
