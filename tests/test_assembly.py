"""Assembled snapshots, lookups that never multiply rows, and the first file name of a disposition."""

import pytest
from pyspark.sql import functions as F

from driftlens.functions import urls
from driftlens.functions.predicates import Exclusions, Filters
from driftlens.operators import assembly, snapshot

DOC = "identity string, url string, title string, section string, sha256 string, pos long, analysis string"


@pytest.fixture(scope="module")
def before(spark):
    return spark.createDataFrame([
        (None, "https://h/a.pdf", "A0", "s", "old", 1, "first"), (None, "https://h/a.pdf", "A1", "s", "1", 2, "last"), ("dynamic:M", "https://h/m1.pdf", "M", "s", "5", 3, "manual"),
        ("dynamic:L", "https://h/lost.pdf", "L", "s", "6", 4, None), (None, "https://h/f.pdf", "F", "s", "7", 5, "failed"), ("i1", "https://h/i.pdf", "I", "s", "8", 6, "x"),
    ], DOC)


def test_an_assembled_snapshot(spark, before):
    page = spark.createDataFrame([("https://h/a.pdf", "A", "", 0), ("https://h/a.pdf", "A", "S / t", 1), ("https://h/f.pdf", "F2", "S", 2), ("https://h/out.pdf", "Out", "Old", 3), ("https://h/none.pdf", "N", "S", 4)], "url string, title string, section string, pos long")
    extra = spark.createDataFrame([("/x.pdf#top", " X  1", None), ("https://h/x.pdf", "again", "E"), ("https://H/a.pdf", "known", None)], "url string, title string, section string").withColumn("pos", F.monotonically_increasing_id())
    rules = spark.createDataFrame([("M", "src", "H", "manual"), ("L", "gone", "h", None), ("T", "two", "h", None), ("T", "src", "h", "manual")], "title string, source_url string, match_host string, match_path string").coalesce(1)
    found = spark.createDataFrame([("src", "https://h/m2.pdf", "h", "/Manual/m2.pdf"), ("src", "https://h/m2.pdf", "h", "/Manual/m2.pdf"), ("src", "https://o/m", "o", "/manual"), ("two", "https://h/1", "h", "/1"), ("two", "https://h/2", "h", "/2")], "source_url string, url string, host string, path string")
    fetched = spark.createDataFrame([("https://h/a.pdf", "1"), ("https://h/x.pdf", "9"), ("https://h/m2.pdf", "5"), ("https://h/out.pdf", "3")], "url string, sha256 string")
    failures = spark.createDataFrame([("https://h/f.pdf", "timed  out")], "url string, error string")
    made = assembly.assemble(page, fetched, failures, before, extra, rules, found, exclusions=Exclusions(top_sections=("old",)), page_url="https://h/page")
    got = {r["url"]: (r["identity"], r["title"], r["section"], r["sha256"], r["analysis"], r["carried"], r["reused"]) for r in made.documents.collect()}
    assert got == {
        "https://h/a.pdf": (None, "A", "S / t", "1", "last", False, True), "https://h/x.pdf": (None, "X 1", assembly.EXTRA_SECTION, "9", None, False, False),
        "https://h/m2.pdf": ("dynamic:M", "M", assembly.DYNAMIC_SECTION, "5", "manual", False, True),
        "https://h/f.pdf": (None, "F", "s", "7", "failed", True, False), "https://h/lost.pdf": ("dynamic:L", "L", "s", "6", None, True, False),
    }
    assert made.documents.count() == len(got)
    assert sorted((r["title"], r["error"]) for r in made.errors.collect()) == [("F2", "timed out"), ("L", "expected one matching link, found 0"), ("N", "not fetched"), ("T", "expected one matching link, found 2")]
    assert [r["url"] for r in made.to_analyse.collect()] == ["https://h/x.pdf"]
    assert [r["url"] for r in made.by_url().collect()] == sorted(got, key=str.casefold)
    # Filters leave a failed rule's earlier row out, force and missing previews leave no analysis.
    some = assembly.assemble(page, fetched, failures, before, extra, rules, found, Filters(titles=("m",)), page_url="https://h/page")
    assert {r["url"] for r in some.documents.collect()} == {"https://h/m2.pdf"}
    assert not assembly.assemble(page, fetched, failures, before, force=True).documents.filter("reused").count()
    stored = spark.createDataFrame([("5",)], "name string")
    assert [r["url"] for r in assembly.assemble(page, fetched, failures, before, extra, rules, found, page_url="https://h/page", previews=stored).documents.filter("reused").collect()] == ["https://h/m2.pdf"]


def test_lookups_return_a_row_each(spark, before):
    rows = spark.createDataFrame([("i1", "https://h/a.pdf"), (None, "https://h/a.pdf"), (None, "https://h/i.pdf"), ("i9", "https://h/zz"), (None, None), (None, "https://h/a.pdf")], "identity string, url string")
    got = sorted((r["identity"] or "", r["url"] or "", r["prev_title"] or "") for r in snapshot.previous(rows, before.unionByName(before)).collect())
    assert got == sorted([("i1", "https://h/a.pdf", "I"), ("", "https://h/a.pdf", "A1"), ("", "https://h/a.pdf", "A1"), ("", "https://h/i.pdf", "I"), ("i9", "https://h/zz", ""), ("", "", "")])
    keyed = before.withColumn("key", F.coalesce("identity", "url"))
    used, left = snapshot.split_reuse(spark.createDataFrame([("https://h/a.pdf", "1"), ("https://h/a.pdf", "old"), ("k", "1")], "key string, sha256 string"), keyed)
    assert [(r["key"], r["analysis"]) for r in used.collect()] == [("https://h/a.pdf", "last")] and left.count() == 2


def test_failed_rules_carry_their_identity(spark, before):
    errors = spark.createDataFrame([("dynamic:L", "https://source"), (None, "https://h/f.pdf")], "identity string, url string")
    fetched = before.filter("pos = 1").select("url", "sha256")
    got = sorted((r["url"], r["carried"]) for r in snapshot.carry_forward(fetched, errors, before).collect())
    assert got == [("https://h/a.pdf", False), ("https://h/f.pdf", True), ("https://h/lost.pdf", True)]


def test_two_rules_of_one_title(spark):
    rules = spark.createDataFrame([("A", "s", "h", "1"), ("A", "s", "h", "2")], "title string, source_url string, match_host string, match_path string")
    links = spark.createDataFrame([("s", "u1", "h", "/1"), ("s", "u2", "h", "/2")], "source_url string, url string, host string, path string")
    ok, bad = snapshot.dynamic_documents(rules, links)
    assert sorted(r["url"] for r in ok.collect()) == ["u1", "u2"] and bad.count() == 0


def test_extra_documents_once(spark):
    found = spark.createDataFrame([("https://h/a", "A", "s")], "url string, title string, section string")
    extra = spark.createDataFrame([("https://H:443/b#x", "B", None), ("https://H:443/b", "B", None), ("https://h/a#y", "A", None)], "url string, title string, section string")
    got = [(r["url"], r["section"]) for r in snapshot.extra_documents(found, extra).collect()]
    assert got == [("https://h/a", "s"), ("https://h:443/b", assembly.EXTRA_SECTION)]


@pytest.mark.parametrize(("said", "want"), [
    ("attachment; filename=my file.pdf", ".pdf"), ("inline; filename*=b.csv", ".csv"), ("filename=\"a.txt\"; filename*=UTF-8''b.pdf", ".txt"), ("attachment; FILENAME*=utf-8''b%20c.DOCX", ".docx"), ("inline", ""), (None, ""),
])
def test_the_first_file_name_counts(spark, said, want):
    d = spark.createDataFrame([("https://h/get", None, said)], "u string, t string, d string")
    assert d.select(urls.infer_suffix(F.col("u"), F.col("t"), F.col("d"))).first()[0] == want
