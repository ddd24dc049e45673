"""File digests by a streaming data source: sizes, exclusions that are never opened, pushed filters, broken files."""

import hashlib
import os
import resource

import pytest

from driftlens.sources import digests


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for path, data in (("a/one.txt", b"abc"), ("a/empty.txt", b""), ("a/deep/two.bin", os.urandom(3 << 20)), ("old/secret.txt", b"no"), ("b c/é.txt", b"x" * 10), ("_SUCCESS", b""), (".hid/x", b"1")):
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(data)
    return top


def want(top, *paths):
    return {p: (len(d := (top / p).read_bytes()), hashlib.sha256(d).hexdigest()) for p in paths}


EVERY = ("a/one.txt", "a/empty.txt", "a/deep/two.bin", "old/secret.txt", "b c/é.txt")


def rows(df):
    return {r["path"]: (r["size"], r["sha256"]) for r in df.collect()}


@pytest.mark.parametrize("most", [1, 1 << 40])
def test_digests_of_all_files(spark, folder, most):
    df = digests.digests(spark, str(folder), partitionBytes=str(most))
    assert rows(df) == want(folder, *EVERY) and rows(df)["a/one.txt"][1].startswith("ba7816bf")
    assert df.rdd.getNumPartitions() == (5 if most == 1 else 1)


def test_excluded_folders_are_never_opened(spark, folder):
    os.chmod(folder / "old", 0)
    try:
        reader = digests.Reader({"path": f"file://{folder}", "exclude": '["old/"]'})
        assert sorted(p for part in reader.partitions() for p, _ in part.files) == sorted(set(EVERY) - {"old/secret.txt"})
        assert rows(digests.digests(spark, f"file://{folder}", ["old/"])) == want(folder, *(e for e in EVERY if not e.startswith("old")))
    finally:
        os.chmod(folder / "old", 0o755)


def test_pushed_filters_leave_files_unopened(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringStartsWith

    reader = digests.PushingReader({"path": f"file://{folder}"})
    left = list(reader.pushFilters([StringStartsWith(("path",), "a/"), Not(In(("folder",), ("a/deep",))), GreaterThan(("size",), 1), Not(EqualTo(("path",), "a/empty.txt"))]))
    assert len(left) == 1 and [p for part in reader.partitions() for p, _ in part.files] == ["a/one.txt"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rows(digests.digests(spark, str(folder)).filter("folder = 'a' AND size > 0 AND path NOT IN ('x')"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert got == want(folder, "a/one.txt") == rows(digests.digests(spark, str(folder)).filter("folder = 'a' AND size > 0"))


def test_files_that_go_are_rows(spark, folder):
    gone = list(digests.Reader({"path": f"file://{folder}"}).read(digests.Files(f"file://{folder}", [("a/none", 5), ("a/one.txt", 3)])))
    assert gone[0][3] is None and "none" in gone[0][4] and gone[1][3].startswith("ba7816bf")
    assert digests.digests(spark, str(folder / "a" / "deep"), ["two"]).count() == 0


def test_a_large_file_takes_flat_memory(tmp_path):
    from pyarrow import fs

    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(3 << 30)  # a hole: no disk, but all of its bytes are read
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sha, size = digests.digest_of(fs.LocalFileSystem(), str(path))
    assert size == 3 << 30 and len(sha) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
