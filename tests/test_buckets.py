"""Baselines in buckets: the same changes with one shuffle less, other sessions, growing numbers."""

from driftlens.operators import diff
from driftlens.sources import buckets

DOC = "key string, url string, title string, section string, sha256 string, pos long"


def docs(spark, rows):
    return spark.createDataFrame([(k, f"u/{k}", t, "s", sha, i) for i, (k, t, sha) in enumerate(rows)], DOC)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key")


def test_one_shuffle_less(spark, tmp_path):
    old = docs(spark, [(f"k{i}", f"T{i}", str(i)) for i in range(200)] + [("k1", "last", "1")])
    new = docs(spark, [(f"k{i}", f"T{i}", str(i * (i % 5 > 0))) for i in range(20, 220)])
    path = f"file://{tmp_path}/base"
    buckets.write(buckets.baseline(old), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = diff.documents(buckets.read(spark, path), new), diff.documents(old, new)
        one, two = (d.filter("category = 'documents_modified'") for d in (got, want))
        assert (shuffles(one), shuffles(two)) == (1, 2)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        # A session that didn't write the table, and one that finds a larger number.
        spark.sql(f"DROP TABLE {buckets.name_of(path)}")
        again = diff.documents(buckets.read(spark, path), new)
        assert shuffles(again.filter("category = 'documents_modified'")) == 1
        assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        buckets.write(buckets.baseline(old), path + "2", buckets=32)
        more = diff.documents(buckets.read(spark, path + "2"), new)
        assert more.filter("category = 'documents_modified'").count() == one.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_follow_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert buckets.number_for(spark, 0) == least
    assert buckets.number_for(spark, least * buckets.BUCKET_ROWS + 1) == 2 * least
