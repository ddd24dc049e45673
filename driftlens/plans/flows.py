"""Queries over whole flows: assembled snapshots, streams with state, deliveries, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import assembly, diff
from ..sources import buckets
from ..sources.digests import digests
from ..sources.tables import folder
from ..streaming import keyed
from . import fixtures as fx
from .registry import C, _select, pair, query


def scratch(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_select('documents_modified').removeprefix('WITH ')}")
def confirmation_streamed(spark, sf_dir):
    """Three snapshots as files of a stream; the state of each document keeps the modified ones, the others read as the baseline again."""
    o, n = pair(spark, sf_dir)
    second = o.join(n.select("key", C("sha256").alias("now"), C("text").alias("later"), C("title").alias("named"), C("url").alias("at")), "key", "left")
    differs = ~C("sha256").eqNullSafe(C("now")) & C("now").isNotNull()
    second = second.withColumn("sha256", F.when(differs, C("now")).otherwise(C("sha256")))
    source, out, check = (scratch(spark, s) for s in ("feed", "outcomes", "checkpoint"))
    listings = [o, n, second]
    for k, listing in enumerate(listings):
        keyed.feed(listing, listings[max(0, k - 2) : k], k).write.mode("append").parquet(source)
        rows = spark.readStream.schema(keyed.FEED).parquet(source)
        keyed.wait_for(keyed.started(keyed.documents(rows, 0), out, check))  # a restart for each snapshot
    told = spark.read.schema(keyed.CHANGE).parquet(out).filter(C("outcome") == keyed.CONFIRMED)
    return told.select("category", "key", "old_title", "new_title", "old_url", "new_url")


LINKED, EXTRA, RULED = "doc_id % 5 <> 0", "doc_id % 5 = 0 AND doc_id % 3 = 0", "doc_id % 5 = 0 AND doc_id % 3 = 1"


@query(f"""WITH {fx.PAIR_SQL},
before AS (SELECT identity, url, title, sha256, doc_id AS pos, CASE WHEN doc_id % 3 <> 0 THEN title END AS analysis FROM o
  UNION ALL SELECT identity, url, title || ' (stale)', 'stale', doc_id - 1000000000, 'stale' FROM o
  UNION ALL SELECT 'dynamic:Rule ' || doc_id, url || '?rule', 'Rule ' || doc_id, 'ruled', doc_id, 'ruled' FROM o WHERE {RULED}),
asked AS (
  SELECT NULL AS identity, url, title, sha256, doc_id, doc_id % 17 <> 0 AS ok, false AS rule FROM n WHERE {LINKED} OR {EXTRA}
  UNION ALL SELECT 'dynamic:Rule ' || doc_id, url, 'Rule ' || doc_id, sha256, doc_id, doc_id % 17 <> 0, false FROM n WHERE {RULED} AND doc_id % 2 = 0
  UNION ALL SELECT 'dynamic:Rule ' || doc_id, NULL, 'Rule ' || doc_id, NULL, doc_id, false, true FROM n WHERE {RULED} AND doc_id % 2 = 1),
keyed AS (SELECT *, unnest(['i:' || coalesce(identity, url), 'u:' || url]) AS k FROM before),
known AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1),
met AS (
  SELECT a.*, CASE WHEN i.k IS NOT NULL THEN i.url ELSE u.url END AS prev_url, CASE WHEN i.k IS NOT NULL THEN i.title ELSE u.title END AS prev_title,
    CASE WHEN i.k IS NOT NULL THEN i.sha256 ELSE u.sha256 END AS prev_sha256, CASE WHEN i.k IS NOT NULL THEN i.analysis ELSE u.analysis END AS prev_analysis
  FROM asked a LEFT JOIN known i ON i.k = 'i:' || coalesce(a.identity, a.url) LEFT JOIN known u ON u.k = 'u:' || a.url)
SELECT CASE WHEN ok THEN url ELSE prev_url END AS url, CASE WHEN ok THEN title ELSE prev_title END AS title, CASE WHEN ok THEN sha256 ELSE prev_sha256 END AS sha256,
  NOT ok AS carried, ok AND prev_sha256 = sha256 AND prev_analysis IS NOT NULL AS reused FROM met WHERE ok OR prev_url IS NOT NULL""")
def snapshot_assembled(spark, sf_dir):
    """Links, extra documents given twice, rules of which some match twice, failed downloads, and a baseline with repeated and stale rows."""
    o, n = pair(spark, sf_dir)
    base = o.select("identity", "url", "title", "section", "sha256", C("doc_id").alias("pos"), F.when(C("doc_id") % 3 != 0, C("title")).alias("analysis"))
    stale = o.select("identity", "url", F.concat("title", F.lit(" (stale)")).alias("title"), "section", F.lit("stale").alias("sha256"), (C("doc_id") - 1000000000).alias("pos"), F.lit("stale").alias("analysis"))
    rule = F.concat(F.lit("Rule "), C("doc_id").cast("string"))
    ruled = o.filter(RULED).select(F.concat(F.lit("dynamic:"), rule).alias("identity"), F.concat("url", F.lit("?rule")).alias("url"), rule.alias("title"), "section", F.lit("ruled").alias("sha256"), C("doc_id").alias("pos"), F.lit("ruled").alias("analysis"))
    page = n.filter(LINKED).select("url", "title", "section", C("doc_id").alias("pos"))
    twice = F.explode(F.array(F.lit(""), F.lit("#again"))).alias("mark")
    extra = n.filter(EXTRA).select("url", "title", "section", "doc_id", twice).select(F.concat("url", "mark").alias("url"), "title", "section", C("doc_id").alias("pos"))
    extra = extra.unionByName(page.limit(0).withColumn("pos", F.lit(0).cast("long")))
    rules = n.filter(RULED).select(rule.alias("title"), C("doc_id").cast("string").alias("source_url"), F.lit("DOCS.example.test").alias("match_host"), F.lit("/Documents/").alias("match_path"))
    links = n.filter(RULED).select(C("doc_id").cast("string").alias("source_url"), "url", F.explode(F.when(C("doc_id") % 2 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.lit(""), F.lit("2")))).alias("more"))
    links = links.select("source_url", F.concat("url", "more").alias("url")).select("*", urls.host(C("url")).alias("host"), urls.path(C("url")).alias("path"))
    fetched = n.filter("doc_id % 17 <> 0").select("url", "sha256")
    failures = n.filter("doc_id % 17 = 0").select("url", F.lit("timed out").alias("error"))
    made = assembly.assemble(page, fetched, failures, base.unionByName(stale).unionByName(ruled), extra, rules, links)
    return made.documents.select("url", "title", "sha256", "carried", "reused")


@query(f"WITH {fx.CHANGES_SQL} SELECT category, key, old_key, old_title, new_title, old_url, new_url FROM changes")
def snapshot_diff_bucketed(spark, sf_dir):
    """The old snapshot as a baseline in buckets of its key; only the new one is shuffled to meet it."""
    o, n = pair(spark, sf_dir)
    where = scratch(spark, "baseline")
    buckets.write(buckets.baseline(o.drop("text")), where)
    return diff.documents(buckets.read(spark, where), n).select("category", "key", "old_key", "old_title", "new_title", "old_url", "new_url")


GIVEN = "CASE doc_id % 4 WHEN 0 THEN 'attachment; filename=my file ' || doc_id || '.PDF' WHEN 1 THEN 'inline; FileName*=b%20c.csv' WHEN 2 THEN 'filename=\"a.txt\"; filename*=UTF-8''''b.pdf' ELSE 'inline' END"


@query(f"WITH r AS (SELECT doc_id, {GIVEN} AS said FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.txt' ELSE '.php' END AS suffix, length(said) AS size FROM r")
def suffix_by_disposition(spark, sf_dir):
    """The first file name counts, with blanks, in either form."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(GIVEN.replace("''''", "\\'\\'")).alias("said"))
    return d.select("doc_id", urls.infer_suffix(F.lit("https://docs.example.test/get.php"), F.lit(None).cast("string"), C("said")).alias("suffix"), F.length("said").cast("long").alias("size"))


@query("""WITH g AS (SELECT CAST(doc_id // 64 AS VARCHAR) AS folder, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents WHERE doc_id // 64 % 5 <> 3 GROUP BY 1)
SELECT 'group=' || folder AS folder, strlen(content) AS size, sha256(content) AS sha256 FROM g""")
def file_digests(spark, sf_dir):
    """The texts as files of 64 each in folders; every fifth folder is excluded, and so never opened."""
    d = fx.table(spark, sf_dir, "documents").select(F.expr("doc_id div 64").alias("group"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    where = scratch(spark, "files")
    # Groups are dealt whole, one file each; a range of ids is a task's.
    d.repartition("group").sortWithinPartitions("group", "doc_id").select("group", "value").write.partitionBy("group").text(where)
    groups = fx.table(spark, sf_dir, "documents").agg(F.max(F.expr("doc_id div 64")).alias("last")).first()["last"] or 0
    out = [f"group={g}/" for g in range(3, groups + 1, 5)]
    return digests(spark, where, out).select("folder", "size", "sha256")
