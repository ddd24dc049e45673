"""Snapshot pairs and other shapes derived from the test tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "https://docs.example.test/documents/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """doc_id, identity, url, title, section, sha256, key, pos, text of the OLD or the NEW snapshot."""
    new = side == "new"
    k = F.col("doc_id") % 11
    d = table(spark, sf_dir, "documents").filter(k != (5 if new else 3))
    text = F.when(k == 7, F.concat("text", F.lit(" rev2"))).otherwise(F.col("text")) if new else F.col("text")
    moved = F.when(k.isin(4, 9), "moved/").otherwise("") if new else F.lit("")
    url = F.concat(F.lit(ROOT), moved, "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.when(k == 2, " (rev)").otherwise("") if new else F.lit(""))
    identity = F.when(k == 4, F.concat(F.lit("dynamic:"), F.col("doc_id").cast("string")))
    return d.select(
        "doc_id", identity.alias("identity"), url.alias("url"), title.alias("title"), F.concat_ws(" / ", "source", "lang").alias("section"),
        F.sha2(text, 256).alias("sha256"), F.coalesce(identity, url).alias("key"), F.col("doc_id").alias("pos"), text.alias("text"),
    )


def _side(name: str, moved: str, rev: str, text: str, gone: int) -> str:
    return f"""{name} AS (
  SELECT *, coalesce(identity, url) AS key FROM (
    SELECT doc_id, CASE WHEN doc_id % 11 = 4 THEN 'dynamic:' || doc_id END AS identity,
           '{ROOT}' || {moved} || source || '/' || lang || '/' || doc_id || '.txt' AS url,
           'Doc ' || doc_id || {rev} AS title, source || ' / ' || lang AS section, {text} AS text, sha256({text}) AS sha256
    FROM documents WHERE doc_id % 11 <> {gone}))"""


PAIR_SQL = ",\n".join([
    _side("o", "''", "''", "text", 3),
    _side("n", "CASE WHEN doc_id % 11 IN (4, 9) THEN 'moved/' ELSE '' END", "CASE WHEN doc_id % 11 = 2 THEN ' (rev)' ELSE '' END", "CASE WHEN doc_id % 11 = 7 THEN text || ' rev2' ELSE text END", 5),
])
CHANGES_SQL = PAIR_SQL + """,
j AS (SELECT coalesce(o.key, n.key) AS key, o.key AS ok, n.key AS nk, o.title AS ot, n.title AS nt, o.url AS ou, n.url AS nu, o.sha256 AS os, n.sha256 AS ns,
             o.section AS osec, n.section AS nsec
      FROM o FULL OUTER JOIN n ON o.key = n.key),
g AS (SELECT *, row_number() OVER (PARTITION BY os ORDER BY left(md5(ok), 2), ok) AS r FROM j WHERE nk IS NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY left(md5(nk), 2), nk) AS r FROM j WHERE ok IS NULL),
p AS (SELECT g.key AS gk, c.key AS ck, g.ot, c.nt, g.ou, c.nu FROM g FULL OUTER JOIN c ON g.os = c.ns AND g.r = c.r),
changes AS (
  SELECT CASE WHEN gk IS NULL THEN 'documents_added' WHEN ck IS NULL THEN 'documents_removed' ELSE 'documents_moved' END AS category,
         coalesce(ck, gk) AS key, gk AS old_key, ot AS old_title, nt AS new_title, ou AS old_url, nu AS new_url FROM p
  UNION ALL SELECT 'documents_modified', key, key, ot, nt, ou, nu FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND os IS DISTINCT FROM ns
  UNION ALL SELECT 'documents_renamed', key, key, ot, nt, ou, nu FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND ot IS DISTINCT FROM nt
  UNION ALL SELECT 'documents_relinked', key, key, ot, nt, ou, nu FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND ou IS DISTINCT FROM nu)"""


def cells(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    value = F.when(k == 1, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")) if side == "new" else F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").filter(k != (2 if side == "new" else 3))
    return rows.select(F.lit("book").alias("key"), F.col("c_mktsegment").alias("sheet"), F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("cell"), value.cast("string").alias("value"), F.col("c_custkey").alias("pos"))


CELLS_SQL = """
o AS (SELECT c_mktsegment AS sheet, 'A' || c_custkey AS cell, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 7 <> 3),
n AS (SELECT c_mktsegment AS sheet, 'A' || c_custkey AS cell, CAST(CASE WHEN c_custkey % 7 = 1 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS value FROM customer WHERE c_custkey % 7 <> 2),
details AS (
  SELECT coalesce(o.sheet, n.sheet) AS sheet, coalesce(o.cell, n.cell) AS cell,
         coalesce(o.sheet, n.sheet) || '!' || coalesce(o.cell, n.cell) || CASE WHEN o.cell IS NULL THEN ' added: ' || left(n.value, 300)
           WHEN n.cell IS NULL THEN ' removed: ' || left(o.value, 300) ELSE ' changed: ' || left(o.value, 150) || ' → ' || left(n.value, 150) END AS detail
  FROM o FULL OUTER JOIN n ON o.sheet = n.sheet AND o.cell = n.cell WHERE o.cell IS NULL OR n.cell IS NULL OR o.value <> n.value)"""


def record_lines(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    k = F.col("p_partkey") % 13
    p = table(spark, sf_dir, "part").filter(k != (4 if side == "new" else 5))
    unit = F.when(k == 6, "LF").otherwise("EA") if side == "new" else F.lit("EA")
    line = F.concat_ws("|", F.col("p_partkey").cast("string"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")), "p_name", unit, "p_type")
    return p.select(F.col("p_partkey").alias("pos"), line.alias("line"))


def _records(name: str, unit: str, gone: int) -> str:
    return f"""{name} AS (
  SELECT code, description, unit, category FROM (
    SELECT p_brand || '-' || p_size AS code, p_name AS description, {unit} AS unit, p_type AS category, p_partkey AS pos FROM part WHERE p_partkey % 13 <> {gone})
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(code) + length(description) + length(unit) + length(category) DESC, pos) = 1)"""


RECORDS_SQL = _records("o", "'EA'", 5) + ",\n" + _records("n", "CASE WHEN p_partkey % 13 = 6 THEN 'LF' ELSE 'EA' END", 4)

ROUTES = [
    ("English", ["a@example.test", "b@example.test"], [" / en"], [], [], False),
    ("Text files", ["b@example.test", "root@example.test"], [], [], ["txt"], True),
    ("Source five", ["c@example.test", "c@example.test"], ["src5"], ["doc "], [".TXT"], False),
    ("Nobody", ["root@example.test"], [], [], [], True),
]
EVERYONE = ["root@example.test"]


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "name string, recipients array<string>, sections array<string>, titles array<string>, extensions array<string>, include_page_text boolean")
