"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, text, urls
from ..operators import dedup, diff, routing, sequence, snapshot
from ..sources import files, html
from . import fixtures as fx

C = F.col
SUBJECT = ["category", "key", "old_key", "old_title", "new_title", "old_url", "new_url"]
MADE: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        MADE[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pair(spark, sf_dir):
    return fx.snapshot(spark, sf_dir, "old"), fx.snapshot(spark, sf_dir, "new")


def changes(spark, sf_dir) -> DataFrame:
    return diff.documents(*pair(spark, sf_dir))


def _select(category: str) -> str:
    return f"WITH {fx.CHANGES_SQL} SELECT category, key, old_title, new_title, old_url, new_url FROM changes WHERE category = '{category}'"


@query(f"WITH {fx.CHANGES_SQL} SELECT category, key, old_key, old_title, new_title, old_url, new_url FROM changes")
def snapshot_diff(spark, sf_dir):
    return changes(spark, sf_dir).select(*SUBJECT)


@query(f"WITH {fx.CHANGES_SQL} SELECT category, count(*) AS n FROM changes GROUP BY 1")
def snapshot_diff_summary(spark, sf_dir):
    return dedup.summary(changes(spark, sf_dir)).select("category", "n")


@query(f"WITH {fx.CHANGES_SQL} SELECT count(*) AS n FROM changes")
def change_count(spark, sf_dir):
    return changes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.CHANGES_SQL} SELECT key, old_key FROM changes WHERE category = 'documents_moved'")
def moved_documents(spark, sf_dir):
    return changes(spark, sf_dir).filter("category = 'documents_moved'").select("key", "old_key")


def _one(category):
    def f(spark, sf_dir):
        return changes(spark, sf_dir).filter(C("category") == category).select("category", "key", "old_title", "new_title", "old_url", "new_url")

    f.__name__ = category.removeprefix("documents_") + "_documents"
    return query(_select(category))(f)


for _c in ("documents_modified", "documents_renamed", "documents_relinked"):
    _one(_c)


@query(f"WITH {fx.CHANGES_SQL} SELECT category, key FROM changes WHERE category <> 'documents_added'")
def diff_with_schema_gate(spark, sf_dir):
    return diff.gate(changes(spark, sf_dir), 1, 2, True).select("category", "key")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


WHITE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NORMAL_SQL = rf"trim(regexp_replace(translate(X, chr(8204) || chr(160), '  '), '{WHITE_SQL}', ' ', 'g'))"


@query(f"SELECT doc_id, {NORMAL_SQL.replace('X', 'text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.normalize(C("text")).alias("text"))


@query(rf"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {NORMAL_SQL.replace('X', 'x')}), lambda x: x <> '')) AS INT) AS n FROM documents")
def line_count_nonblank(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(C("text"))).alias("n"))


URL_RE = urls.PARTS.replace("'", "''")


@query(f"""SELECT page_id, lower(regexp_extract(url, '{URL_RE}', 1)) AS scheme, lower(regexp_extract(regexp_extract(url, '{URL_RE}', 2), '(?:.*@)?([^:@]*)(?::\\d*)?$', 1)) AS host,
regexp_extract(url, '{URL_RE}', 3) AS path, lower(regexp_extract(regexp_replace(regexp_extract(url, '{URL_RE}', 3), '/+$', ''), '[^/](\\.[^./]+)$', 1)) AS suffix FROM pages""")
def url_parts(spark, sf_dir):
    u = C("url")
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.suffix(u).alias("suffix"))


@query(f"""SELECT page_id, lower(regexp_extract(url, '{URL_RE}', 1)) || '://' || lower(regexp_extract(url, '{URL_RE}', 2)) || regexp_extract(url, '{URL_RE}', 3)
|| CASE WHEN regexp_extract(url, '{URL_RE}', 4) <> '' THEN '?' || regexp_extract(url, '{URL_RE}', 4) ELSE '' END AS url FROM pages""")
def url_canonical(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.lit("https://example.test/"), C("url")).alias("url"))


@query(f"WITH {fx.PAIR_SQL} SELECT doc_id, url FROM n WHERE contains(lower(section), 'src1') AND contains(lower(title), 'doc') AND url LIKE '%.txt'")
def document_filter(spark, sf_dir):
    f = predicates.Filters(("SRC1",), ("doc",), ("txt",))
    n = fx.snapshot(spark, sf_dir, "new")
    return n.filter(predicates.matches_fixed(C("section"), C("title"), C("url"), f)).select("doc_id", "url")


LINKS = ["a b.pdf?q=(1)!", "../n.pdf", "/m/../n.pdf", "./x/./y//z", "../../../../up", "?a='b'*c", "#frag", "//H2.test:0443/A b/../c?x=$1", "HTTP://u:p@H3.test:80/q(1)!", "http://[::1]:8080/x", "", "d/..", "100%25 zz%"]
# Literal results, by RFC 3986 and the list of characters that stay.
LINK_RESULTS = [
    "/docs/2024/01/a%20b.pdf?q=(1)!", "/docs/2024/n.pdf", "/n.pdf", "/docs/2024/01/x/y/z", "/up", "/docs/2024/01/p.html?a='b'*c", "/docs/2024/01/p.html?v=1",
    "https://h2.test:443/A%20b/../c?x=$1", "http://h3.test:80/q(1)!", "http://::1:8080/x", "/docs/2024/01/p.html?v=1", "/docs/2024/01/", "/docs/2024/01/100%25%20zz%",
]
LINK_ROWS = ", ".join("({}, '{}')".format(i, (x if "://" in x else "https://h1.test" + x).replace("'", "''")) for i, x in enumerate(LINK_RESULTS))


@query(f"WITH r(i, url) AS (VALUES {LINK_ROWS}) SELECT p_partkey, url FROM part JOIN r ON p_partkey % {len(LINKS)} = i")
def links_resolved(spark, sf_dir):
    """Made-up links against one base: dot segments, ports, users, brackets, characters that stay."""
    each = F.array(*[F.lit(x) for x in LINKS])
    link = F.get(each, (C("p_partkey") % len(LINKS)).cast("int"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", urls.canonical(F.lit("https://h1.test/docs/2024/01/p.html?v=1"), link).alias("url"))


EXCLUDED = predicates.Exclusions(("SRC3",), "/documents/", ("src6/en/6.txt",), ("/documents/moved/src4/",), ("docs.example.test",))
KEPT_SQL = """split_part(section, ' / ', 1) <> 'src3' AND NOT regexp_matches(url, 'documents/moved/src4/') AND NOT ends_with(url, '/documents/src6/en/6.txt')"""


@query(f"WITH {fx.CHANGES_SQL.replace('FROM o FULL OUTER JOIN n ON', f'FROM (SELECT * FROM o WHERE {KEPT_SQL}) o FULL OUTER JOIN (SELECT * FROM n WHERE {KEPT_SQL}) n ON')} SELECT category, key, old_key FROM changes")
def snapshot_diff_excluded(spark, sf_dir):
    """Excluded documents vanish from both snapshots: they are neither removed nor added."""
    return diff.documents(*pair(spark, sf_dir), exclusions=EXCLUDED).select("category", "key", "old_key")


@query(f"WITH {fx.PAIR_SQL} SELECT doc_id FROM n WHERE split_part(section, ' / ', 1) = 'src3' OR regexp_matches(url, 'documents/moved/src4/') OR url = '{fx.ROOT}src6/en/6.txt'")
def excluded_documents(spark, sf_dir):
    return fx.snapshot(spark, sf_dir, "new").filter(predicates.is_excluded(C("section"), C("url"), EXCLUDED)).select("doc_id")


@query("""WITH l AS (SELECT source AS url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS section, doc_id AS pos FROM documents)
SELECT url, section, pos FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY section = '', pos) = 1""")
def first_section_per_url(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(C("source").alias("url"), F.when(C("doc_id") % 3 == 0, "").otherwise(C("lang")).alias("section"), C("doc_id").alias("pos"))
    return dedup.prefer_section(d)


@query("SELECT source, lang, max(doc_id) AS pos FROM documents GROUP BY 1, 2")
def last_wins_key(spark, sf_dir):
    return dedup.last_wins(fx.table(spark, sf_dir, "documents").select("source", "lang", C("doc_id").alias("pos")), ["source", "lang"])


@query("""SELECT page_id, url, pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS url, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS pos FROM pages)
QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""")
def link_dedup(spark, sf_dir):
    found = fx.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("pos", "url"))
    return dedup.first_wins(found.select("page_id", "url", (C("pos") + 1).cast("long").alias("pos")), ["page_id", "url"])


@query()
def page_links_parsed(spark, sf_dir):
    return html.page_links(html.parse(fx.table(spark, sf_dir, "pages"), root="body"))


@query()
def page_text_parsed(spark, sf_dir):
    return html.parse(fx.table(spark, sf_dir, "pages"), root="body").select("page_id", "page_text", F.size("links").alias("n_links"))


LINKS_SQL = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
o AS (SELECT href AS url, 'p' || max(page_id) AS title FROM l WHERE page_id % 5 <> 1 GROUP BY 1),
n AS (SELECT href AS url, 'p' || max(page_id) AS title FROM l WHERE page_id % 5 <> 2 GROUP BY 1)"""


@query(f"""WITH {LINKS_SQL} SELECT CASE WHEN o.url IS NULL THEN 'links_added' WHEN n.url IS NULL THEN 'links_removed' ELSE 'links_renamed' END AS category,
coalesce(o.url, n.url) AS url, o.title AS old_title, n.title AS new_title FROM o FULL OUTER JOIN n ON o.url = n.url WHERE o.title IS DISTINCT FROM n.title""")
def links_diff(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    each = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("url"))
    each = each.select("url", F.concat(F.lit("p"), C("page_id").cast("string")).alias("title"), C("page_id").alias("pos"))
    return diff.links(each.filter("pos % 5 <> 1"), each.filter("pos % 5 <> 2"))


@query(f"""WITH {fx.PAIR_SQL}, a AS (SELECT DISTINCT section AS path FROM o WHERE doc_id % 2 = 0 AND section < 'src5'), b AS (SELECT DISTINCT section AS path FROM n WHERE section > 'src1')
SELECT CASE WHEN a.path IS NULL THEN 'folders_added' ELSE 'folders_removed' END AS category, coalesce(a.path, b.path) AS path FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL""")
def folders_diff(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    side = lambda d: d.select(C("section").alias("path"), F.element_at(F.split("section", " / "), -1).alias("title"), "pos")
    return diff.folders(side(o.filter("doc_id % 2 = 0 AND section < 'src5'")), side(n.filter("section > 'src1'"))).select("category", "path")


@query(f"""WITH {fx.PAIR_SQL}, s AS (SELECT DISTINCT section FROM n), e AS (SELECT split_part(section, ' / ', 1) AS path FROM s UNION SELECT section FROM s)
SELECT path, CASE WHEN contains(path, ' / ') THEN split_part(path, ' / ', 2) ELSE path END AS title, CAST(CASE WHEN contains(path, ' / ') THEN 2 ELSE 1 END AS INT) AS depth FROM e""")
def folder_ancestors(spark, sf_dir):
    return snapshot.ancestors(fx.snapshot(spark, sf_dir, "new"))


@query(f"WITH {fx.CELLS_SQL} SELECT sheet, cell, detail FROM details")
def cell_diff(spark, sf_dir):
    return diff.cell_details(fx.cells(spark, sf_dir, "old"), fx.cells(spark, sf_dir, "new"), []).select("sheet", "cell", "detail")


@query(f"""WITH {fx.CELLS_SQL}, r AS (SELECT detail, row_number() OVER (ORDER BY sheet, cell) AS place, count(*) OVER () AS n FROM details)
SELECT CAST(place AS INT) AS place, detail FROM r WHERE place <= 20 UNION ALL SELECT 21, (n - 20) || ' additional cell change(s) omitted' FROM r WHERE place = 1 AND n > 20""")
def cell_diff_top20(spark, sf_dir):
    rows = diff.cell_details(fx.cells(spark, sf_dir, "old"), fx.cells(spark, sf_dir, "new"), ["key"])
    return dedup.top_details(rows, ["key"], ["sheet", "cell"], 20, "cell change(s)").select("place", "detail")


def records(spark, sf_dir, side):
    lines = fx.record_lines(spark, sf_dir, side).withColumn("r", text.record(C("line"))).filter("r IS NOT NULL")
    return dedup.most_complete(lines.select("r.*", "pos"))


@query(f"WITH {fx.RECORDS_SQL} SELECT code, description, unit, category FROM o")
def pay_items_dedup(spark, sf_dir):
    return records(spark, sf_dir, "old").drop("pos")


PAY_SQL = f"""WITH {fx.RECORDS_SQL} SELECT CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' ELSE 'updated' END AS kind, coalesce(o.code, n.code) AS code,
o.unit AS old_unit, n.unit AS new_unit, o.description AS old_description, n.description AS new_description FROM o FULL OUTER JOIN n ON o.code = n.code
WHERE o.code IS NULL OR n.code IS NULL OR (o.description, o.unit, o.category) IS DISTINCT FROM (n.description, n.unit, n.category)"""


def item_changes(spark, sf_dir):
    both = [records(spark, sf_dir, s).withColumnRenamed("category", "class") for s in ("old", "new")]
    return diff.keyed(*both, ["code"], ["description", "unit", "class"], ("added", "removed", "updated")).withColumnRenamed("category", "kind")


@query(PAY_SQL)
def pay_item_diff(spark, sf_dir):
    return item_changes(spark, sf_dir).select("kind", "code", "old_unit", "new_unit", "old_description", "new_description")


@query(f"SELECT kind, count(*) AS n, min(code) AS first_code FROM ({PAY_SQL}) GROUP BY 1")
def pay_items_consolidated(spark, sf_dir):
    twice = item_changes(spark, sf_dir).withColumn("pos", F.lit(1))
    both = twice.unionByName(twice.withColumn("pos", F.lit(2)))  # two files that tell of the same items
    return dedup.last_wins(both.select("kind", "code", "pos"), ["kind", "code"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code"))


@query(f"""WITH {fx.PAIR_SQL}, a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM o), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, 1 AS n FROM n)
SELECT doc_id, line, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2 HAVING sum(n) <> 0""")
def line_multiset_diff(spark, sf_dir):
    each = [d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")) for d in pair(spark, sf_dir)]
    return diff.line_multiset(*each, "doc_id")


def modified(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    return o.select("key", "doc_id", C("text").alias("old"), C("sha256").alias("s")).join(n.select("key", C("text").alias("new"), "sha256"), "key").filter("s <> sha256")


@query()
def line_seq_diff(spark, sf_dir):
    m = modified(spark, sf_dir)
    return m.select("doc_id", sequence.sequence_details(text.lines(C("old")), text.lines(C("new")), "line").alias("details"))


@query()
def word_seq_diff(spark, sf_dir):
    m = modified(spark, sf_dir)
    return m.select("doc_id", sequence.word_details(C("old"), C("new")).alias("details"))


@query()
def seq_opcodes(spark, sf_dir):
    m = modified(spark, sf_dir)
    return m.select("doc_id", F.explode(sequence.opcodes(text.lines(C("old")), text.lines(C("new")))).alias("e")).select("doc_id", "e.*")


@query(f"WITH {fx.PAIR_SQL} SELECT n.doc_id, sha256(n.text) AS new_sha256 FROM o JOIN n ON o.key = n.key WHERE o.sha256 <> n.sha256")
def edits_applied(spark, sf_dir):
    """The old lines with the edits made are the new text."""
    m = modified(spark, sf_dir).select("doc_id", F.split("old", "\n").alias("a"), F.split("new", "\n").alias("b"))
    made = m.withColumn("e", sequence.opcodes(C("a"), C("b"))).select("doc_id", sequence.applied(C("a"), C("b"), C("e")).alias("made"))
    return made.select("doc_id", F.sha2(F.array_join("made", "\n"), 256).alias("new_sha256"))


def pages_of(column):
    return F.transform(text.lines(column), lambda x, i: F.struct((i + 1).alias("page"), x.alias("text"), F.sha2(x, 256).alias("text_sha256"), F.lit(None).cast("string").alias("visual_sha256")))


@query()
def page_align(spark, sf_dir):
    m = modified(spark, sf_dir)
    return m.select("doc_id", sequence.page_details(pages_of(C("old")), pages_of(C("new"))).alias("details"))


@query()
def analysis_details(spark, sf_dir):
    """Line, paragraph and page analyses of modified documents, and some whose kind has changed."""
    kinds = F.array(*[F.lit(k) for k in ("lines", "paragraphs", "pdf_pages", "unsupported")])
    units = lambda c: F.transform(text.lines(C(c)), lambda x, i: F.struct(i.alias("pos"), x.alias("text")))
    side = lambda c, shift: F.struct(F.element_at(kinds, ((C("doc_id") + shift) % 4 + 1).cast("int")).alias("kind"), units(c).alias("units"), F.lit(None).cast("string").alias("reason"))
    m = modified(spark, sf_dir)
    return m.select("doc_id", sequence.analysis_details(side("old", 0), side("new", F.when(C("doc_id") % 11 == 0, 1).otherwise(0))).alias("details"))


@query("""WITH f AS (SELECT DISTINCT sha256(text) AS name FROM documents UNION ALL SELECT 'other')
SELECT name FROM f WHERE name <> 'other' AND name NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)""")
def stale_previews(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    names = d.select(C("sha256").alias("name")).distinct().unionByName(spark.range(1).select(F.lit("other").alias("name")))
    return snapshot.stale_previews(names, d.filter("doc_id % 3 = 0"))


@query(f"WITH {fx.PAIR_SQL} SELECT n.doc_id FROM o JOIN n ON o.key = n.key WHERE o.sha256 <> n.sha256 AND o.doc_id % 2 = 0")
def repackaging_filter(spark, sf_dir):
    m = modified(spark, sf_dir).withColumn("shown", F.when(C("doc_id") % 2 == 0, C("new")).otherwise(C("old")))
    return m.filter(~diff.same_rendering(pages_of(C("old")), pages_of(C("shown")))).select("doc_id")


@query(f"WITH {fx.PAIR_SQL}, e AS (SELECT url FROM n WHERE doc_id % 17 = 0) SELECT url, sha256, carried FROM (SELECT url, sha256, false AS carried FROM n WHERE doc_id % 17 <> 0 UNION ALL SELECT url, sha256, true FROM o WHERE url IN (SELECT url FROM e))")
def carry_forward(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    cols = ["url", "sha256"]
    return snapshot.carry_forward(n.filter("doc_id % 17 <> 0").select(*cols), n.filter("doc_id % 17 = 0").select("url"), o.select(*cols))


@query(f"WITH {fx.PAIR_SQL} SELECT n.key, CASE WHEN o.key IS NULL THEN false ELSE true END AS reused FROM n LEFT JOIN o ON o.key = n.key AND o.sha256 = n.sha256 AND o.doc_id % 3 <> 0")
def incremental_reuse(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    old = o.withColumn("analysis", F.when(C("doc_id") % 3 != 0, C("title")))
    used, left = snapshot.split_reuse(n.select("key", "sha256"), old)
    return used.select("key", F.lit(True).alias("reused")).unionByName(left.select("key", F.lit(False).alias("reused")))


@query(f"WITH {fx.PAIR_SQL} SELECT n.doc_id, coalesce(i.url, u.url) AS prev_url, CASE WHEN i.url IS NOT NULL THEN i.title ELSE u.title END AS prev_title FROM n LEFT JOIN o i ON i.identity = n.identity LEFT JOIN o u ON u.url = n.url")
def prev_lookup(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    return snapshot.previous(n.select("doc_id", "identity", "url"), o).select("doc_id", "prev_url", "prev_title")


def subject(spark, sf_dir):
    return changes(spark, sf_dir).withColumn("url", F.coalesce("new_url", "old_url")).withColumn("title", F.coalesce("new_title", "old_title"))


ROUTED_SQL = f"""{fx.CHANGES_SQL}, sec AS (SELECT key, section FROM n UNION ALL SELECT key, section FROM o WHERE key NOT IN (SELECT key FROM n)),
s AS (SELECT changes.category, changes.key, section, coalesce(new_url, old_url) AS url, coalesce(new_title, old_title) AS title FROM changes JOIN sec ON sec.key = changes.key),
r AS (SELECT 'English' AS name, s.* FROM s WHERE contains(lower(section), '/ en') UNION ALL SELECT 'Text files', s.* FROM s WHERE url LIKE '%.txt'
      UNION ALL SELECT 'Source five', s.* FROM s WHERE contains(section, 'src5') AND contains(lower(title), 'doc') AND url LIKE '%.txt' UNION ALL SELECT 'Nobody', s.* FROM s)"""


@query(f"WITH {ROUTED_SQL} SELECT name, category, key FROM r")
def routed_changes(spark, sf_dir):
    return routing.routed(subject(spark, sf_dir), fx.routes(spark)).select("name", "category", "key")


@query(f"""WITH {ROUTED_SQL} SELECT 'All monitored changes' AS label, 'root@example.test' AS recipients, count(*) AS n FROM s
UNION ALL SELECT name, CASE name WHEN 'English' THEN 'a@example.test;b@example.test' WHEN 'Text files' THEN 'b@example.test' ELSE 'c@example.test' END, count(*) FROM r WHERE name <> 'Nobody' GROUP BY 1, 2""")
def notification_batches(spark, sf_dir):
    return routing.batches(subject(spark, sf_dir), fx.routes(spark), fx.EVERYONE)


@query(f"WITH {_select('documents_modified').removeprefix('WITH ')}")
def confirmation(spark, sf_dir):
    """The second look (only modified rows are left) replaces the first."""
    first = changes(spark, sf_dir)
    second = first.filter("category = 'documents_modified'")
    return routing.confirmed(first, second).select("category", "key", "old_title", "new_title", "old_url", "new_url")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_top_n(spark, sf_dir):
    return dedup.newest(fx.table(spark, sf_dir, "events"), 100, "ts", "event_id").select("event_id", "event_type")


@query("""WITH m AS (SELECT user_id, max(CASE WHEN event_type <> 'click' THEN event_id END) AS ok FROM events GROUP BY 1)
SELECT e.user_id, count(CASE WHEN e.event_type = 'click' AND (m.ok IS NULL OR e.event_id > m.ok) THEN 1 END) AS streak FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1""")
def consecutive_failures(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").withColumn("failed", C("event_type") == "click")
    return routing.failure_streaks(e, "user_id", "ts", "event_id", "failed")


@query("SELECT user_id, epoch(TIMESTAMP '2024-02-03 00:00:00') - floor(epoch(max(ts))) >= 7 * 86400 AS due FROM events GROUP BY 1")
def heartbeat_due(spark, sf_dir):
    last = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", routing.heartbeat_due(F.date_format("last", "yyyy-MM-dd HH:mm:ss"), F.lit("2024-02-03 00:00:00"), 7).alias("due"))


@query(f"WITH {fx.PAIR_SQL}, e AS (SELECT string_agg(title || ': timed out', ' | ' ORDER BY doc_id) AS s, count(*) AS n FROM n) SELECT CASE WHEN length(s) > 3500 THEN left(s, 3499) || '…' ELSE s END AS digest, n FROM e")
def error_digest(spark, sf_dir):
    e = fx.snapshot(spark, sf_dir, "new").select("title", F.lit("timed out").alias("error"), "pos")
    return routing.error_digest(e)


@query(f"WITH {fx.PAIR_SQL} SELECT url, title FROM o UNION ALL SELECT url, title FROM n WHERE url NOT IN (SELECT url FROM o)")
def extra_documents(spark, sf_dir):
    o, n = pair(spark, sf_dir)
    cols = ["url", "title", "section"]
    return snapshot.extra_documents(o.select(*cols), n.select(*cols)).select("url", "title")


ADDRESS = "'C' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '@example.test' WHEN 1 THEN '@example' WHEN 2 THEN ' x@example.test' WHEN 3 THEN '@example.test' || chr(10) ELSE ';a@b.test' END"


@query(rf"SELECT c_custkey, regexp_full_match({ADDRESS}, '[^\s;@]+@[^\s;@]+\.[^\s;@]+') AS valid FROM customer")
def email_valid(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", text.valid_email(F.expr(ADDRESS)).alias("valid"))


@query("SELECT doc_id, left(text, 300) || CASE WHEN length(text) > 300 THEN '…' ELSE '' END AS shown FROM documents")
def text_cut(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.cut(C("text"), 300, "…").alias("shown"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS html FROM documents")
def html_escaped(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.escape_html(C("text")).alias("html"))


@query("SELECT doc_id, replace(translate(lower(text), 'ς', 'σ'), 'ß', 'ss') AS folded FROM documents")
def case_folded(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.fold(C("text")).alias("folded"))


@query("SELECT doc_id, url_encode(text) AS quoted, text AS again FROM documents")
def percent_encoding(spark, sf_dir):
    """Whole texts, encoded and decoded."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", urls.quote(C("text"), "").alias("quoted"))
    return d.withColumn("again", urls.unquote(C("quoted")))


@query(f"SELECT page_id, regexp_extract(regexp_replace(regexp_extract(url, '{URL_RE}', 3), '/+$', ''), '[^/]*$') AS name FROM pages")
def url_file_names(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.file_name(C("url")).alias("name"))


@query(f"WITH {fx.PAIR_SQL} SELECT doc_id FROM n WHERE doc_id % 4 <> 3")
def monitored_documents(spark, sf_dir):
    """Documents of an allowed host: by folder, or by suffix outside of it."""
    k = C("doc_id") % 4
    link = F.when(k == 1, F.replace("url", F.lit("/documents/"), F.lit("/other/"))).when(k == 2, F.concat(F.regexp_replace("url", r"\.txt$", ""), F.lit("?v=2"))).when(k == 3, F.replace("url", F.lit("docs."), F.lit("www."))).otherwise(C("url"))
    return fx.snapshot(spark, sf_dir, "new").filter(predicates.is_document(link, ("docs.example.test",))).select("doc_id")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.dat' WHEN 3 THEN '.csv' ELSE '.php' END AS suffix FROM documents")
def suffix_inferred(spark, sf_dir):
    """By the URL, the file name of the disposition, the content type; else the URL's own suffix."""
    k = C("doc_id") % 5
    link = F.concat(F.lit("https://docs.example.test/get/"), C("doc_id").cast("string"), F.when(k == 0, ".PDF").otherwise(".php"))
    kind = F.when(k == 1, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(k == 3, "Text/CSV").when(k != 4, "application/pdf")
    given = F.when(k == 2, 'attachment; filename="A b.DAT"')
    return fx.table(spark, sf_dir, "documents").select("doc_id", urls.infer_suffix(link, kind, given).alias("suffix"))


SHEET_PAGE = "'WORKING NUMBER ' || chr(10) || ' ' || CASE p_partkey % 3 WHEN 0 THEN upper(left(p_type, 3)) || '-' || p_partkey WHEN 1 THEN lower(p_type) || '-1' ELSE 'AB-' || p_partkey || ' x' END || chr(10) || p_name"


@query(rf"SELECT p_partkey, regexp_extract({SHEET_PAGE}, 'WORKING NUMBER\s*\n\s*([A-Z]{{1,6}}-[A-Z0-9]+)(?:\n|$)', 1) AS sheet FROM part")
def sheet_labels(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.sheet_label(F.expr(SHEET_PAGE)).alias("sheet"))


@query("SELECT l_orderkey, CASE WHEN max(l_linenumber) = min(l_linenumber) THEN CAST(min(l_linenumber) AS VARCHAR) ELSE min(l_linenumber) || '–' || max(l_linenumber) END AS label FROM lineitem GROUP BY 1")
def range_labels(spark, sf_dir):
    spans = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return spans.select("l_orderkey", text.range_label(C("a"), C("b")).alias("label"))


@query("SELECT 'preview-' || left(sha256(url), 20) AS id, min(page_id) AS first_page FROM pages GROUP BY url")
def preview_ids(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages").select(C("url").alias("path"), "page_id")
    return dedup.first_wins(p, ["path"], "page_id").select(text.preview_id(C("path")).alias("id"), C("page_id").alias("first_page"))


@query("SELECT p_partkey, trim(p_name) AS section, CAST(2 - p_partkey % 2 AS INT) AS n, '.' || lower(p_type) AS extension FROM part")
def filters_normalized(spark, sf_dir):
    raw = F.array(F.concat(F.lit("  "), "p_name", F.lit("\t")), F.when(C("p_partkey") % 2 == 0, C("p_brand")).otherwise(" "))
    s, _, e = predicates.normal_filters(raw, F.array().cast("array<string>"), F.array(F.lit(" "), F.concat(F.lit(".."), "p_type")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.get(s, F.lit(0)).alias("section"), F.size(s).alias("n"), F.get(e, F.lit(0)).alias("extension"))


@query(f"WITH {ROUTED_SQL} SELECT category, key FROM s WHERE contains(lower(section), 'src1') AND url LIKE '%.txt'")
def changes_filtered(spark, sf_dir):
    page = spark.createDataFrame([("page_text_changed", "page")], "category string, key string")
    every = subject(spark, sf_dir).unionByName(page, allowMissingColumns=True)
    return routing.filtered(every, predicates.Filters(("SRC1",), (), ("TXT",))).select("category", "key")


@query(f"WITH {fx.PAIR_SQL} SELECT url FROM n WHERE contains(lower(section), 'src2') AND contains(lower(title), 'doc 1')")
def page_links_filtered(spark, sf_dir):
    """Extensions don't hold for page links."""
    f = predicates.Filters(("Src2",), ("DOC 1",), ("pdf",))
    return fx.snapshot(spark, sf_dir, "new").filter(predicates.link_matches(C("section"), C("title"), f)).select("url")


LABEL_ROWS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(dedup.LABELS))


@query(f"""WITH {fx.CHANGES_SQL}, t(place, category, label) AS (VALUES {LABEL_ROWS})
SELECT t.place, t.category, count(*) || ' ' || t.label AS line FROM changes JOIN t ON t.category = changes.category GROUP BY t.place, t.category, t.label""")
def summary_lines(spark, sf_dir):
    return dedup.summary(changes(spark, sf_dir)).select("place", "category", "line")


TREE_SQL = "r AS (SELECT source AS grid, doc_id AS pos, CAST((doc_id * 7) % 4 AS INT) AS level, lang || doc_id AS name FROM documents)"
LEVEL_SQL = ", ".join(
    f"""CASE WHEN level >= {n} AND max(CASE WHEN level = {n} THEN pos END) OVER w > coalesce(max(CASE WHEN level < {n} THEN pos END) OVER w, -1)
THEN arg_max(name, pos) FILTER (WHERE level = {n}) OVER w END""" for n in range(4)
)


@query(f"WITH {TREE_SQL} SELECT grid, pos, array_to_string(list_filter([{LEVEL_SQL}], lambda x: x IS NOT NULL), ' / ') AS path FROM r WINDOW w AS (PARTITION BY grid ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def tree_paths(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    rows = d.select(C("source").alias("grid"), C("doc_id").alias("pos"), (C("doc_id") * 7 % 4).cast("int").alias("level"), F.concat("lang", C("doc_id").cast("string")).alias("name"))
    return snapshot.flatten_tree(rows).select("grid", "pos", "path")


@query(f"""WITH {fx.PAIR_SQL}, r AS (SELECT DISTINCT split_part(section, ' / ', 1) AS source FROM n),
h AS (SELECT source, count(DISTINCT n.url) AS c, min(n.url) AS url FROM r LEFT JOIN n ON split_part(n.section, ' / ', 1) = source AND contains(n.url, '/documents/' || source || '/en/10') GROUP BY 1)
SELECT 'Rule ' || source AS title, CASE WHEN c = 1 THEN url END AS url, CASE WHEN c <> 1 THEN 'expected one matching link, found ' || c END AS error FROM h""")
def dynamic_links(spark, sf_dir):
    n = fx.snapshot(spark, sf_dir, "new").select(F.element_at(F.split("section", " / "), 1).alias("source_url"), "url", urls.host(C("url")).alias("host"), urls.path(C("url")).alias("path"))
    rules = n.select("source_url").distinct().select(F.concat(F.lit("Rule "), "source_url").alias("title"), "source_url", F.lit("DOCS.example.test").alias("match_host"), F.concat(F.lit("/Documents/"), "source_url", F.lit("/EN/10")).alias("match_path"))
    found, errors = snapshot.dynamic_documents(rules, n)
    return found.select("title", "url", F.lit(None).cast("string").alias("error")).unionByName(errors.select("title", F.lit(None).cast("string").alias("url"), "error"))


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 3")
def history_retained(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("user_id", "event_id", C("ts").alias("event_ts"), C("event_id").alias("seq"))
    return routing.retained(e, "user_id", 3).select("user_id", "event_id", "rank")


def images(spark, sf_dir):
    """image, y, old and new row of 64 gray values; some pixels differ."""
    e = fx.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("image"), (C("vec_id") % 64).cast("int").alias("y"), "vec_id")
    old = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: ((C("vec_id") * 7 + x * 3) % 256).cast("int"))
    new = F.transform(old, lambda v, x: F.when(((C("y") * 64 + x) % 577 == 5) | (C("y").between(9, 18) & x.between(40, 44)), 255 - v).otherwise(v))
    return e.select("image", "y", old.alias("old"), new.alias("new"))


@query("""WITH p AS (SELECT vec_id // 64 AS image, CAST(vec_id % 64 AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x FROM embeddings)
SELECT image, x // 16 AS cx, y // 16 AS cy, count(*) AS n, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom FROM p
WHERE (y * 64 + x) % 577 = 5 OR (y BETWEEN 9 AND 18 AND x BETWEEN 40 AND 44) GROUP BY 1, 2, 3""")
def difference_cells(spark, sf_dir):
    both = images(spark, sf_dir)
    return diff.pixel_cells(*[both.select("image", "y", C(side).alias("row")) for side in ("old", "new")])


@query("""WITH p AS (SELECT vec_id // 64 AS image, CAST(vec_id % 64 AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x FROM embeddings),
c AS (SELECT image, x // 16 AS cx, y // 16 AS cy, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM p WHERE (y * 64 + x) % 577 = 5 OR (y BETWEEN 9 AND 18 AND x BETWEEN 40 AND 44) GROUP BY 1, 2, 3),
s0 AS (SELECT *, cx * 100 + cy AS g FROM c),
s1 AS (SELECT a.image, a.cx, a.cy, a.l, a.t, a.r, a.b, min(z.g) AS g FROM s0 a JOIN s0 z ON a.image = z.image AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 GROUP BY ALL),
s2 AS (SELECT a.image, a.cx, a.cy, a.l, a.t, a.r, a.b, min(z.g) AS g FROM s1 a JOIN s1 z ON a.image = z.image AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 GROUP BY ALL),
s3 AS (SELECT a.image, a.cx, a.cy, a.l, a.t, a.r, a.b, min(z.g) AS g FROM s2 a JOIN s2 z ON a.image = z.image AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 GROUP BY ALL),
s4 AS (SELECT a.image, a.cx, a.cy, a.l, a.t, a.r, a.b, min(z.g) AS g FROM s3 a JOIN s3 z ON a.image = z.image AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 GROUP BY ALL),
h AS (SELECT image, max(y) + 1 AS height FROM p GROUP BY 1)
SELECT s4.image, CAST(greatest(min(l) - 3, 0) AS INT) AS "left", CAST(greatest(min(t) - 3, 0) AS INT) AS top, CAST(least(max(r) + 3, 63) AS INT) AS "right", CAST(least(max(b) + 3, max(height) - 1) AS INT) AS bottom
FROM s4 JOIN h ON s4.image = h.image GROUP BY s4.image, g""")
def difference_boxes(spark, sf_dir):
    both = images(spark, sf_dir)
    cells = diff.pixel_cells(*[both.select("image", "y", C(side).alias("row")) for side in ("old", "new")])
    sizes = both.groupBy("image").agg(F.max(F.size("new")).alias("width"), (F.max("y") + 1).alias("height"))
    return sequence.boxes(cells, sizes)


RECORD_TITLE = "CASE doc_id % 4 WHEN 0 THEN 'SQS-Daily-' || doc_id WHEN 1 THEN 'My sqs-daily-1' ELSE 'Doc ' || doc_id END"
RECORD_URL = "'https://docs.example.test/' || CASE doc_id % 3 WHEN 0 THEN 'PayItems/SQS%2Ddaily-' WHEN 1 THEN 'sqs-daily-' ELSE 'payitems/x-' END || doc_id || '.txt'"


@query(f"""WITH r AS (SELECT doc_id, {RECORD_TITLE} AS title, {RECORD_URL} AS url FROM documents)
SELECT doc_id FROM r WHERE starts_with(lower(title), 'sqs-daily-') OR contains(lower(url_decode(regexp_extract(url, '{URL_RE}', 3))), '/payitems/sqs-daily-')""")
def record_documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(RECORD_TITLE).alias("title"), F.expr(RECORD_URL).alias("url"))
    return d.filter(predicates.is_record_document(C("title"), C("url"))).select("doc_id")


@query(r"""WITH r AS (SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') || CASE page_id % 3 WHEN 0 THEN '.PDF?x=1' WHEN 1 THEN '.docx' ELSE '.html' END AS url,
CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'Application/XHTML+xml' WHEN 2 THEN 'application/pdf' END AS content_type FROM pages)
SELECT page_id, 'expected a ' || CASE page_id % 3 WHEN 0 THEN '.pdf' ELSE '.docx' END || ' file, got ' || content_type AS error FROM r WHERE page_id % 3 < 2 AND page_id % 4 < 2""")
def refused_downloads(spark, sf_dir):
    k = C("page_id")
    base = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    r = fx.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(base, F.when(k % 3 == 0, ".PDF?x=1").when(k % 3 == 1, ".docx").otherwise(".html")).alias("url"),
        F.when(k % 4 == 0, "text/html").when(k % 4 == 1, "Application/XHTML+xml").when(k % 4 == 2, "application/pdf").alias("content_type"),
    )
    return files.refused(r).select("page_id", "error")


@query()
def page_previews(spark, sf_dir):
    """Pairs of changed pages; previews of every third page are missing."""
    m = modified(spark, sf_dir)
    side = lambda c: F.transform(pages_of(C(c)), lambda p: p.withField("preview_path", F.concat(C("key"), F.lit(f"/{c}/"), p["page"].cast("string"))))
    rows = m.select("key", side("old").alias("a"), side("new").alias("b"))
    paths = rows.select(F.explode(F.concat("a.preview_path", "b.preview_path")).alias("path"))
    return snapshot.preview_pairs(rows, "key", C("a"), C("b"), paths.filter(~C("path").rlike("/[0-9]*[369]$")))


def registered() -> None:
    """Adds the queries of the other modules."""
    from . import artifacts, flows  # noqa: F401  they take the decorator from here


def queries() -> dict:
    registered()
    return dict(MADE)


def oracle_sql() -> dict[str, str]:
    registered()
    return dict(SQL)
