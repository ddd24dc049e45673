"""Assembling a snapshot: earlier rows, carried rows, reused analyses, extra and dynamic documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.text import WHITE
from ..sources.tables import kept
from . import assembly
from .dedup import pick, prefer_section
from .sequence import page_pairs

ROW = ["identity", "url", "title", "section", "sha256"]


def extra_documents(found: DataFrame, extra: DataFrame, section: str = assembly.EXTRA_SECTION, base: str = "") -> DataFrame:
    """Adds documents whose canonical URL isn't known yet, the first of a URL, under a default section."""
    own = extra.withColumn("url", urls.canonical(F.lit(base), F.col("url"))).withColumn("section", F.coalesce("section", F.lit(section)))
    order = [F.col("pos")] if "pos" in own.columns else []
    own = pick(own, ["url"], *order, F.md5(F.to_json(F.struct(*own.columns))))
    return found.unionByName(own.join(found.select("url"), "url", "left_anti"), allowMissingColumns=True)


def candidates(links: DataFrame) -> DataFrame:
    return prefer_section(links)


def dynamic_documents(rules: DataFrame, found_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, errors): a rule (title, source_url, match_host, match_path) must match exactly one distinct link of its source.

    ``found_links`` has source_url, url, host, path. Identity is ``dynamic:<title>``.
    """
    found, errors = assembly.resolved(rules, found_links)
    return found.select("identity", "url", "title"), errors.select("title", "url", "error", "identity")


def previous(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Adds prev_url, prev_title, prev_section, prev_sha256: the earlier row by identity, else by URL, the last of several."""
    both = assembly.earlier(rows, before, ROW)
    return both.select(*rows.columns, *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in ROW[1:]])


def carry_forward(fetched: DataFrame, errors: DataFrame, before: DataFrame) -> DataFrame:
    """Fetched rows, and for documents that failed their earlier row, if there is one; ``carried`` tells which.

    A failed document is known by its URL or, if ``errors`` has one, its identity; an earlier row is carried once.
    """
    kept_rows = fetched.withColumn("carried", F.lit(False))
    known = assembly.with_column(before, "identity")
    named = assembly.with_column(errors, "identity").select("identity", "url").distinct()
    asked = F.explode(F.array(F.concat(F.lit("i:"), "identity"), F.concat(F.lit("u:"), "url"))).alias("lookup")
    failed = named.select(asked).filter("lookup IS NOT NULL").distinct()
    rows = known.select(F.struct(*known.columns).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.select("row", "rid", F.explode(F.array(F.concat(F.lit("i:"), "row.identity"), F.concat(F.lit("u:"), "row.url"))).alias("lookup")).join(failed, "lookup", "left_semi")
    once = rows.groupBy("rid").agg(F.first("row").alias("row")).select("row.*")
    return kept_rows.unionByName(once.join(fetched.select("url"), "url", "left_anti").select(*fetched.columns).withColumn("carried", F.lit(True)))


def split_reuse(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to analyse): an analysis is reused where the key's digest is unchanged and an analysis exists; the key's last earlier row counts."""
    held = assembly.with_column(before, "pos", "bigint").select("key", "sha256", "analysis", F.coalesce("pos", F.lit(0)).alias("pos"))
    last = pick(held, ["key"], -F.col("pos"), F.col("sha256"))
    prev = last.select(F.col("key").alias("k"), F.col("sha256").alias("s"), F.col("analysis").alias("reused"))
    both = rows.join(prev, (F.col("key") == F.col("k")) & F.col("sha256").eqNullSafe(F.col("s")) & F.col("reused").isNotNull(), "left")
    return both.filter("k IS NOT NULL").select(*rows.columns, F.col("reused").alias("analysis")), both.filter("k IS NULL").select(*rows.columns)


def stale_previews(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Preview folders (name) that are named by a digest which no current document has; other names are left alone."""
    return folders.filter(F.col("name").rlike("^[0-9a-f]{64}$")).join(documents.select(F.col("sha256").alias("name")), "name", "left_anti")


def preview_pairs(documents: DataFrame, key: str, old, new, present: DataFrame) -> DataFrame:
    """key, place, old_page, new_page, old_path, new_path, note: the changed pages of each document and their previews.

    ``old`` and ``new`` are arrays of page structs (with preview_path), ``present``
    the listing of existing files (path); a path that isn't in it becomes empty.
    """
    listed = present.select("path").distinct()
    pairs = documents.select(key, F.posexplode(page_pairs(old, new)).alias("place", "p"))
    pairs = pairs.select(key, "place", *[F.col(f"p.{s}.{c}").alias(f"{s}_{n}") for c, n in (("page", "page"), ("preview_path", "path")) for s in ("old", "new")])
    for side in ("old", "new"):
        held = listed.select(F.col("path").alias(f"{side}_path"), F.lit(True).alias(f"{side}_held"))
        pairs = pairs.join(held, f"{side}_path", "left").withColumn(f"{side}_path", F.when(F.col(f"{side}_held"), F.col(f"{side}_path")).otherwise(""))
    note = F.when((F.col("old_path") == "") | (F.col("new_path") == ""), "Highlights require both page previews.")
    return pairs.select(key, "place", "old_page", "new_page", "old_path", "new_path", note.alias("note"))


def ancestors(sections: DataFrame, column: str = "section") -> DataFrame:
    """path, title, depth: every section and all that stand above it."""
    parts = F.split(column, " / ")
    each = sections.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " / "))).alias("path")).distinct()
    own = F.split("path", " / ")
    return each.select("path", F.element_at(own, -1).alias("title"), F.size(own).alias("depth"))


def placed(links: DataFrame, hosts: list[str], root: str = "documents") -> DataFrame:
    """Links (url, section) of these hosts below /root/ get their section from the folders of their URL's path; others keep theirs.

    A null URL keeps its section, too. ``ancestors`` of the result has the folders above.
    """
    parts = F.filter(F.split(urls.unquote(urls.path(F.col("url"))), "/"), lambda p: p != "")
    ours = urls.host(F.col("url")).isin(*hosts) & (F.size(parts) >= 3) & (text.fold(F.get(parts, F.lit(0))) == root)
    below = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), " / ")
    return links.withColumn("section", F.when(ours, below).otherwise(F.col("section")))


def valid_folders(folders: DataFrame, top: list[str], column: str = "path") -> DataFrame:
    """Folders below one of the top categories that have no blank part; a null path isn't valid."""
    parts = F.split(column, " / ")
    return folders.filter(F.get(parts, F.lit(0)).isin(*top) & ~F.exists(parts, lambda p: p.rlike(rf"^({WHITE})?$")))


def by_url(documents: DataFrame) -> DataFrame:
    """Documents by folded URL, as given (``pos``) among equal ones; null URLs first."""
    return documents.orderBy(text.fold(F.col("url")), "pos")


#: Rows of a tree that one range has at most, about.
RANGE_ROWS = 1 << 20
STACK = "array<struct<level:int,name:string>>"


def open_after(before: Column, least: Column, own: Column) -> Column:
    """The open path behind a range: what stood open before it above the range's highest level, then what the range leaves open.

    Associative, so summaries of ranges compose in any grouping.
    """
    return F.concat(F.filter(before, lambda x: x["level"] < least), own)


def range_summaries(rows: DataFrame, order: str) -> DataFrame:
    """grid, range, least (the highest level that occurs), own (levels left open at the end, with their names)."""
    last = rows.groupBy("grid", "range", "level").agg(F.max(F.struct(order, "name")).alias("last"))
    every = last.groupBy("grid", "range").agg(F.min("level").alias("least"), F.array_sort(F.collect_list(F.struct("level", F.col(f"last.{order}").alias("at"), F.col("last.name").alias("name")))).alias("levels"))
    # A level stays open if no higher one (a smaller number) came after its last name.
    ends = F.filter("levels", lambda x: ~F.exists("levels", lambda y: (y["level"] < x["level"]) & (y["at"] > x["at"])))
    return every.select("grid", "range", "least", F.transform(ends, lambda x: F.struct(x["level"].alias("level"), x["name"].alias("name"))).cast(STACK).alias("own"))


def open_before(summaries: DataFrame) -> DataFrame:
    """grid, range, carried: the open path with which each range begins, by composing the summaries of the ranges before it."""
    listed = summaries.groupBy("grid").agg(F.array_sort(F.collect_list(F.struct("range", "least", "own"))).alias("parts"))
    start = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast(f"array<struct<range:int,carried:{STACK}>>").alias("out"))

    def step(s, x):
        told = F.struct(x["range"].alias("range"), s["stack"].alias("carried"))
        return F.struct(open_after(s["stack"], x["least"], x["own"]).alias("stack"), F.concat(s["out"], F.array(told)).alias("out"))

    made = listed.select("grid", F.explode(F.aggregate("parts", start, step)["out"]).alias("x"))
    return made.select(F.col("grid").alias("grid_"), F.col("x.range").alias("range_"), F.col("x.carried").alias("carried"))


def flatten_tree(rows: DataFrame, order: str = "pos", ranges: int | None = None) -> DataFrame:
    """Adds path to an indented listing (grid, pos, level, name): each level's last name, unless a higher level came since.

    A segmented scan over ranges of (grid, pos): each range is summed up by the path that it leaves open, these
    summaries compose to the path with which each range begins, and then every range is walked on its own. So a grid may
    span any number of tasks, one row a range is all that meets, and levels may have any depth. Rows of one place are
    taken in the order of level and name; a null level or place counts as 0, a null name as empty, and empty names
    aren't shown.
    """
    number = ranges or max(1, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tidy = rows.select(F.struct(*rows.columns).alias("row"), F.col("grid").alias("grid"), F.coalesce(F.col(order), F.lit(0).cast(kinds[order])).alias("place"), F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), F.coalesce("name", F.lit("")).alias("name"))
    salted = tidy.withColumn("at", F.struct("place", "level", "name", F.monotonically_increasing_id().alias("nth")))
    dealt = kept(salted.repartitionByRange(number, "grid", "at").withColumn("range", F.spark_partition_id()), "tree")
    begins = open_before(range_summaries(dealt, "at"))
    met = dealt.join(begins, F.expr("grid <=> grid_ AND `range` = range_"), "left").drop("grid_", "range_")
    ordered = met.repartition(number, "range").sortWithinPartitions("range", "grid", "at").select("row", "grid", "range", "level", "name", "carried")

    def walk(batches):
        grid, at, stack = None, None, []
        for batch in batches:
            paths = []
            here = zip(*(batch.column(c).to_pylist() for c in ("grid", "range", "level", "name", "carried")), strict=True)
            for g, r, level, name, carried in here:
                if at != r or grid != g:
                    grid, at, stack = g, r, [(x["level"], x["name"]) for x in carried or []]
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, name))
                paths.append(" / ".join(n for _, n in stack if n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["row", "path"])

    return ordered.mapInArrow(walk, f"row {dealt.schema['row'].dataType.simpleString()}, path string").select("row.*", "path")
