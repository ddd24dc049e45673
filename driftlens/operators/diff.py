"""Differences of two snapshots: documents, links, folders, cells and records, as a long table of changes.

One full outer join on the key gives added, removed, modified, renamed and
relinked rows. Categories aren't exclusive, so a row becomes a row for each
category by an exploded array; a filter on the category then leaves the branch
that has it. Nothing is written or run before the result is asked for. Moves pair removed with added rows of
equal digest by rank within the digest: both sides are ranked in one pass and
met by (digest, rank). A digest that very many rows share (empty files) is the
one place where a key can be hot: ranks are taken with a prefix count over key
ranges, so such a digest isn't one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Exclusions, is_excluded
from .dedup import last_wins
from .sequence import analysis_details, cell_text, word_details

DOCUMENT = ["url", "title", "section", "sha256"]


def same_rendering(old_pages: Column, new_pages: Column) -> Column:
    """Whether two page arrays (visual_sha256, text_sha256) look alike, page by page."""
    sign = lambda pages: F.transform(pages, lambda p: F.coalesce(F.nullif(p["visual_sha256"], F.lit("")), p["text_sha256"], F.lit("")))
    return F.coalesce(sign(old_pages) == sign(new_pages), F.lit(False))


def _ranked(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds the rank within ``by`` in the order of (sub-range, key); the key's hash gives one of 256 sub-ranges. ``by`` may be null."""
    cut = rows.withColumn("range", F.substring(F.md5(F.col(key)), 1, 2))
    counts = cut.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    named = {c: f"{c}_" for c in [*by, "range"]}
    counts = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*[F.col(c).alias(n) for c, n in named.items()], "begin")
    inside = Window.partitionBy(*by, "range").orderBy(key)
    out = cut.withColumn("own", F.row_number().over(inside)).join(counts, F.expr(" AND ".join(f"`{c}` <=> `{n}`" for c, n in named.items())))
    return out.withColumn("rank", F.col("begin") + F.col("own")).drop(*named.values(), "begin", "own", "range")


def documents(old: DataFrame, new: DataFrame, repackaged: Column | None = None, mute_added: bool = False, exclusions: Exclusions | None = None) -> DataFrame:
    """category, key, old_key, old_title, new_title, old_url, new_url, section (the new one, else the old).

    ``old`` and ``new`` have key, url, title, section, sha256, pos; the last
    row of a key counts. ``repackaged`` is a condition over the joined columns
    (prefix old_ and new_) under which a new digest is no modification.
    ``mute_added`` is the gate of a schema upgrade. Excluded documents are left
    out of both snapshots, so that a new exclusion isn't told as a removal.
    """
    if exclusions is not None:
        old, new = (d.filter(~is_excluded(F.col("section"), F.col("url"), exclusions)) for d in (old, new))
    sides = [last_wins(d.select("key", *DOCUMENT, *[c for c in d.columns if c == "pages"], "pos"), ["key"]) for d in (old, new)]
    named = [s.select("key", *[F.col(c).alias(f"{p}_{c}") for c in s.columns if c != "key"], F.lit(True).alias(f"in_{p}")) for s, p in zip(sides, ("old", "new"), strict=True)]
    differs = ~F.col("old_sha256").eqNullSafe(F.col("new_sha256"))
    if repackaged is not None:
        differs &= ~repackaged
    tests = {"documents_modified": differs, "documents_renamed": ~F.col("old_title").eqNullSafe(F.col("new_title")), "documents_relinked": ~F.col("old_url").eqNullSafe(F.col("new_url"))}
    stays = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]))
    lost, came = F.array(F.lit("documents_removed")), F.array(F.lit("documents_added"))
    category = F.when(F.col("in_new").isNull(), lost).when(F.col("in_old").isNull(), came).otherwise(stays)
    # The categories come from one join; both branches below read the same exchanges of it.
    both = named[0].join(named[1], "key", "full_outer").withColumn("category", F.explode(category))
    lone = moves(both.filter(F.col("category").isin("documents_removed", "documents_added")))
    if mute_added:
        lone = lone.filter("category <> 'documents_added'")
    stayed = both.filter(F.col("category").isin(*tests))
    return lone.unionByName(stayed.select("category", "key", F.col("key").alias("old_key"), "old_title", "new_title", "old_url", "new_url", F.col("new_section").alias("section")))


def moves(lone: DataFrame) -> DataFrame:
    """Pairs removed with added rows (category, key, old_ and new_ values) of equal digest; each row is in one pair at most.

    Both sides are ranked at once within their digest, then met by digest and rank.
    """
    side = F.when(F.col("category") == "documents_added", "new").otherwise("old")
    alone = lone.select("key", side.alias("side"), *[F.coalesce(f"old_{c}", f"new_{c}").alias(c) for c in DOCUMENT])
    of = lambda p, c, name: F.max(F.when(F.col("side") == p, F.col(c))).alias(name)
    met = _ranked(alone, ["side", "sha256"], "key").groupBy("sha256", "rank").agg(
        *[of(p, c, f"{p}_{c}") for p in ("old", "new") for c in ("key", "title", "url", "section")], *[F.count(F.when(F.col("side") == p, 1)).alias(f"{p}_n") for p in ("old", "new")]
    )
    kind = F.when(F.col("old_n") == 0, "documents_added").when(F.col("new_n") == 0, "documents_removed").otherwise("documents_moved")
    section = F.when(F.col("new_n") > 0, F.col("new_section")).otherwise(F.col("old_section"))
    return met.select(kind.alias("category"), F.coalesce("new_key", "old_key").alias("key"), "old_key", "old_title", "new_title", "old_url", "new_url", section.alias("section"))


def keyed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], names: tuple[str | None, str | None, str | None], pos: str = "pos") -> DataFrame:
    """Full outer difference on keys (last row wins): category, keys, old_ and new_ values. A name of None leaves a category out."""
    sides = [last_wins(d.select(*keys, *values, pos), keys, pos).drop(pos) for d in (old, new)]
    named = [s.select(*keys, *[F.col(v).alias(f"{p}_{v}") for v in values], F.lit(True).alias(f"in_{p}")) for s, p in zip(sides, ("old", "new"), strict=True)]
    both = named[0].join(named[1], keys, "full_outer")
    changed = F.lit(False)
    for v in values:
        changed |= ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    added, removed, updated = names
    kind = F.when(F.col("in_old").isNull(), F.lit(added)).when(F.col("in_new").isNull(), F.lit(removed)).when(changed, F.lit(updated))
    return both.withColumn("category", kind).filter("category IS NOT NULL").select("category", *keys, *[f"{p}_{v}" for p in ("old", "new") for v in values])


def links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links compared by URL."""
    return keyed(old, new, ["url"], ["title"], ("links_added", "links_removed", "links_renamed"))


def sections_of(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, section: the new snapshot's last section of a key, else the old one's."""
    both = new.select(key, "section", "pos", F.lit(1).alias("side")).unionByName(old.select(key, "section", "pos", F.lit(0).alias("side")))
    return both.filter("section IS NOT NULL").groupBy(key).agg(F.max(F.struct("side", "pos", "section")).alias("last")).select(key, F.col("last.section").alias("section"))


SUBJECT = ["category", "key", "old_key", "old_title", "new_title", "old_url", "new_url", "section"]


def snapshots(old: dict[str, DataFrame], new: dict[str, DataFrame], old_version: int = 3, new_version: int = 3, exclusions: Exclusions | None = None) -> DataFrame:
    """All changes in one long table (``SUBJECT``, url, title): documents, links, folders and page text.

    A snapshot is a dictionary of tables: documents; links (url, title,
    section, pos); folders (path, title, pos); page (page_text, one row). A
    table that either side lacks isn't compared.
    """
    none = F.lit(None).cast("string")
    parts = [documents(old["documents"], new["documents"], exclusions=exclusions)]
    if "links" in old and "links" in new:
        found = links(old["links"], new["links"]).join(sections_of(old["links"], new["links"], "url"), "url", "left")
        side = lambda p: F.when(F.col("category") != F.lit({"old": "links_added", "new": "links_removed"}[p]), F.col("url"))
        parts.append(found.select("category", F.col("url").alias("key"), side("old").alias("old_key"), "old_title", "new_title", side("old").alias("old_url"), side("new").alias("new_url"), "section"))
    both = "folders" in old and "folders" in new
    if both:
        found = folders(old["folders"], new["folders"])
        parts.append(found.select("category", F.col("path").alias("key"), none.alias("old_key"), "old_title", "new_title", none.alias("old_url"), none.alias("new_url"), F.col("path").alias("section")))
    if "page" in old and "page" in new:
        # One row each; of several the least counts, so that nothing is multiplied.
        texts = old["page"].select(F.lit("old").alias("side"), "page_text").unionByName(new["page"].select(F.lit("new").alias("side"), "page_text"))
        one = texts.agg(*[F.min(F.when(F.col("side") == p, F.col("page_text"))).alias(p) for p in ("old", "new")], F.count_distinct("side").alias("sides"))
        found = one.filter((F.col("sides") == 2) & ~F.col("old").eqNullSafe(F.col("new")))
        parts.append(found.select(F.lit("page_text_changed").alias("category"), *[none.alias(c) for c in SUBJECT[1:]]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = gate(out, old_version, new_version, both)
    return out.withColumn("url", F.coalesce("new_url", "old_url")).withColumn("title", F.coalesce("new_title", "old_title"))


def details(found: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """key, place, detail: what changed inside modified documents, and under an empty key in the page's text by words.

    Documents have details if both sides carry analyses (kind, units, reason); only modified ones are aligned.
    """
    out = found.sparkSession.createDataFrame([], "key string, place int, detail string")
    sides = [t["documents"] for t in (old, new) if "documents" in t and "analysis" in t["documents"].columns and t["documents"].schema["analysis"].dataType.typeName() == "struct"]
    if len(sides) == 2:
        modified = found.filter("category = 'documents_modified'").select("key").distinct()
        a, b = (last_wins(d.select("key", "analysis", "pos"), ["key"]).select("key", F.col("analysis").alias(n)) for d, n in zip(sides, ("a", "b"), strict=True))
        met = modified.join(a, "key").join(b, "key")
        out = out.unionByName(met.select("key", F.posexplode(analysis_details(F.col("a"), F.col("b"))).alias("place", "detail")))
    if "page" in old and "page" in new:
        text = lambda t: t["page"].agg(F.min("page_text").alias("t"))
        page = found.filter("category = 'page_text_changed'").select("category").distinct()
        both = page.select(text(old).scalar().alias("a"), text(new).scalar().alias("b"))
        out = out.unionByName(both.select(F.lit("").alias("key"), F.posexplode(word_details(F.col("a"), F.col("b"))).alias("place", "detail")))
    return out


def folders(old: DataFrame, new: DataFrame, both_have_them: bool = True) -> DataFrame:
    out = keyed(old, new, ["path"], ["title"], ("folders_added", "folders_removed", None))
    return out if both_have_them else out.limit(0)


def cell_details(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """group, sheet, cell, detail for cells that differ, by (sheet, cell)."""
    out = keyed(old, new, [*group, "sheet", "cell"], ["value"], ("added", "removed", "changed"))
    side = lambda c, other: F.when(F.col("category") != other, F.coalesce(c, F.lit("")))
    detail = cell_text(F.col("sheet"), F.col("cell"), side("old_value", "added"), side("new_value", "removed"))
    return out.select(*group, "sheet", "cell", detail.alias("detail"))


def line_multiset(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Order-insensitive companion of the sequence diff: key, line, surplus (positive: more often in new)."""
    both = old.select(key, "line", F.lit(-1).alias("n")).unionByName(new.select(key, "line", F.lit(1).alias("n")))
    return both.groupBy(key, "line").agg(F.sum("n").alias("surplus")).filter("surplus <> 0")


def gate(changes: DataFrame, old_version: int, new_version: int, folders_in_both: bool) -> DataFrame:
    """Mutes the categories that a schema upgrade would make up."""
    muted = []
    if old_version < 2 <= new_version:
        muted += ["documents_added", "links_added", "links_removed", "links_renamed", "folders_added", "folders_removed", "page_text_changed"]
    elif old_version < 3 <= new_version:
        muted += ["page_text_changed"]
    if not folders_in_both:
        muted += ["folders_added", "folders_removed"]
    return changes.filter(~F.col("category").isin(*muted)) if muted else changes


def pixel_cells(old: DataFrame, new: DataFrame, cell: int = 16) -> DataFrame:
    """image, cx, cy, n, left, top, right, bottom: where the pixels of two images (image, y, row) differ, by cell.

    Images whose sizes differ, or that one side lacks, have no cells. Cells are
    aggregated before the shuffle, so a large image doesn't gather in one task.
    """
    both = old.select("image", "y", F.col("row").alias("a")).join(new.select("image", "y", F.col("row").alias("b")), ["image", "y"], "full_outer")
    even = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") == F.size("b"))
    uneven = both.filter(~even).select("image").distinct()
    differs = F.zip_with("a", "b", lambda p, q: ~p.eqNullSafe(q))
    each = both.join(uneven, "image", "left_anti").select("image", "y", F.posexplode(differs).alias("x", "differs")).filter("differs")
    at = [F.floor(F.col(c) / cell).cast("int").alias(f"c{c}") for c in "xy"]
    return each.groupBy("image", *at).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom")
    )
