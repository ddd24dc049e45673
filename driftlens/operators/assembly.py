"""A snapshot's documents from what a scan brings: page links, extra and dynamic documents, downloads, the baseline.

Which earlier row belongs to a document (by identity, else by URL, the last of
equals) is looked up for all documents, failed ones and failed rules at once:
earlier rows stand in one table under both of their keys, and a document asks
for its keys in order. So a lookup never multiplies rows, and one join serves
carrying, reuse and comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.predicates import Exclusions, Filters, is_excluded, matches_fixed
from ..functions.text import fold, normalize
from . import dedup

# Where documents without a section of their own stand, and the mark of a rule's document.
EXTRA_SECTION, DYNAMIC, DYNAMIC_SECTION = "Explicitly monitored documents", "dynamic:", "Dynamically monitored documents"
PAGE, EXTRA, RULE = range(3)
ASKED = ("url", "title", "section", "sha256", "analysis")


def keys_of(identity: Column, url: Column) -> Column:
    """The keys under which a document is known, the first one first."""
    return F.array(F.concat(F.lit("i:"), F.coalesce(identity, url)), F.concat(F.lit("u:"), url))


def with_column(rows: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))


def earlier(rows: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Adds prev: a struct of these columns of the earlier row by identity, else by URL; null without one.

    Of several earlier rows of a key the last (by pos) counts. Rows need identity and url; repeated rows stay.
    """
    known = with_column(before, "pos", "bigint").withColumn("pos", F.coalesce("pos", F.lit(0)))
    known = known.select(F.struct(*columns).alias("prev"), F.col("pos").alias("at"), F.posexplode(keys_of(F.col("identity"), F.col("url"))).alias("nth", "lookup")).filter("lookup IS NOT NULL")
    known = dedup.pick(known.select("lookup", "prev", "at"), ["lookup"], -F.col("at"), F.md5(F.to_json("prev"))).select("lookup", "prev")
    asked = rows.select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("rid"))
    asked = asked.select("row", "rid", F.posexplode(keys_of(F.col("row.identity"), F.col("row.url"))).alias("nth", "lookup"))
    met = asked.join(known, "lookup", "left").groupBy("rid").agg(
        F.first("row").alias("row"), F.min_by("prev", F.when(F.col("prev").isNotNull(), F.col("nth"))).alias("prev")
    )
    return met.select("row.*", "prev")


def resolved(rules: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of rules (title, source_url, match_host, match_path): a rule must match exactly one distinct link.

    ``found`` has source_url, url, host, path: the links of the rules' sources. Rules are told apart by number, so two
    with one title are two; a source without links is an error like any other without a match.
    """
    numbered = with_column(rules, "section").withColumn("section", F.coalesce(F.nullif(normalize("section"), F.lit("")), F.lit(DYNAMIC_SECTION))).withColumn("rule", F.monotonically_increasing_id()).withColumn("title", F.coalesce(F.nullif(normalize(F.col("title")), F.lit("")), F.lit("dynamic document")))
    links = found.select(F.col("source_url").alias("source"), "url", F.lower("host").alias("host"), F.lower("path").alias("path")).distinct()
    hit = (F.col("source_url") == F.col("source")) & (F.col("host") == F.lower("match_host")) & (F.coalesce("match_path", F.lit("")).eqNullSafe("") | F.contains(F.col("path"), F.lower("match_path")))
    met = numbered.join(links, hit, "left").groupBy("rule", "title", "section", "source_url").agg(F.count_distinct("url").alias("n"), F.min("url").alias("url"))
    documents = met.filter("n = 1").select(F.concat(F.lit(DYNAMIC), "title").alias("identity"), "url", "title", "section", "rule")
    said = F.concat(F.lit("expected one matching link, found "), F.col("n").cast("string"))
    return documents, met.filter("n <> 1").select("title", F.col("source_url").alias("url"), said.alias("error"), F.concat(F.lit(DYNAMIC), "title").alias("identity"), "rule")


def wanted(page: DataFrame, extra: DataFrame | None = None, dynamic: DataFrame | None = None, page_url: str = "") -> DataFrame:
    """identity, url, title, section, pos of all documents: the page's, then extra ones, then rules' ones; the first of a URL counts.

    Extra documents' addresses are made canonical, so that one that the page links to already isn't added again.
    """
    origin = lambda n, pos: (F.lit(n) * F.lit(1 << 40) + F.coalesce(pos, F.lit(0))).cast("long").alias("pos")
    one = dedup.prefer_section(with_column(page, "pos", "bigint"))
    rows = one.select(F.lit(None).cast("string").alias("identity"), "url", "title", "section", origin(PAGE, F.col("pos")))
    if extra is not None:
        own = with_column(with_column(extra, "pos", "bigint"), "section")
        own = own.select(F.lit(None).cast("string").alias("identity"), urls.canonical(F.lit(page_url), F.col("url")).alias("url"), normalize("title").alias("title"), F.coalesce(F.nullif(normalize("section"), F.lit("")), F.lit(EXTRA_SECTION)).alias("section"), origin(EXTRA, F.col("pos")))
        rows = rows.unionByName(own)
    if dynamic is not None:
        rows = rows.unionByName(dynamic.select("identity", "url", "title", "section", origin(RULE, F.col("rule"))))
    return dedup.pick(rows, ["url"], F.col("pos"), F.col("title"))


@dataclass(frozen=True)
class Assembly:
    """documents (with carried, reused and, where analysis is null, to be analysed), errors (title, url, error)."""

    documents: DataFrame
    errors: DataFrame

    @property
    def to_analyse(self) -> DataFrame:
        """Fetched documents without an analysis that could be reused."""
        return self.documents.filter("NOT carried AND NOT reused")

    def by_url(self) -> DataFrame:
        """The documents in the order of their folded URLs."""
        return self.documents.orderBy(fold(F.col("url")), "pos")


def assemble(
    page: DataFrame, fetched: DataFrame, failures: DataFrame, before: DataFrame, extra: DataFrame | None = None, rules: DataFrame | None = None, found_links: DataFrame | None = None,
    filters: Filters = Filters(), exclusions: Exclusions | None = None, page_url: str = "", previews: DataFrame | None = None, force: bool = False,
) -> Assembly:
    """Joins a scan into a snapshot.

    ``page`` has url, title, section, pos (monitored links of the page); ``fetched`` url, sha256 and what else was
    learnt; ``failures`` url, error. ``before`` is the baseline's documents. A document that failed keeps its earlier
    row (carried) beside its error, a rule that failed that of its identity if the filters still want it; one that was
    neither fetched nor failed counts as failed. An analysis is reused where the digest is as before and, if ``previews``
    (name: the digests with stored previews) is given, its previews are there; ``force`` reuses none.
    """
    before = with_column(with_column(before, "identity"), "analysis")
    columns = [*ASKED, "identity"]
    dynamic, failed_rules = resolved(rules, found_links) if rules is not None else (None, None)
    docs = wanted(page, extra, dynamic, page_url)
    at = [F.col(c) for c in ("section", "title", "url")]
    docs = docs.filter(matches_fixed(*at, filters))
    if exclusions is not None:
        docs = docs.filter(~is_excluded(at[0], at[2], exclusions))
    own = with_column(fetched, "analysis", before.schema["analysis"].dataType.simpleString())
    own = dedup.pick(own.select("url", "sha256", "analysis"), ["url"], F.col("sha256")).withColumn("came", F.lit(True))
    bad = dedup.pick(failures.select("url", "error"), ["url"], F.col("error"))
    rows = docs.join(own, "url", "left").join(bad, "url", "left").withColumn("failed", F.lit(None).cast("string"))
    columns_now = ["identity", "url", "title", "section", "pos", "sha256", "analysis", "came", "error", "failed"]
    rows = rows.select(*columns_now)
    if failed_rules is not None:
        lost = failed_rules.select("identity", "url", "title", F.lit(DYNAMIC_SECTION).alias("section"), (F.lit(3 << 40) + F.col("rule")).alias("pos"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast(own.schema["analysis"].dataType).alias("analysis"), F.lit(None).cast("boolean").alias("came"), "error", F.lit("rule").alias("failed"))
        rows = rows.unionByName(lost)
    both = earlier(rows, before, columns)
    came = F.coalesce("came", F.lit(False)) & F.col("error").isNull()
    # A rule's source isn't the document: only its identity leads to the earlier row.
    usable = F.col("prev").isNotNull() & (F.col("failed").isNull() | (F.col("prev.identity").eqNullSafe(F.col("identity")) & matches_fixed(F.col("prev.section"), F.col("prev.title"), F.col("prev.url"), filters)))
    same = F.col("prev.sha256").eqNullSafe(F.col("sha256")) & F.col("prev.analysis").isNotNull() & F.lit(not force)
    both = both.select("*", came.alias("ok"), usable.alias("usable"), same.alias("same"))
    if previews is not None:
        stored = previews.select(F.col("name").alias("stored")).distinct()
        both = both.join(stored, F.col("sha256") == F.col("stored"), "left").withColumn("same", F.col("same") & F.col("stored").isNotNull())
    keep = F.col("ok") | F.col("usable")
    pick = lambda c, p=None: F.when(F.col("ok"), F.col(c)).otherwise(F.col(f"prev.{p or c}")).alias(c)
    reused = (F.col("ok") & F.coalesce("same", F.lit(False))).alias("reused")
    analysis = F.when(F.col("ok") & ~F.coalesce("same", F.lit(False)), F.col("analysis")).otherwise(F.col("prev.analysis")).alias("analysis")
    documents = both.filter(keep).select(pick("identity"), pick("url"), pick("title"), pick("section"), "pos", pick("sha256"), analysis, (~F.col("ok")).alias("carried"), reused)
    documents = documents.withColumn("key", F.coalesce("identity", "url"))
    said = F.coalesce(normalize(F.col("error")), F.lit("not fetched"))
    return Assembly(documents, both.filter("NOT ok").select("title", "url", said.alias("error"), "pos"))
