"""Choosing one row of a key, and counts over categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of the change categories, in their order.
LABELS = [
    ("page_text_changed", "Visible page content changed"),
    ("folders_added", "folder(s) added"),
    ("folders_removed", "folder(s) removed"),
    ("documents_added", "document(s) added"),
    ("documents_removed", "document(s) removed"),
    ("documents_modified", "document(s) modified"),
    ("documents_renamed", "document(s) renamed"),
    ("documents_relinked", "document link(s) changed"),
    ("documents_moved", "document(s) moved"),
    ("links_added", "page link(s) added"),
    ("links_removed", "page link(s) removed"),
    ("links_renamed", "page link title(s) changed"),
]


def pick(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Aggregates before the shuffle, so a frequent key doesn't gather."""
    rest = [c for c in rows.columns if c not in keys]
    names = [f"o{i}" for i in range(len(order))]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)]))
    return rows.groupBy(*keys).agg(first.alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return pick(rows, keys, F.col(pos))


def last_wins(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return pick(rows, keys, -F.col(pos))


def prefer_section(rows: DataFrame, key: str = "url", section: str = "section", pos: str = "pos") -> DataFrame:
    """For each key the first row with a section, else the first."""
    return pick(rows, [key], F.coalesce(F.col(section), F.lit("")) == "", F.col(pos))


def most_complete(items: DataFrame, pos: str = "pos") -> DataFrame:
    """For each code the record with the longest values, the first on a tie."""
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("code", "description", "unit", "category")), F.lit(0))
    return pick(items, ["code"], -size, F.col(pos))


def summary(changes: DataFrame) -> DataFrame:
    """place, category, n, line for each category with changes, in the order of the labels."""
    labels = changes.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(LABELS)], "place int, category string, label string")
    n = changes.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    line = F.when(F.col("place") == 0, F.col("label")).otherwise(F.concat_ws(" ", F.col("n").cast("string"), "label"))
    return n.join(F.broadcast(labels), "category").select("place", "category", "n", line.alias("line"))


def newest(events: DataFrame, most: int, ts: str = "event_ts", seq: str = "seq") -> DataFrame:
    """The newest events of a log, at least one; a top-k, not a window over the log."""
    return events.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(max(1, most))


def capped(details: Column, most: int, what: str) -> Column:
    """The first details and a line that counts the others."""
    more = F.concat(F.greatest(F.size(details) - most, F.lit(0)).cast("string"), F.lit(f" additional {what} omitted"))
    return F.concat(F.slice(details, 1, most), F.when(F.size(details) > most, F.array(more)).otherwise(F.array().cast("array<string>")))


def top_details(rows: DataFrame, group: list[str], order: list[str], most: int, what: str) -> DataFrame:
    """group, place, detail: the first ``most`` details of each group and the overflow line; ranks are limited before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*group, "place", "detail")
    more = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    line = F.concat((F.col("n") - most).cast("string"), F.lit(f" additional {what} omitted"))
    return kept.unionByName(more.select(*group, F.lit(most + 1).alias("place"), line.alias("detail")))
