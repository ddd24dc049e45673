"""Reports: HTML from a small set of rows."""

from __future__ import annotations

import base64
import hashlib
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..operators import dedup


TEXT = "page_text_changed"
#: Changes of one page file.
PAGE_ROWS = 1000


def change_pages(changes: DataFrame, details: DataFrame | None, folder: str) -> str:
    """Writes all changes as pages of HTML rows, a folder a category and numbered files of ``PAGE_ROWS`` rows, by key; returns the folder.

    Changes are dealt by ranges of (category, key), so no task holds a category; pages follow the keys' order.
    """
    said = F.lit("")
    rows = changes.withColumn("at", F.when(F.col("category") == TEXT, F.lit("")).otherwise(F.coalesce("key", F.lit(""))))
    if details is not None:
        line = F.concat(F.lit("<li>"), escape_html(F.col("detail")), F.lit("</li>"))
        lists = details.groupBy(F.col("key").alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        rows = rows.join(lists, "at", "left")
        own = F.col("category").isin("documents_modified", TEXT) & F.col("lines").isNotNull()
        said = F.when(own, F.concat(F.lit("<ul>"), F.array_join("lines.line", ""), F.lit("</ul>"))).otherwise("")
    name, url, none = F.coalesce("new_title", "old_title", F.lit("")), F.coalesce("new_url", "old_url", F.lit("")), F.lit("")
    shown = F.when(F.lower(url).rlike("^https?://"), F.concat(F.lit('<a href="'), escape_html(url), F.lit('">'), escape_html(name), F.lit("</a>"))).otherwise(escape_html(name))
    cell = F.concat(F.lit("<tr><td>"), shown, said, F.lit("</td><td>"), escape_html(F.coalesce("key", none)), F.lit("</td></tr>"))
    ranges = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("category", "at", cell.alias("value")).repartitionByRange(ranges, "category", "at").sortWithinPartitions("category", "at")
    number = F.monotonically_increasing_id()
    page = F.concat(F.lpad(F.shiftright(number, 33).cast("string"), 6, "0"), F.lit("-"), F.lpad(F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {PAGE_ROWS}").cast("string"), 6, "0"))
    dealt.select("category", page.alias("page"), "value").write.mode("overwrite").partitionBy("category", "page").text(folder)
    return folder


def _list(items: list[str]) -> str:
    return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if items else ""


def _link(url: str | None, name: str) -> str:
    safe = url and url.lower().startswith(("http://", "https://"))
    return f'<a href="{escape(url)}">{escape(name)}</a>' if safe else escape(name)


def change_report(changes: DataFrame, title: str, most: int | None = None, details: DataFrame | None = None, records: DataFrame | None = None, previews: DataFrame | None = None, pages: str | None = None) -> str:
    """Counts over all changes, then a section for each category with its changes; or the first ``most`` of all and a line that counts the others.

    ``pages`` is the folder that ``change_pages`` wrote, with all changes, and is linked below the ones left out.

    ``details`` (key, place, detail) stand below modified documents and, under an empty key, below the page's text, ``previews`` (key, place, old_page, new_page,
    old_data, new_data: images as addresses, note) below them; ``records`` (kind, code, old_..., new_...) are a table.
    """
    labels = dict(dedup.LABELS)
    lines = [escape(r["line"]) for r in dedup.summary(changes).orderBy("place").collect()]
    ordered = changes.orderBy(F.col("category") != TEXT, "category", "key")
    rows = ordered.collect() if most is None else ordered.limit(most).collect()
    more = 0 if most is None else changes.count() - len(rows)
    named = [("" if r["category"] == TEXT else r["key"],) for r in rows if r["category"] in ("documents_modified", TEXT)]
    shown = changes.sparkSession.createDataFrame(named, "key string").distinct()
    said, images = {}, {}
    for table, into in ((details, said), (previews, images)):
        if table is not None:
            for r in table.join(shown, "key").orderBy("key", "place").collect():  # of the changes that are listed
                into.setdefault(r["key"], []).append(r)
    parts = []
    for category in sorted({r["category"] for r in rows}, key=list(labels).index):
        parts.append(f"<h2>{escape(labels[category])}</h2><table>")
        for r in (r for r in rows if r["category"] == category):
            name = r["new_title"] or r["old_title"] or ""
            own = said.get(r["key"], []) if category == "documents_modified" else said.get("", []) if category == TEXT else []
            pairs = images.get(r["key"], []) if category == "documents_modified" else []
            below = _list([escape(d["detail"]) for d in own]) + "".join(map(_preview, pairs))
            parts.append(f"<tr><td>{_link(r['new_url'] or r['old_url'], name)}{below}</td><td>{escape(r['key'] or '')}</td></tr>")
        parts.append("</table>")
    if records is not None:
        names = [c for c in records.columns if c not in ("kind", "code")]
        found = records.orderBy("kind", "code").collect()
        cell = lambda x: f"<td>{escape('' if x is None else str(x))}</td>"
        head = "".join(f"<th>{escape(c)}</th>" for c in ("kind", "code", *names))
        parts.append(f"<h2>Records</h2><table><tr>{head}</tr>" + "".join(f"<tr>{''.join(cell(r[c]) for c in ('kind', 'code', *names))}</tr>" for r in found) + "</table>")
    rest = f"<p>{more} additional changes omitted</p>" if more else ""
    if pages:
        every = sorted({r["category"] for r in changes.select("category").distinct().collect()}, key=list(labels).index)
        links = [f'<a href="{escape(pages)}/category={escape(c)}">{escape(labels[c])}: all</a>' for c in every]
        rest = (f"<p>{more} additional changes are on the pages below</p>" if more else "") + _list(links)
    return f"<h1>{escape(title)}</h1>{_list(lines)}{''.join(parts)}{rest}"


# What stands for an image that a side lacks.
NO_PREVIOUS, NO_CURRENT, NO_IMAGE = "No previous page (added).", "Page removed.", "Preview unavailable."


def _preview(r) -> str:
    sides = []
    for label, page, data, none in (("BEFORE", r["old_page"], r["old_data"], NO_PREVIOUS), ("AFTER", r["new_page"], r["new_data"], NO_CURRENT)):
        shown = escape(none) if page is None else f'<img src="{escape(data)}">' if data else escape(NO_IMAGE)
        sides.append(f"<td>{label}{'' if page is None else f' — PAGE {page}'}<br>{shown}</td>")
    return f"<table><tr>{''.join(sides)}</tr></table>" + (f"<p>{escape(r['note'])}</p>" if r["note"] else "")


def status_report(title: str, message: str, page_url: str = "", at: str = "") -> str:
    link = f"<p>{_link(page_url, page_url)}</p>" if page_url else ""
    return f"<h1>{escape(title)}</h1><p>{escape(message)}</p>{link}" + (f"<p>{escape(at)}</p>" if at else "")


def history_page(events: DataFrame, most: int = 100) -> str:
    """The newest events with their details; a link where an event has a report."""
    columns = {"title", "details", "report"} & set(events.columns)
    items = []
    for r in dedup.newest(events, most).collect():
        own = r.asDict()
        head = f"{escape(str(own['event_ts']))} {escape(own['kind'])} {escape(own['title'] or '') if 'title' in columns else ''}".strip()
        link = f' <a href="reports/{escape(own["report"])}">report</a>' if "report" in columns and own["report"] else ""
        items.append(head + link + _list([escape(d) for d in own["details"] or []] if "details" in columns else []))
    return _list(items) or "<ul></ul>"


def image_id(path: str, prefix: str = "preview-") -> str:
    return prefix + hashlib.sha256(path.encode()).hexdigest()[:20]


def image_source(data: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(data).decode()
