"""Rendered pages to text, links and folders: tokens in Arrow batches, then intervals over them, then relational clean-up.

A page becomes a flat list of tokens (opening tag, closing tag, text). What a
token belongs to follows from intervals between tokens, taken from running
counts over the whole list at once: the root element, silent elements, the
generated inventory region, headings and anchors. No token handler keeps state.
"""

from __future__ import annotations

from bisect import bisect_right
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

# Elements without content, elements whose text isn't shown, headings.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "svg", "noscript"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
OPEN, CLOSE, TEXT = range(3)


def _tidy(s: str) -> str:
    return " ".join(s.replace("‌", " ").split())


class _Tokens(HTMLParser):
    """(kind, tag or text, attributes) of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((OPEN, tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append((CLOSE, tag, {}))

    def handle_data(self, data):
        if tidy := _tidy(data):
            self.found.append((TEXT, tidy, {}))


def tokens(html: str) -> list[tuple[int, str, dict]]:
    reader = _Tokens()
    reader.feed(html)
    reader.close()
    return reader.found


def last_before(marks: np.ndarray) -> np.ndarray:
    """For each place the last marked one at or before it, -1 if there is none."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1)) if len(marks) else np.zeros(0, np.int64)


def depth_of(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Open elements after each token; closing tags without an opening one count nothing."""
    level = np.cumsum(opens.astype(np.int64) - closes)
    return level - np.minimum(np.minimum.accumulate(level), 0) if len(level) else level


def read_page(html: str | None, root: str = "main", folder_attribute: str = "data-folder-path", inventory_attribute: str = "data-inventory") -> tuple[str, list[tuple[str, str, str]], list[str]]:
    """Text of the root element without the inventory region, links (href, title, section), and folder paths of rows anywhere."""
    every = tokens(html or "")
    folders = list(dict.fromkeys(p for kind, tag, own in every if kind == OPEN and tag == "tr" and (p := _tidy(own.get(folder_attribute) or ""))))
    names = np.array([t for _, t, _ in every], object)
    kinds = np.array([k for k, _, _ in every], np.int8)
    # Tokens inside the root: after its last opening tag, which no closing one follows.
    edge = (names == root) & (kinds != TEXT)
    at = last_before(edge)
    inside = np.flatnonzero((at >= 0) & (kinds[at] == OPEN) & ~edge) if len(every) else np.zeros(0, np.int64)
    page, names, kinds = [every[i] for i in inside], names[inside], kinds[inside]
    opens, closes, data = (kinds == k for k in (OPEN, CLOSE, TEXT))
    one_of = lambda some: np.array([n in some for n in names], bool)
    silent = one_of(SILENT)
    heard = depth_of(opens & silent, closes & silent) == 0
    # Inventory regions: from an opening tag with the attribute to the closing tag that matches it.
    hidden, until = np.zeros(len(page), bool), 0
    for i in [k for k in np.flatnonzero(opens) if inventory_attribute in page[k][2] and names[k] not in VOID]:
        if i >= until:  # regions don't overlap, so all of them together are walked once
            level, end = 0, len(page)
            for k in range(i, len(page)):
                if names[k] == names[i]:
                    level += int(opens[k]) - int(closes[k])
                    if not level:
                        end = k
                        break
            until = end + 1
            hidden[i:end] = True
    # Headings: a closing tag ends the last heading that was opened since the closing tag before it.
    heading = one_of(HEADINGS)
    begins, ends = opens & heading & heard & ~hidden, closes & heading & heard
    section, places, sections = "", [], []
    began, ended = last_before(begins), last_before(ends)
    shown = data & heard & ~hidden
    changes = []
    for e in np.flatnonzero(ends):
        b = began[e]
        if b >= 0 and (e == 0 or b > ended[e - 1]):
            said = " ".join(names[b:e][shown[b:e]])
            changes.append((e, said))
    for e, said in changes:
        section = said or section
        places.append(e)
        sections.append(section)
    section_at = lambda k: sections[at - 1] if (at := bisect_right(places, k)) else ""
    # Anchors: a closing tag ends the last one that was opened since the closing tag before it.
    anchor = names == "a"
    begins, ends = np.array([bool(o and t[2].get("href")) for o, t in zip(opens & anchor & heard, page, strict=True)], bool), closes & anchor & heard
    began, ended = last_before(begins), last_before(ends)
    links = []
    for e in np.flatnonzero(ends):
        b = began[e]
        if b >= 0 and (e == 0 or b > ended[e - 1]):
            own = page[b][2]
            title = " ".join(names[b:e][(data & heard)[b:e]])
            links.append((own["href"], title, _tidy(own.get(folder_attribute) or "") or section_at(b)))
    return " ".join(names[shown]), links, folders


LINK = pa.struct([("pos", pa.int64()), ("href", pa.string()), ("title", pa.string()), ("section", pa.string())])


PART_BYTES, PART_ROWS = 1 << 20, 256


def parts(batch: pa.RecordBatch, column: int):
    """Consecutive slices of a batch, each of at most PART_ROWS rows and, unless it is one row, PART_BYTES in the column; an empty batch is one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and (held + size > PART_BYTES or i - begin >= PART_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)


def parse(pages: DataFrame, html: str = "html", root: str = "main") -> DataFrame:
    """The page's columns but html, with page_text, links (pos, href, title, section), folder paths, and error (null, or that the page has no text)."""
    kept = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)

    def run(batches):
        for whole in batches:
            for batch in parts(whole, len(kept)):
                made = [read_page(t, root) for t in batch.column(len(kept)).to_pylist()]
                links = [[{"pos": i, "href": h, "title": x, "section": s} for i, (h, x, s) in enumerate(found)] for _, found, _ in made]
                said = [None if words else f"no text in <{root}>" for words, _, _ in made]
                arrays = [pa.array([m[0] for m in made], pa.string()), pa.array(links, pa.list_(LINK)), pa.array([m[2] for m in made], pa.list_(pa.string())), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *arrays], names=[*kept, "page_text", "links", "folders", "error"])

    return pages.select(*kept, html).mapInArrow(run, f"{schema}, page_text string, links array<struct<pos:bigint,href:string,title:string,section:string>>, folders array<string>, error string")


def page_links(parsed: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """page, pos, url, title, section: canonical http(s) links, titles from file names where empty, first of equal triples."""
    each = parsed.select(F.col(page), F.col(url).alias("base"), F.explode("links").alias("l"))
    target = urls.canonical(F.col("base"), F.col("l.href"))
    out = each.select(page, F.col("l.pos").alias("pos"), target.alias("url"), F.col("l.title").alias("title"), F.col("l.section").alias("section")).filter(urls.scheme(F.col("url")).isin("http", "https"))
    named = out.withColumn("title", F.when(F.col("title") == "", urls.file_name(F.col("url"))).otherwise(F.col("title")))
    return named.groupBy(page, "url", "title", "section").agg(F.min("pos").alias("pos"))


def in_order(links: DataFrame) -> DataFrame:
    """Links by folded URL, then folded title, then place."""
    return links.orderBy(text.fold(F.col("url")), text.fold(F.col("title")), "pos")


def folders_in_order(paths: DataFrame) -> DataFrame:
    """Folder rows (path) by folded path."""
    return paths.orderBy(text.fold(F.col("path")), "path")
