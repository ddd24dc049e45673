"""Cells of workbooks as rows, in bounded batches: no workbook is a list of cells or an array value.

Parts of a workbook are read as a stream of XML events, and each sheet row is
let go once its cells are out. The table of shared strings, which any cell may
name, is one buffer of UTF-8 with offsets. A workbook is compressed as a whole,
so one task reads it.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 8192
CELLS = pa.schema([("pos", pa.int64()), ("sheet", pa.string()), ("cell", pa.string()), ("value", pa.string()), ("reason", pa.string())])


def tidy(s: str) -> str:
    return " ".join(s.replace("\u200c", " ").split())


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _name(t) == "t")


class Strings:
    """Texts by number, in one buffer."""

    def __init__(self) -> None:
        self.data, self.ends = bytearray(), array("Q", [0])

    def add(self, s: str) -> None:
        self.data += s.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.data))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> str:
        return self.data[self.ends[k] : self.ends[k + 1]].decode("utf-8", "surrogatepass")


def _shared(z: zipfile.ZipFile, names: set[str]) -> Strings:
    out = Strings()
    if "xl/sharedStrings.xml" in names:
        with z.open("xl/sharedStrings.xml") as part:
            root = None
            for event, e in ElementTree.iterparse(part, ("start", "end")):
                root = e if root is None else root
                if event == "end" and _name(e) == "si":
                    out.add(tidy(_text(e)))
                    root.clear()
    return out


def _said(c, shared: Strings) -> str:
    """A formula as ``=f``, else the inline text, else the shared one, else the raw value."""
    one: dict = {}
    for e in c.iter():
        one.setdefault(_name(e), e)
    raw = (one["v"].text or "") if "v" in one else ""
    if "f" in one and one["f"].text:
        return f"={one['f'].text}"
    if "is" in one:
        return _text(one["is"])
    if c.get("t") == "s" and re.fullmatch(r"[0-9]+", raw) and int(raw) < len(shared):
        return shared[int(raw)]
    return raw


def stream(data) -> Iterator[tuple[str, str, str]]:
    """(sheet, cell, value) in the order of sheets and rows; empty cells are left out. ``data`` is a file or bytes."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        names = set(z.namelist())
        shared = _shared(z, names)
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target", "") for r in links.iter() if _name(r) == "Relationship"}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _name(sheet) != "sheet":
                continue
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id"), None), "")
            where = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if where not in names:
                continue
            with z.open(where) as part:
                held = None
                for event, e in ElementTree.iterparse(part, ("start", "end")):
                    name = _name(e)
                    if event == "start":
                        held = e if name == "sheetData" else held
                    elif name == "c":
                        if said := tidy(_said(e, shared)):
                            yield sheet.get("name", ""), e.get("r", ""), said
                    elif name == "row" and held is not None:
                        held.clear()


def cells(rows: DataFrame, keys: list[str], batch: int = BATCH) -> DataFrame:
    """keys, pos, sheet, cell, value, reason: a row a cell of each workbook in ``content``.

    A broken workbook, or one without content, ends with a row that has a
    reason and no cell; cells before the fault are there, see ``sound``. An
    empty workbook has no row. Repeated rows repeat their cells. The keys
    mustn't have one of the names above; other columns are ignored.
    """
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def told(data) -> Iterator[tuple]:
        n = 0
        try:
            if data is None:
                raise ValueError("no content")
            for sheet, cell, value in stream(data):
                yield n, sheet, cell, value, None
                n += 1
        except Exception as e:  # a broken file is a row with a reason, not the end of the job
            yield n, None, None, None, f"{type(e).__name__}: {e}"[:300]

    def run(batches):
        for given in batches:
            owners = given.select(keys)
            for k in range(given.num_rows):
                held: list[tuple] = []

                def out(held, k=k, owners=owners):
                    own = owners.take(pa.array([k] * len(held), pa.int64()))
                    made = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), CELLS.types, strict=True)]
                    return pa.RecordBatch.from_arrays([*own.columns, *made], names=[*keys, *CELLS.names])

                for one in told(given.column("content")[k].as_py()):
                    held.append(one)
                    if len(held) == batch:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    return rows.select(*keys, "content").mapInArrow(run, f"{schema}, pos long, sheet string, cell string, value string, reason string")


def sound(found: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of workbooks that were read to the end. Write ``found`` first: it is read twice."""
    bad = found.filter("reason IS NOT NULL").select(*(F.col(k).alias(f"bad_{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"bad_{i}")) for i, k in enumerate(keys)]
    return found.join(bad, same, "left_anti").drop("reason")
