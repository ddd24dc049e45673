"""Workbooks as rows and regions over tiles, against plain code."""

import io
import random
import tracemalloc
import zipfile

from pyspark.sql import functions as F


def flood(cells):
    """Extents of 8-neighbour components by flooding."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        seen = list(todo)
        while todo:
            x, y = todo.pop()
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
            seen += near
        xs, ys = zip(*seen, strict=True)
        out.append((min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


def test_components_over_tiles(spark):
    from driftlens.operators import regions

    rng = random.Random(5)
    spread = {(rng.randrange(60), rng.randrange(45)) for _ in range(700)}
    snake = {(x, y) for y in range(0, 40, 2) for x in range(40)} | {(39 if y % 4 == 1 else 0, y) for y in range(1, 39, 2)}  # one component through all tiles
    ring = {(x, y) for x in range(33) for y in range(33) if x in (0, 32) or y in (0, 32)} | {(16, 16)}
    images = {"spread": spread, "snake": snake, "ring": ring, "dot": {(7, 8)}, None: {(0, 0), (1, 1), (3, 3)}}
    rows = [(k, x, y, 1) for k, cells in images.items() for x, y in cells] + [("dot", 7, 8, 2), ("dot", None, 3, 1)]
    cells = spark.createDataFrame(rows, "image string, cx int, cy int, comp int")
    for tile in (1, 4, 256):
        got = {}
        for r in regions.components(cells, tile).collect():
            got.setdefault(r["image"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: flood(c) for k, c in images.items()}
    assert regions.components(cells.limit(0), 4).count() == 0


def test_outlines(spark):
    from driftlens.operators import diff, regions

    blank = [[0] * 60 for _ in range(40)]
    hit = [list(r) for r in blank]
    hit[20][20] = 9
    frame = lambda p: spark.createDataFrame([(1, y, r, "x") for y, r in enumerate(p)] + [(2, 0, None, "y")], "image int, y int, row array<int>, bottom string")
    sizes = spark.createDataFrame([(1, 60, 40)], "image int, width int, height int")
    found = regions.regions(diff.pixel_cells(frame(blank), frame(hit)), sizes)
    assert [tuple(r) for r in found.collect()] == [(1, 13, 13, 35, 35)]
    got = {(r["image"], r["y"]): (r["row"], r["bottom"]) for r in regions.outlined(frame(hit), found).collect()}
    red = (230 << 16) + (45 << 8) + 20
    box = lambda x, y: 13 <= x < 35 and 13 <= y < 35 and not (15 <= x < 33 and 15 <= y < 33)
    assert all(got[1, y] == ([red if box(x, y) else v for x, v in enumerate(r)], "x") for y, r in enumerate(hit))
    assert got[2, 0] == (None, "y")
    assert regions.outlined(frame(hit), found.limit(0)).count() == 41


def book(lines, n_strings=0):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="a"/><sheet name="gone" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/s.xml"/><Relationship Id="b" Target="no.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>text</t></r><r><t> {k}</t></r></si>" for k in range(n_strings)) + "</sst>")
        with z.open("xl/s.xml", "w") as part:
            part.write(b'<worksheet xmlns="urn:m"><sheetData>')
            for line in lines:
                part.write(line.encode())
            part.write(b"</sheetData></worksheet>")
    return held.getvalue()


def test_cells_of_all_kinds_and_broken_books(spark):
    from driftlens.sources import workbooks

    row = '<row><c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>9</v></c><c r="C1"><f>A1</f><v>3</v></c><c r="D1"><f/><v>4</v></c><c r="E1" t="inlineStr"><is><t> a </t><t>b</t></is></c><c r="F1"/></row>'
    whole = book([row] * 2, 2)
    cut = book([row, "<row><c"], 2)
    rows = [("a", whole, 1), ("a", whole, 2), ("b", cut, 1), ("c", b"no zip", 1), ("d", None, 1), ("e", book([]), 1), (None, whole, 1)]
    found = workbooks.cells(spark.createDataFrame(rows, "key string, content binary, value int"), ["key"], batch=3)
    want = [("S", "A1", "text 1"), ("S", "B1", "9"), ("S", "C1", "=A1"), ("S", "D1", "4"), ("S", "E1", "a b")]
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], []).append(r)
    cells = lambda k: [(r["sheet"], r["cell"], r["value"]) for r in got[k] if r["cell"]]
    assert cells("a") == want * 4 and cells(None) == want * 2 and cells("b") == want and "e" not in got
    assert [r["pos"] for r in got[None]] == list(range(10))
    assert {k: sum(r["reason"] is not None for r in v) for k, v in got.items()} == {"a": 0, None: 0, "b": 1, "c": 1, "d": 1}
    kept = workbooks.sound(found, ["key"])
    assert {r["key"]: r["n"] for r in kept.groupBy("key").agg(F.count("*").alias("n")).collect()} == {"a": 20, None: 10}


def test_memory_is_a_rows_not_a_workbooks():
    from driftlens.sources import workbooks

    data = book((f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="s"><v>{r % 100}</v></c>' for c in "ABCDEFGHIJ") + "</row>" for r in range(30_000)), 100)
    tracemalloc.start()
    n = sum(1 for _ in workbooks.stream(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and peak < 8 << 20


def test_records_over_files(spark):
    from driftlens.operators import records

    unit = "struct<pos:int,sheet:string,cell:string,text:string>"
    units = lambda *lines: [(k, None, None, x) for k, x in enumerate(lines)]
    frame = lambda rows: records.of_analyses(spark.createDataFrame(rows, f"file int, units array<{unit}>"), ["file"])
    old = frame([(1, units("1|A|first|EA|x", "2|B|b|EA|x", "no record", None)), (2, units("1|A|second|EA|x", "2|C|c|EA|x")), (3, None)])
    new = frame([(1, units("1|A|other|EA|x", "2|B|b|EA|x")), (2, units("1|A|another|EA|x", "7|A|an|EA|x", "2|D|d|EA|x")), (None, units("1|D|d d|EA|x"))])
    found = records.changes(old, new, ["file"])
    assert found.count() == 5
    got = sorted((r["kind"], r["code"], r["file"], r["old_description"], r["new_description"]) for r in records.consolidated(found.filter("file IS NOT NULL"), "file").collect())
    assert got == [("added", "D", 2, None, "d"), ("removed", "C", 2, "c", None), ("updated", "A", 2, "second", "another")]


def test_folders_from_urls_and_order(spark):
    from driftlens.operators import snapshot

    rows = [("https://h/Documents/a/b%20c/f.pdf", "s", 1), ("https://h/documents/f.pdf", "s", 2), ("https://H/documents/Z/f.pdf", None, 3), ("https://i/documents/a/f.pdf", "s", 4), (None, "s", 5), ("https://h/documents/a/b c/F.pdf", "s", 0)]
    d = spark.createDataFrame(rows, "url string, section string, pos int")
    got = snapshot.placed(d, ["h"])
    assert {r["pos"]: r["section"] for r in got.collect()} == {1: "a / b c", 2: "s", 3: "Z", 4: "s", 5: "s", 0: "a / b c"}
    folders = spark.createDataFrame([("a",), ("a / b",), ("a /   / c",), ("a / ",), ("a /  / c",), ("b / a",), (None,), ("",)], "path string")
    assert [r[0] for r in snapshot.valid_folders(folders, ["a"]).collect()] == ["a", "a / b"]
    assert [r["pos"] for r in snapshot.by_url(d).collect()] == [5, 0, 1, 2, 3, 4]
