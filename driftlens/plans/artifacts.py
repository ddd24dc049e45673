"""Queries over workbooks and pictures that Spark makes of the tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F

from ..operators import diff, records, regions, snapshot
from ..sources import workbooks
from ..sources.tables import kept
from . import fixtures as fx
from .registry import C, images, query

SHEETS = ("S0", "S1")


def workbook(rows: pd.DataFrame) -> bytes:
    """A workbook with a sheet for each name in SHEETS: shared strings in A, inline ones in B, formulas in C, numbers in D."""
    strings: dict[str, int] = {}

    def line(r) -> str:
        n, made = r["line"], []
        if isinstance(r["a"], str):
            made.append(f'<c r="A{n}" t="s"><v>{strings.setdefault(r["a"], len(strings))}</v></c>')
        made.append(f'<c r="B{n}" t="inlineStr"><is><t>{escape(r["b"])}</t></is></c><c r="C{n}"><f>LEN(A{n})</f><v>0</v></c>')
        made.append(f'<c r="D{n}"><v>{r["d"]}</v></c>' if isinstance(r["d"], str) else "")
        return f'<row r="{n}">{"".join(made)}</row>'

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<sheet name={quoteattr(s)} r:id="r{i}"/>' for i, s in enumerate(SHEETS))
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="urn:r"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/{s}.xml"/>' for i, s in enumerate(SHEETS)) + "</Relationships>")
        for s in SHEETS:
            mine = rows[rows["sheet"] == s].sort_values("line").to_dict("records")
            z.writestr(f"xl/worksheets/{s}.xml", f"<worksheet><sheetData>{''.join(map(line, mine))}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
    return held.getvalue()


def made(rows):
    """book, content of rows (book, sheet, line, a, b, d); a book has 64 lines."""
    return rows.groupBy("book").applyInPandas(lambda pdf: pd.DataFrame({"book": [pdf["book"].iloc[0]], "content": [workbook(pdf)]}), "book long, content binary")


@query("""WITH d AS (SELECT doc_id, doc_id // 64 AS book, 'S' || (doc_id % 2) AS sheet, (doc_id % 64 + 1) AS r, nullif(source, '') AS source, sha256(coalesce(text, '')) AS h, CAST(n_chars AS VARCHAR) AS n FROM documents),
c AS (SELECT doc_id, book, sheet, 'A' || r AS cell, source AS o, CASE WHEN doc_id % 7 = 0 THEN source || ' (moved)' ELSE source END AS w FROM d
  UNION ALL SELECT doc_id, book, sheet, 'B' || r, h, h FROM d UNION ALL SELECT doc_id, book, sheet, 'C' || r, '=LEN(A' || r || ')', '=LEN(A' || r || ')' FROM d
  UNION ALL SELECT doc_id, book, sheet, 'D' || r, n, n FROM d),
s AS (SELECT book, sheet, cell, CASE WHEN doc_id % 13 <> 0 THEN o END AS o, CASE WHEN doc_id % 11 <> 0 THEN w END AS w FROM c)
SELECT CASE WHEN o IS NULL THEN 'added' WHEN w IS NULL THEN 'removed' ELSE 'changed' END AS category, book, sheet, cell, o AS old_value, w AS new_value FROM s WHERE o IS DISTINCT FROM w""")
def workbook_cell_diff(spark, sf_dir):
    """Two versions of workbooks of 64 documents each, read as rows of cells; some lines are new, gone or moved."""
    d = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("doc_id div 64").alias("book"), F.concat(F.lit("S"), (C("doc_id") % 2).cast("string")).alias("sheet"), (C("doc_id") % 64 + 1).alias("line"),
        F.expr("nullif(source, '')").alias("a"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("b"), C("n_chars").cast("string").alias("d"),
    )
    moved = d.withColumn("a", F.when(C("doc_id") % 7 == 0, F.concat("a", F.lit(" (moved)"))).otherwise(C("a")))
    sides = [kept(workbooks.cells(made(rows.drop("doc_id")), ["book"]), "cells") for rows in (d.filter("doc_id % 13 <> 0"), moved.filter("doc_id % 11 <> 0"))]
    return diff.keyed(*[workbooks.sound(s, ["book"]) for s in sides], ["book", "sheet", "cell"], ["value"], ("added", "removed", "changed"))


DIFFERS = "(y * 64 + x) % 577 = 5 OR (y BETWEEN 9 AND 18 AND x BETWEEN 40 AND 44)"
REGIONS_SQL = f"""p AS (SELECT vec_id, vec_id // 64 AS image, CAST(vec_id % 64 AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x FROM embeddings),
s0 AS (SELECT DISTINCT image, x // 16 AS cx, y // 16 AS cy, x // 16 * 100 + y // 16 AS g FROM p WHERE {DIFFERS}),
""" + "".join(f"""s{i + 1} AS (SELECT a.image, a.cx, a.cy, min(z.g) AS g FROM s{i} a JOIN s{i} z ON a.image = z.image AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 GROUP BY ALL),
""" for i in range(4)) + """h AS (SELECT image, max(y) + 1 AS height FROM p GROUP BY 1),
r AS (SELECT s4.image, CAST(greatest(min(cx) * 16 - 3, 0) AS INT) AS "left", CAST(greatest(min(cy) * 16 - 3, 0) AS INT) AS top,
  CAST(least(max(cx) * 16 + 19, 64) AS INT) AS "right", CAST(least(max(cy) * 16 + 19, max(height)) AS INT) AS bottom FROM s4 JOIN h ON s4.image = h.image GROUP BY s4.image, g)"""


def _regions(spark, sf_dir):
    both = images(spark, sf_dir)
    cells = diff.pixel_cells(*[both.select("image", "y", C(side).alias("row")) for side in ("old", "new")])
    sizes = both.groupBy("image").agg(F.max(F.size("new")).alias("width"), (F.max("y") + 1).alias("height"))
    return both, regions.regions(cells, sizes, tile=2)


@query(f"WITH {REGIONS_SQL} SELECT * FROM r")
def difference_regions(spark, sf_dir):
    """Regions of whole cells, joined over the borders of tiles of two by two cells."""
    return _regions(spark, sf_dir)[1]


@query(f"""WITH {REGIONS_SQL}
SELECT image, y, string_agg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.image = p.image AND y >= top AND y < bottom AND x >= "left" AND x < "right"
    AND (y < top + 2 OR y >= bottom - 2 OR x < "left" + 2 OR x >= "right" - 2)) THEN 15084820 ELSE CAST((vec_id * 7 + x * 3) % 256 AS INT) END, ',' ORDER BY x) AS pixels FROM p GROUP BY image, y""")
def outlined_images(spark, sf_dir):
    """The old pictures with outlines around what differs in the new ones."""
    both, found = _regions(spark, sf_dir)
    rows = regions.outlined(both.select("image", "y", C("old").alias("row")), found)
    return rows.select("image", "y", F.array_join(C("row").cast("array<string>"), ",").alias("pixels"))


SIDE = """SELECT * FROM (SELECT p_partkey AS pos, p_partkey % 5 AS file, p_brand || '-' || p_size AS code, p_name AS description, {unit} AS unit, p_type AS category FROM part WHERE p_partkey % 13 <> {gone})
  QUALIFY row_number() OVER (PARTITION BY file, code ORDER BY length(code) + length(description) + length(unit) + length(category) DESC, pos) = 1"""


@query(f"""WITH o AS ({SIDE.format(unit="'EA'", gone=5)}), n AS ({SIDE.format(unit="CASE WHEN p_partkey % 13 = 6 THEN 'LF' ELSE 'EA' END", gone=4)}),
c AS (SELECT CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' ELSE 'updated' END AS kind, coalesce(o.file, n.file) AS file, coalesce(o.code, n.code) AS code,
  o.description AS old_description, n.description AS new_description, o.unit AS old_unit, n.unit AS new_unit FROM o FULL OUTER JOIN n ON o.file = n.file AND o.code = n.code
  WHERE o.code IS NULL OR n.code IS NULL OR (o.description, o.unit, o.category) IS DISTINCT FROM (n.description, n.unit, n.category))
SELECT kind, file, code, old_description, new_description, old_unit, new_unit FROM c QUALIFY row_number() OVER (PARTITION BY kind, code ORDER BY file DESC) = 1""")
def record_files_consolidated(spark, sf_dir):
    """Records of five files, compared file by file; of what several files tell of a code, the last file's row stays."""
    sides = [records.items(fx.record_lines(spark, sf_dir, s).withColumn("file", C("pos") % 5), ["file"]) for s in ("old", "new")]
    found = records.consolidated(records.changes(*sides, ["file"]), "file")
    return found.select("kind", "file", "code", "old_description", "new_description", "old_unit", "new_unit")


PLACED = """CASE doc_id % 4 WHEN 0 THEN 'https://DOCS.example.test/Documents/top ' || source || '//b%20' || doc_id % 7 || '/f%2Fg' || doc_id || '.pdf?x=/y/z'
  WHEN 1 THEN 'https://other.example.test/documents/a/b/c.pdf' WHEN 2 THEN 'https://docs.example.test/documents/f.pdf' ELSE 'https://docs.example.test/files/a/b/f.pdf' END"""


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS source FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'top ' || source || ' / b ' || (doc_id % 7) || ' / f' ELSE 'x / y' END AS section FROM d""")
def sections_by_url(spark, sf_dir):
    """Sections from the folders in URL paths; quoted slashes part folders, other hosts and roots keep what was given."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return snapshot.placed(d.select("doc_id", F.expr(PLACED).alias("url"), F.lit("x / y").alias("section")), ["docs.example.test"]).select("doc_id", "section")
