"""Document files: digests and units (paragraphs, lines, cells, pages) from binary content."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .workbooks import stream, tidy

# Content types of pages.
PAGE_TYPES = ("text/html", "application/xhtml+xml")
UNIT = pa.list_(pa.struct([("pos", pa.int32()), ("sheet", pa.string()), ("cell", pa.string()), ("text", pa.string())]))


def files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 1 << 30) -> DataFrame:
    """path, content, size, sha256, reason of files. A cell holds a file, so larger ones have no content and no digest, but a reason."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    none = F.lit(None).cast("string")
    read = raw.filter(F.col("length") <= most_bytes).select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), none.alias("reason"))
    said = F.concat(F.lit("larger than "), F.lit(most_bytes).cast("string"), F.lit(" bytes: "), F.col("length").cast("string"))
    large = raw.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"), none.alias("sha256"), said.alias("reason"))
    return read.unionByName(large)


def text_lines(data: bytes) -> list[str]:
    """UTF-8 (with or without mark), UTF-16 with a mark, else Windows-1252, else UTF-8 with replacements."""
    for name in ("utf-8-sig", *(["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "cp1252"):
        try:
            text = data.decode(name)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("utf-8", "replace")
    return [x for line in text.splitlines() if (x := tidy(line))]


def _named(tree, name: str):
    return (e for e in tree.iter() if e.tag.rpartition("}")[2] == name)


def word_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return [x for p in _named(tree, "p") if (x := tidy("".join(t.text or "" for t in _named(p, "t"))))]


def workbook_cells(data: bytes) -> list[tuple[str, str, str]]:
    """(sheet, cell, value) of a workbook that fits a value; ``workbooks.cells`` makes rows of one that doesn't."""
    return list(stream(data))


def pdf_pages(data: bytes) -> list[str]:
    """Page texts by an optional library; without it a PDF counts as unsupported."""
    import fitz  # optional

    with fitz.open(stream=data, filetype="pdf") as doc:
        return ["\n".join(x for line in page.get_text().splitlines() if (x := tidy(line))) for page in doc]


def analyse(data: bytes, suffix: str) -> tuple[str, list[dict], str | None]:
    """kind, units and the reason why a file has none."""
    try:
        if suffix in (".txt", ".csv"):
            return "lines", [{"pos": i, "text": x} for i, x in enumerate(text_lines(data))], None
        if suffix in (".docx", ".docm"):
            return "paragraphs", [{"pos": i, "text": x} for i, x in enumerate(word_paragraphs(data))], None
        if suffix in (".xlsx", ".xlsm"):
            return "excel_cells", [{"pos": i, "sheet": s, "cell": c, "text": v} for i, (s, c, v) in enumerate(workbook_cells(data))], None
        if suffix == ".pdf":
            return "pdf_pages", [{"pos": i, "text": x} for i, x in enumerate(pdf_pages(data))], None
    except Exception as e:  # a broken file is a row with a reason, not the end of the job
        return "unsupported", [], f"{type(e).__name__}: {e}"[:300]
    return "unsupported", [], "Detailed comparison isn't available for this file type"


def analyses(rows: DataFrame) -> DataFrame:
    """Adds kind, units, reason to rows (with content and suffix); content is dropped. A reason that a row has already (a file too large to read) stays."""
    kept = [c for c in rows.columns if c not in ("content", "reason")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    if "reason" not in rows.columns:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))

    def run(batches):
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("content", "suffix", "reason")), strict=True)
            done = [("unsupported", [], why) if why else analyse(c or b"", s or "") for c, s, why in given]
            arrays = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], UNIT), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, "kind", "units", "reason"])

    return rows.select(*kept, "content", "reason").mapInArrow(run, f"{schema}, kind string, units array<struct<pos:int,sheet:string,cell:string,text:string>>, reason string")


def refused(rows: DataFrame) -> DataFrame:
    """Rows (url, content_type) whose URL names a document but that came as a page, with ``error``; take the others with ``left_anti``."""
    own = urls.suffix(F.col("url"))
    page = F.lower(F.coalesce("content_type", F.lit(""))).isin(*PAGE_TYPES)
    said = F.concat(F.lit("expected a "), own, F.lit(" file, got "), F.col("content_type"))
    return rows.filter(own.isin(*urls.DOCUMENT_SUFFIXES) & page).withColumn("error", said)
