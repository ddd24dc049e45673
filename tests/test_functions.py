import difflib
import io
import random
import unicodedata
import zipfile
from urllib.parse import quote, urlsplit, urlunsplit, urljoin

import pytest
from pyspark.sql import functions as F

from driftlens.config import Config, Route
from driftlens.functions import predicates, text, urls
from driftlens.operators import sequence
from driftlens.plans import registry
from driftlens.sources import files, html
from driftlens.sources.html import read_page

ODD = ["a b‌c", "  x\x1cy\x1f z\n", "", " ", "ßΣ ὈΔΥΣΣΕΎΣ", "a\r\nb\x0bc\x85d e\n\n", "﻿x"]


def one(spark, values, expr):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, s string").orderBy("i").select(expr(F.col("s"))).collect()]


def test_normalize_like_python(spark):
    want = [" ".join(s.replace("‌", " ").replace(" ", " ").split()) for s in ODD]
    assert one(spark, ODD, text.normalize) == want
    assert one(spark, ODD, text.lines) == [[x for p in s.splitlines() if (x := " ".join(p.replace("‌", " ").split()))] for s in ODD]
    assert one(spark, ["Straße", "ΣΑΣ"], text.fold) == ["strasse", "σασ"]


def test_records(spark):
    got = one(spark, ["1|A-1| long |EA|x||y", "x|A|b|c|d", "1||b|c|d", "2|B|d|e"], text.record)
    assert got[0].asDict() == {"code": "A-1", "description": "long", "unit": "EA", "category": "x | y"}
    assert got[1:] == [None, None, None]


def python_canonical(base, link):
    p = urlsplit(urljoin(base, link.strip()))
    net = (p.hostname or "") + (f":{p.port}" if p.port else "")
    return urlunsplit((p.scheme.lower(), net, quote(p.path, safe="/%:@!$&'()*+,;=-._~"), quote(p.query, safe="=&?/:;+,%@!$'()*-._~"), ""))


def test_canonical_literals(spark):
    want = {"?q=(1)!": "https://ex.test/a/b/c.html?q=(1)!", "/m/../n.pdf": "https://ex.test/n.pdf", "x'(y)*.pdf?$a": "https://ex.test/a/b/x'(y)*.pdf?$a", "http://[::1]:80/p": "http://::1:80/p", "HTTPS://EX.test:443/A b#c": "https://ex.test:443/A%20b"}
    assert one(spark, list(want), lambda c: urls.canonical(F.lit("https://Ex.test/a/b/c.html?q=1"), c)) == list(want.values())


def test_unquote_and_fold_like_python(spark):
    from urllib.parse import unquote

    odd = ["a%20b%zz%41", "%", "%4", "+%2B%c3%a9", "100% %41", "%2525", ""]
    assert one(spark, odd, urls.unquote) == [unquote(x) for x in odd]
    known = lambda a, b: [chr(c) for c in range(a, b) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]  # noqa: E731  # Java may know more
    every = ["".join(known(a, a + 256)) for a in range(0, 0x11000, 256)] + ["µŉǰͅẖﬁ", "Straße ΑΣ"]
    assert one(spark, every, text.fold) == [x.casefold() for x in every]
    each = known(0, 0x1F000)  # one by one: lower case is another way for most
    assert [x for x, y in zip(each, one(spark, each, text.fold), strict=True) if y != x.casefold()] == []


@pytest.mark.parametrize("base", ["https://Ex.test/a/b/c.html?q=1", "http://ex.test", "https://ex.test/d/"])
def test_canonical_like_python(spark, base):
    links = ["HTTP://U:p@Host.TEST:0443/A b/é?x=ü y#f", "//other.test/x", "/root/ü.pdf", "x/y.pdf", "../up.pdf", "../../../x", "./here", "?q=2", "#frag", "https://h.test/a/../b", "mailto:x@y.z", "/m/../n.pdf", "/a//b/./../c/", "?q=(1)!$'*", "x//y/../z", "https:z/../w", "..", ".", "/..", "a/b/c/d/e/f/g/h/i/j/../../../../../../../../../../k", "http://[::1]:80/p", "", "é x"]
    got = one(spark, links, lambda c: urls.canonical(F.lit(base), c))
    assert got == [python_canonical(base, x) for x in links]


def test_suffixes(spark):
    got = one(spark, ["https://h/a.PDF", "https://h/.hidden", "https://h/a%2Eb/c.tar.gz/", "https://h/x", "https://h/100%zz.txt"], urls.suffix)
    assert got == [".pdf", "", ".gz", "", ".txt"]
    df = spark.createDataFrame([("https://h/x", "text/CSV", ""), ("https://h/x.bin", "", 'attachment; filename="r%20s.XLSX"'), ("https://h/x.pdf", "text/csv", ""), ("https://h/x.bin", None, None)], "u string, t string, d string")
    assert [r[0] for r in df.select(urls.infer_suffix(F.col("u"), F.col("t"), F.col("d"))).collect()] == [".csv", ".xlsx", ".pdf", ".bin"]


def test_filters(spark):
    df = spark.createDataFrame([("Maps / Old", "Plan A", "https://h/p.pdf"), ("Maps", "Plan B", "https://h/p.docx"), (None, None, None)], "s string, t string, u string")
    f = lambda **k: [r[0] for r in df.select(predicates.matches_fixed(F.col("s"), F.col("t"), F.col("u"), predicates.Filters(**k))).collect()]
    assert f() == [True] * 3
    assert f(sections=("OLD",)) == [True, False, False]
    assert f(extensions=("PDF", "docx")) == [True, True, False]
    assert f(sections=("maps",), titles=("b",)) == [False, True, False]


def test_read_page():
    words, links, folders = read_page('<tr data-folder-path="A / B"><main><h2>Sec &amp; T</h2><script>no<a href="x">y</a></script><a href="/d.pdf">D <b>oc</b></a><a href="q">open<h3>Next</h3><a href="/e">E</a><div data-inventory><br><a href="/f">F</a>hidden</div>tail</main><a href="out">o</a>')
    assert folders == ["A / B"]
    assert links == [("/d.pdf", "D oc", "Sec & T"), ("/e", "E", "Next"), ("/f", "F", "Next")]
    assert "hidden" not in words and words.endswith("tail")
    assert read_page(None) == read_page("") == read_page("<body>x<main></main>") == ("", [], [])
    made = read_page("<main><h2>Manuals</h2><p>  Useful   text </p><a href='/documents/Test%20Manual.pdf'>Test Manual</a><table data-inventory='true'><tr data-folder-path='R / S'><td><a data-folder-path='R / S' href='/h.pdf'>Grid</a></table></main>")
    assert made == ("Manuals Useful text Test Manual", [("/documents/Test%20Manual.pdf", "Test Manual", "Manuals"), ("/h.pdf", "Grid", "R / S")], ["R / S"])


def test_pages_without_text_are_errors(spark):
    pages = spark.createDataFrame([(1, "<body>Loading"), (2, "<main>x")], "page_id int, html string")
    assert [r["error"] for r in html.parse(pages).orderBy("page_id").collect()] == ["no text in <main>", None]


def details(spark, pairs, expr, kind="array<string>"):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    return [r["d"] for r in df.select("i", expr(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]


def test_sequence_descriptions(spark):
    a, b = ["one", "two", "three", "four"], ["one", "2", "three", "four", "five"]
    long_ = ["x" * 400, "y" * 400]
    got = details(spark, [(a, b), (a, a[:1]), ([], []), (None, None), ([str(i) for i in range(60)], [str(i // 2 * 10**6 + i) for i in range(60)]), ([], long_), ([str(i) for i in range(0, 90, 2)], [str(i) for i in range(90) if i % 4 or i % 2])], lambda x, y: sequence.sequence_details(x, y, "line"))
    assert got[0] == ["Line(s) 2 changed — Removed: two Added: 2", "Line(s) 5 added — Added: five"]
    assert got[1] == ["Old line(s) 2–4 removed — Removed: two | three | four"]
    assert got[2] == got[3] == []
    assert got[5] == ["Line(s) 1–2 added — " + f"Added: {' | '.join(long_)}"[:700] + "…"]
    assert len(got[6]) == 21 and got[6][20].endswith("additional change group(s) omitted")
    said = details(spark, [("a b c", "a x c d"), (None, "p"), ("p q", "")], sequence.word_details, "string")
    assert said == [["Changed: b → x", "Added: d"], ["Added: p"], ["Removed: p q"]]


def test_page_descriptions(spark):
    page = "array<struct<page:int,text:string,text_sha256:string,visual_sha256:string>>"
    old = [(1, "x", "s1", None), (2, "WORKING NUMBER\n AB-1\nq", "s2", "")]
    new = [(1, "x", "s1", None), (2, "WORKING NUMBER\n AB-1\nr", "s3", ""), (3, "", "s4", None)]
    seen = lambda *pairs: [(n, t, "t", v) for n, t, v in pairs]
    text_a, text_b = "Unchanged heading\nThe required width is six inches.\nUnchanged footer", "Unchanged heading\nThe required width is eight inches.\nUnchanged footer"
    got = details(spark, [
        (old, new), (old, old), (seen((1, "", "cover"), (2, "", "drawing")), seen((1, "", "cover"), (2, "", "inserted"), (3, "", "drawing"))),
        (seen((1, text_a, "a")), seen((4, text_b, "b"))), (seen((1, text_a, "a")), seen((1, text_a, "b"))), (seen(*[(n, "", f"o{n}") for n in range(1, 26)]), seen(*[(n, "", f"n{n}") for n in range(1, 26)])), (None, None),
        (seen((1, " ".join(f"w{i} k{i} l{i} m{i} n{i} o{i} p{i} q{i}" for i in range(6)), "a")), seen((1, " ".join(f"z{i} k{i} l{i} m{i} n{i} o{i} p{i} q{i}" for i in range(6)), "b"))),
    ], sequence.page_details, page)
    assert got[0] == ['Page 2 changed (sheet AB-1) — Text excerpts: "WORKING NUMBER AB-1 q" → "WORKING NUMBER AB-1 r"'.replace("WORKING NUMBER", "WORKING NUMBER"), "New page 3 added"]
    assert got[1] == got[6] == ["File packaging or metadata changed; no rendered page difference was found"]
    assert got[2] == ["New page 2 added"]
    assert got[3] == ['Old page 1 / new page 4 changed — Text excerpts: "required width is six inches. Unchanged footer" → "required width is eight inches. Unchanged footer"']
    assert got[4] == ["Page 1 changed — Visual change; extracted text unchanged."]
    assert len(got[5]) == 25 and got[5][24] == "Page 25 changed — Visual change; no extractable text."
    assert got[7][0].endswith("; 3 more text edit(s)") and got[7][0].count(" → ") == 3


def test_edits_turn_old_into_new():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        out, at, found = [], 0, sequence.ranges(x, y)
        for e in found:
            assert not set(x[e["i1"] : e["i2"]]) & set(y[e["j1"] : e["j2"]])  # an edit has no item on both sides
            out += x[at : e["i1"]] + y[e["j1"] : e["j2"]]
            at = e["i2"]
        assert out + x[at:] == y
        assert [tuple(e.values()) for e in found] == [o for o in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if o[0] != "equal"]


def docx(paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t> hello\n</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><c r="A1" t="s"><v>0</v></c><c r="A2"><f>A1+1</f><v>3</v></c><c r="A3" t="inlineStr"><is><t>i  n</t></is></c><c r="A4"/><c r="A5" t="s"><v>9</v></c></worksheet>')
    return out.getvalue()


def test_files(spark):
    assert files.text_lines("a b\n\n c ".encode()) == ["a b", "c"]
    assert files.text_lines("é".encode("cp1252")) == ["é"]
    assert files.text_lines("x\ny".encode("utf-16")) == ["x", "y"]
    rows = [("d", ".docx", docx(["one", " ", "two  x"])), ("x", ".xlsx", xlsx()), ("t", ".txt", b"q\n"), ("z", ".zip", b""), ("b", ".docx", b"broken"), ("n", None, None)]
    got = {r["name"]: r for r in files.analyses(spark.createDataFrame(rows, "name string, suffix string, content binary")).collect()}
    assert [u["text"] for u in got["d"]["units"]] == ["one", "two x"]
    assert [(u["cell"], u["text"]) for u in got["x"]["units"]] == [("A1", "hello"), ("A2", "=A1+1"), ("A3", "i n"), ("A5", "9")]
    large = files.analyses(spark.createDataFrame([("l", ".txt", None, "larger than 5 bytes: 9")], "name string, suffix string, content binary, reason string")).first()
    assert (large["kind"], large["reason"]) == ("unsupported", "larger than 5 bytes: 9")
    assert got["t"]["kind"] == "lines" and got["z"]["kind"] == got["b"]["kind"] == got["n"]["kind"] == "unsupported"


def test_large_files_keep_their_rows(spark, tmp_path):
    for name, data in (("a.txt", b"abc"), ("b.txt", b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.files(spark, f"file://{tmp_path}", "*.txt", 10).collect()}
    assert got["a.txt"]["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got["a.txt"]["size"] == 3
    assert got["b.txt"]["content"] is None and got["b.txt"]["reason"] == "larger than 10 bytes: 100" and got["b.txt"]["size"] == 100


def test_config_operations(spark, tmp_path):
    c = Config("https://x.test")
    c.set_filter("sections", ["Maps"])
    c.set_failure_recipient("o@x.test")
    c.set_number("heartbeat_days", 3)
    c.extra_documents = [{"url": "https://x.test/a.pdf", "title": "A"}]
    c.save(spark, f"file://{tmp_path}/config.json")
    assert Config.load(spark, f"file://{tmp_path}/config.json") == c and c.filters().sections == ("Maps",)
    c.clear_filters()
    assert c.filters() == predicates.Filters()
    for wrong in (lambda: c.set_number("history_limit", -1), lambda: c.set_filter("colour", []), lambda: c.set_failure_recipient("x"), lambda: Config.of({"page_url": "https://x", "recipients": "a@b.c"}), lambda: Config.of({"page_url": "https://x", "extra_documents": [{"url": "u"}]}), lambda: Config.of({"page_url": "https://x", "dynamic_documents": [{"title": "t"}]})):
        with pytest.raises(ValueError):
            wrong()
    assert c.history_limit == 100


def test_config():
    c = Config.of({"page_url": "https://x.test", "recipients": ["a@b.c"], "unknown": 1})
    c.add_recipient("A@B.C")
    c.set_route(Route("R", ["d@e.f"]))
    c.set_route(Route("r", ["g@h.i"]))
    assert c.recipients == ["a@b.c"] and len(c.routes) == 1 and c.history_limit == 100
    with pytest.raises(ValueError):
        c.add_recipient("nobody")
    with pytest.raises(ValueError):
        Config.of({"page_url": "ftp://x"})


def test_percent_encoding_of_whole_texts(spark, tmp_path):
    texts = ["a" * 200 + " é😀%&/+~*", "x y" * 20_000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["quoted"], r["again"]) for r in registry.queries()["percent_encoding"](spark, str(tmp_path)).collect()}
    assert got == {i: (t if t is None else quote(t, safe=""), t) for i, t in enumerate(texts)}


def test_closing_tags_in_silent_elements_and_many_headings():
    import time

    from driftlens.sources.html import read_page

    assert read_page("<main><a href=x>one<svg></a></svg>two</a></main>")[1] == [("x", "one two", "")]
    assert read_page("<main><h2>A<script></h2></script>B</h2><a href=y>l</a></main>")[1] == [("y", "l", "A B")]
    many = "".join(f"<h2>H{i}</h2><div data-inventory><div>no</div></div><a href=u{i}>l{i}</a>" for i in range(20_000))
    began = time.monotonic()
    text_, links, _ = read_page(f"<main>{many}</main>")
    assert time.monotonic() - began < 10 and len(links) == 20_000 and links[-1] == ("u19999", "l19999", "H19999") and "no" not in text_.split()


def test_pages_are_parsed_in_bounded_parts():
    import pyarrow as pa

    from driftlens.sources import html

    pages = [None, "", *["x" * 300_000] * 7, "y" * 3_000_000, *["z"] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages, pa.string())], names=["page_id", "html"])
    made = list(html.parts(batch, 1))
    assert [k for p in made for k in p.column(0).to_pylist()] == list(range(len(pages)))
    assert all(len(p) <= html.PART_ROWS and (len(p) == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= html.PART_BYTES) for p in made)
    assert [len(p) for p in html.parts(batch.slice(0, 0), 1)] == [0]
