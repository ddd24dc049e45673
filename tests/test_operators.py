import pytest
from pyspark.sql import functions as F

from driftlens.operators import dedup, diff, routing, sequence, snapshot
from driftlens.plans import report
from driftlens.sources.state import Lock, Store, read_json, write_json
from driftlens.streaming.monitor import Monitor, retry

DOC = "key string, url string, title string, section string, sha256 string, pos int"


def docs(spark, *rows):
    return spark.createDataFrame([(k, u or k, t, "S", h, i) for i, (k, u, t, h) in enumerate(rows)], DOC)


def kinds(df):
    return sorted((r["category"], r["old_key"], r["key"]) for r in df.collect())


def test_categories_are_not_exclusive(spark):
    old = docs(spark, ("a", None, "A", "1"), ("b", "u1", "B", "2"), ("c", None, "C", "3"), ("gone", None, "G", "9"))
    new = docs(spark, ("a", None, "A2", "1x"), ("b", "u2", "B", "2"), ("d", None, "C", "3"), ("come", None, "N", "8"))
    want = [("documents_added", None, "come"), ("documents_modified", "a", "a"), ("documents_moved", "c", "d"), ("documents_relinked", "b", "b"), ("documents_removed", "gone", "gone"), ("documents_renamed", "a", "a")]
    assert kinds(diff.documents(old, new)) == want
    assert diff.documents(old, old).count() == 0
    back = kinds(diff.documents(new, old))
    assert ("documents_added", None, "gone") in back and ("documents_removed", "come", "come") in back


def test_moves_of_equal_and_missing_digests(spark):
    old = docs(spark, *[(f"o{i}", None, "t", "same") for i in range(7)], ("on", None, "t", None))
    new = docs(spark, *[(f"n{i}", None, "t", "same") for i in range(5)], ("nn", None, "t", None))
    got = [k for k, _, _ in kinds(diff.documents(old, new))]
    assert got.count("documents_moved") == 6 and got.count("documents_removed") == 2
    assert kinds(diff.documents(old.repartition(5), new.repartition(3))) == kinds(diff.documents(old, new))


def test_last_row_of_a_key_counts(spark):
    old = docs(spark, ("a", None, "first", "1"), ("a", None, "last", "1"))
    new = docs(spark, ("a", None, "last", "1"))
    assert diff.documents(old, new).count() == 0


def test_gate(spark):
    ch = spark.createDataFrame([("documents_added",), ("documents_moved",), ("folders_added",), ("page_text_changed",)], "category string")
    left = lambda *a: sorted(r[0] for r in diff.gate(ch, *a).collect())
    assert left(1, 2, True) == ["documents_moved"]
    assert left(2, 3, True) == ["documents_added", "documents_moved", "folders_added"]
    assert left(3, 3, False) == ["documents_added", "documents_moved", "page_text_changed"]


def test_cells_and_overflow(spark):
    s = "key string, sheet string, cell string, value string, pos int"
    old = spark.createDataFrame([("k", "S", f"A{i}", "1", i) for i in range(30)], s)
    new = spark.createDataFrame([("k", "S", f"A{i}", "2", i) for i in range(30)], s)
    got = dedup.top_details(diff.cell_details(old, new, ["key"]), ["key"], ["sheet", "cell"], 20, "cell change(s)").orderBy("place").collect()
    assert got[0]["detail"] == "S!A0 changed: 1 → 2" and got[2]["detail"].startswith("S!A10") and got[-1]["detail"] == "10 additional cell change(s) omitted" and len(got) == 21


def test_reports_and_routes(spark):
    ch = spark.createDataFrame([("documents_added", "S / x", "T", "https://h/a.pdf", "k"), ("page_text_changed", None, None, None, None)], "category string, section string, title string, url string, key string")
    assert [r["line"] for r in dedup.summary(ch).orderBy("place").collect()] == ["Visible page content changed", "1 document(s) added"]
    routes = spark.createDataFrame([("r", ["a@b.c", "a@b.c", "g@b.c"], [], [], ["pdf"], False), ("p", ["p@b.c"], ["none"], [], [], True)], "name string, recipients array<string>, sections array<string>, titles array<string>, extensions array<string>, include_page_text boolean")
    got = {r["label"]: (r["recipients"], r["n"]) for r in routing.batches(ch, routes, ["g@b.c"]).collect()}
    assert got == {"All monitored changes": ("g@b.c", 2), "r": ("a@b.c", 1), "p": ("p@b.c", 1)}


def test_dynamic_and_tree(spark):
    rules = spark.createDataFrame([("A", "s", "H.test", "manual"), ("B", "s", "h.test", None), ("C", "t", "h.test", None)], "title string, source_url string, match_host string, match_path string")
    links = spark.createDataFrame([("s", "u1", "h.test", "/Manual.pdf"), ("s", "u1", "h.test", "/Manual.pdf"), ("s", "u2", "h.test", "/x")], "source_url string, url string, host string, path string")
    ok, bad = snapshot.dynamic_documents(rules, links)
    assert [(r["identity"], r["url"]) for r in ok.collect()] == [("dynamic:A", "u1")]
    assert sorted(r["title"] for r in bad.collect()) == ["B", "C"]
    tree = spark.createDataFrame([("g", 0, 0, "a"), ("g", 1, 1, "b"), ("g", 2, 2, "c"), ("g", 3, 1, "d"), ("g", 4, 0, "e")], "grid string, pos int, level int, name string")
    assert [r["path"] for r in snapshot.flatten_tree(tree).orderBy("pos").collect()] == ["a", "a / b", "a / b / c", "a / d", "e"]


def test_heartbeat(spark):
    due = lambda last, days: spark.range(1).select(routing.heartbeat_due(F.lit(last), F.lit("2024-01-08T00:00:00"), days)).first()[0]
    assert due("2024-01-01T00:00:00", 7) and not due("2024-01-01T00:00:01", 7)
    assert due(None, 7) and due("nonsense", 7) and not due(None, 0)


def test_state_and_monitor(spark, tmp_path):
    p = f"file://{tmp_path}/x.json"
    assert read_json(spark, p, {"d": 1}) == {"d": 1}
    write_json(spark, p, {"é": [1]})
    assert read_json(spark, p) == {"é": [1]}
    with Lock(spark, f"file://{tmp_path}/lock"):
        with pytest.raises(RuntimeError):
            Lock(spark, f"file://{tmp_path}/lock").__enter__()
    m = Monitor(spark, f"file://{tmp_path}/m", ["root@x.test"])
    old, new = docs(spark, ("a", None, "A", "1")), docs(spark, ("a", None, "A", "2"), ("b", None, "B", "3"))
    assert m.check(old, "r0")[0] == "initialised"
    assert m.check(old, "r1")[0] == "unchanged"
    assert m.check(new, "r2", again=lambda: old)[0] == "suppressed"
    assert m.check(new, "r3", dry_run=True)[1].count() == 2
    outcome, found = m.check(new, "r4", again=lambda: new)
    assert outcome == "changed" and kinds(found) == [("documents_added", None, "b"), ("documents_modified", "a", "a")]
    assert [(r["run_id"], r["n"]) for r in m.outbox().collect()] == [("r4", 2)]
    assert m.check(new, "r5")[0] == "unchanged"
    assert [r["kind"] for r in m.history().collect()] == ["changed", "suppressed"]
    with pytest.raises(ValueError):
        Monitor(spark, f"file://{tmp_path}/m").check(old, "r6")
    assert Store(spark, f"file://{tmp_path}/m/state").read("documents").count() == 2


def test_all_tables_of_a_snapshot(spark):
    link, folder = "url string, title string, section string, pos int", "path string, title string, pos int"
    side = lambda d, ls, fs, text: {"documents": d, "links": spark.createDataFrame(ls, link), "folders": spark.createDataFrame(fs, folder), "page": spark.createDataFrame([(text,)], "page_text string")}
    old = side(docs(spark, ("a", None, "A", "1")), [("l1", "x", "S", 0), ("l2", "y", "T", 1)], [("f", "f", 0)], "t")
    new = side(docs(spark, ("a", None, "A", "2")), [("l1", "z", None, 0), ("l3", "y", "U", 1)], [("g", "g", 0)], "u")
    got = sorted((r["category"], r["key"], r["section"]) for r in diff.snapshots(old, new).collect() if r["key"])
    assert got == [("documents_modified", "a", "S"), ("folders_added", "g", "g"), ("folders_removed", "f", "f"), ("links_added", "l3", "U"), ("links_removed", "l2", "T"), ("links_renamed", "l1", "S")]
    assert diff.snapshots(old, new).filter("category = 'page_text_changed'").count() == 1
    assert diff.snapshots(old, old).count() == 0
    assert {r["category"] for r in diff.snapshots(old, new, 1, 3).collect()} == {"documents_modified"}
    assert {r["category"] for r in diff.snapshots({"documents": old["documents"]}, new).collect()} == {"documents_modified"}


def test_runs_failures_warnings_heartbeat(spark, tmp_path):
    routes = spark.createDataFrame([("s", ["s@x.test"], ["S"], [], [], False), ("t", ["t@x.test"], ["T"], [], [], False)], "name string, recipients array<string>, sections array<string>, titles array<string>, extensions array<string>, include_page_text boolean")
    m = Monitor(spark, f"file://{tmp_path}/m", [], routes, "owner@x.test", 7)
    old, new = docs(spark, ("a", None, "A", "1")), docs(spark, ("a", None, "A", "2"))
    assert m.status().first()["documents"] == 0 and m.check(old, "d", dry_run=True)[1].count() == 1
    assert m.run(lambda: old, "r0") == "initialised"
    with pytest.raises(OSError):
        m.run(lambda: (_ for _ in ()).throw(OSError("no page")), "r1")
    assert m.status().first()["consecutive_failures"] == 1 and m.status().first()["last_error"] == "no page"
    assert m.run(lambda: old, "r2") == "unchanged"  # starts the clock
    state = m.runtime()
    assert state["consecutive_failures"] == 0 and state["last_document_count"] == 1
    write_json(spark, m.runtime_path, state | {"last_heartbeat_at": "2020-01-01T00:00:00+00:00"})
    errors = spark.createDataFrame([("B", "timed  out", 0)], "title string, error string, pos int")
    assert m.run(lambda: {"documents": old, "errors": errors}, "r3") == "unchanged"  # no heartbeat beside errors
    assert m.run(lambda: new, "d2", dry_run=True) == "dry_run" and m.run(lambda: old, "r3b") == "unchanged"
    assert m.run(lambda: new, "r4") == "changed"
    assert sorted((r["run_id"], r["label"], r["recipients"]) for r in m.outbox().collect()) == [
        ("r1", "Monitor failure", "owner@x.test"), ("r3", "Document warning", "owner@x.test"), ("r3b", "Heartbeat", "owner@x.test"), ("r4", "s", "s@x.test"),
    ]
    assert m.status().first()["kind"] == "changed"


def test_details_by_kind(spark):
    unit = lambda *texts: [(i, None, None, t) for i, t in enumerate(texts)]
    cells = lambda **kw: [(i, "S", k, v) for i, (k, v) in enumerate(kw.items())]
    pairs = [
        (("lines", unit("a", "b"), None), ("lines", unit("a"), None)),
        (("paragraphs", unit("a"), None), ("lines", unit("a"), None)),
        (("excel_cells", cells(A10="1", A2="2", B1="5"), None), ("excel_cells", cells(A10="3", A2="2", C1="4"), None)),
        (("pdf_pages", unit("x y", "z"), None), ("pdf_pages", unit("x w", "z"), None)),
        (("unsupported", [], None), ("unsupported", [], "broken")),
        (None, None),
    ]
    kind = "struct<kind:string,units:array<struct<pos:int,sheet:string,cell:string,text:string>>,reason:string>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    got = [r["d"] for r in df.select("i", sequence.analysis_details(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got[0] == ["Old line(s) 2 removed — Removed: b"]
    assert got[1] == ["The document format or detailed-analysis method changed"]
    assert got[2] == ["S!A10 changed: 1 → 3", "S!B1 removed: 5", "S!C1 added: 4"]
    assert got[3] == ['Page 1 changed — Text excerpts: "x y" → "x w"']
    assert got[4] == ["broken"] and got[5] == ["Detailed internal comparison is unavailable for this file type"]


def test_error_digest_is_cut(spark):
    rows = [("x" * 2000, "e  e", 0), (None, None, 1), ("y" * 2000, "f", 2)]
    r = routing.error_digest(spark.createDataFrame(rows, "title string, error string, pos int")).first()
    assert len(r["digest"]) == 3500 and r["digest"].endswith("y…") and " e e | Document: Unavailable | y" in r["digest"] and r["n"] == 3


def test_stream_of_snapshots(spark, tmp_path):
    for i, rows in enumerate([[("a", None, "A", "1")], [("a", None, "A", "2")]]):
        docs(spark, *rows).withColumn("snapshot_id", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/in")
    m = Monitor(spark, f"file://{tmp_path}/m", ["root@x.test"])
    src = spark.readStream.schema(DOC + ", snapshot_id int").parquet(f"{tmp_path}/in")
    m.stream(src, f"{tmp_path}/cp").awaitTermination(120)
    assert m.outbox().count() == 1


def test_retry():
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retry(fails, 3, 5, waits.append) == "ok" and waits == [5, 10]


def test_addresses_hold_nothing_else(spark):
    from driftlens.functions import text
    from driftlens.plans import report

    given = ["a@b.c", "a@b.c\n", "a@b", "a b@c.d", "a\u00a0b@c.d", "a@b.c;d@e.f", "a@@b.c", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = {r["i"]: r["ok"] for r in d.select("i", text.valid_email(F.col("x")).alias("ok")).collect()}
    assert got == {0: True, **dict.fromkeys(range(1, 8), False), 8: None}
    assert d.limit(1).select(text.preview_id(F.lit("p/é.png"))).first()[0] == report.image_id("p/é.png")


def test_page_links_ignore_extensions(spark):
    from driftlens.functions import predicates

    d = spark.createDataFrame([(1, "Forms / A", "One"), (2, "Forms", None), (3, None, "One"), (4, "Other", "One")], "i int, section string, title string")
    kept = lambda f: sorted(r["i"] for r in d.filter(predicates.link_matches(F.col("section"), F.col("title"), f)).collect())
    assert kept(predicates.Filters(("FORMS",), (), ("pdf",))) == [1, 2]
    assert kept(predicates.Filters(("forms",), ("one",), ("pdf",))) == [1]
    assert kept(predicates.Filters((), (), ("pdf",))) == [1, 2, 3, 4]


def test_filtered_changes_and_page_text(spark):
    from driftlens.functions.predicates import Filters
    from driftlens.operators import routing

    d = spark.createDataFrame([("page_text_changed", None, None, None), ("documents_added", "Forms", "One", "https://x.test/a.PDF"), ("documents_added", "Other", "One", None)], "category string, section string, title string, url string")
    f = Filters(("forms",), (), (".pdf",))
    assert [r["section"] for r in routing.filtered(d, f).collect()] == ["Forms"]
    assert routing.filtered(d, f, include_page_text=True).count() == 2
    assert routing.filtered(d, Filters()).count() == 2


def test_pixels(spark):
    from driftlens.operators import diff, sequence

    blank = [[0] * 40 for _ in range(20)]
    hit = [list(r) for r in blank]
    hit[3][5] = hit[3][17] = hit[19][39] = 9
    rows = lambda image, pixels: [(image, y, r) for y, r in enumerate(pixels)]
    frame = lambda r: spark.createDataFrame(r, "image int, y int, row array<int>")
    old = frame(rows(1, blank) + rows(2, blank) + rows(3, blank) + rows(4, blank))
    new = frame(rows(1, hit) + rows(2, blank[:19]) + rows(3, [r[:39] for r in hit]))
    got = sorted(tuple(r) for r in diff.pixel_cells(old, new).collect())
    assert got == [(1, 0, 0, 1, 5, 3, 5, 3), (1, 1, 0, 1, 17, 3, 17, 3), (1, 2, 1, 1, 39, 19, 39, 19)]
    sizes = spark.createDataFrame([(k, 40, 20) for k in range(1, 5)], "image int, width int, height int")
    # The third pixel's cell touches the second's at a corner: one region.
    assert [tuple(r) for r in sequence.boxes(diff.pixel_cells(old, new), sizes).collect()] == [(1, 2, 0, 39, 19)]
    hit[3][17] = 0  # then the first is alone
    assert sorted(tuple(r) for r in sequence.boxes(diff.pixel_cells(frame(rows(1, blank)), frame(rows(1, hit))), sizes).collect()) == [(1, 2, 0, 8, 6), (1, 36, 16, 39, 19)]


def test_refused_downloads(spark):
    from driftlens.sources import files

    d = spark.createDataFrame([("https://x.test/a.PDF?b=1", "Text/HTML"), ("https://x.test/a.pdf", None), ("https://x.test/a.html", "text/html"), (None, "text/html")], "url string, content_type string")
    assert [r["error"] for r in files.refused(d).collect()] == ["expected a .pdf file, got Text/HTML"]


def test_record_documents(spark):
    from driftlens.functions import predicates

    d = spark.createDataFrame([(1, "SQS-daily-1", None), (2, None, "https://x.test/PayItems/sqs%2Ddaily-7.txt"), (3, "x sqs-daily-", "https://x.test/sqs-daily-7"), (4, None, None)], "i int, title string, url string")
    assert [r["i"] for r in d.filter(predicates.is_record_document(F.col("title"), F.col("url"))).collect()] == [1, 2]


def test_preview_pairs(spark):
    page = "array<struct<page:int,text_sha256:string,visual_sha256:string,preview_path:string>>"
    old, new = [(1, "a", "v1", "o/1"), (2, "b", "v2", "o/2")], [(1, "a", "v1", "n/1"), (2, "b", "v9", "n/2"), (3, "c", None, "n/3")]
    d = spark.createDataFrame([("k", old, new), ("same", old, old), ("none", None, None)], f"key string, a {page}, b {page}")
    listing = spark.createDataFrame([("o/2",), ("n/2",), ("n/2",)], "path string")
    got = sorted(tuple(r) for r in snapshot.preview_pairs(d, "key", F.col("a"), F.col("b"), listing).collect())
    assert got == [("k", 0, 2, 2, "o/2", "n/2", None), ("k", 1, None, 3, "", "", "Highlights require both page previews.")]


def test_trees_and_reports_are_whole(spark):
    tree = spark.createDataFrame([(1, i, i, f"n{i}") for i in range(20)], "grid int, pos int, level int, name string")
    paths = [r["path"] for r in snapshot.flatten_tree(tree).orderBy("pos").collect()]
    assert paths == [" / ".join(f"n{j}" for j in range(i + 1)) for i in range(20)]
    assert snapshot.flatten_tree(tree.limit(0)).count() == 0
    changes = diff.documents(docs(spark), docs(spark, *((f"k{i}", None, f"T{i}", str(i)) for i in range(1100))))
    page = report.change_report(changes, "all")
    assert page.count("<tr>") == 1100 and "omitted" not in page
    page = report.change_report(changes, "some", 1000)
    assert page.count("<tr>") == 1000 and "<p>100 additional changes omitted</p>" in page


def test_exclusions_filters_and_config_in_runs(spark, tmp_path):
    """What is excluded since the baseline is no removal, what is filtered only if filters hold for the baseline; the log is trimmed with its reports."""
    from driftlens.config import Config, Route
    from driftlens.functions.predicates import Exclusions

    c = Config("https://x.test", ["root@x.test"], routes=[Route("r", ["s@x.test"], sections=["S"])], history_limit=2, confirmation_delay_seconds=0, heartbeat_days=0)
    m = Monitor.of(spark, f"file://{tmp_path}/m", c)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return docs(spark, ("a", None, "A", "1"), ("b", None, "B", "2"))

    m.sleep = lambda _: None
    assert m.run(flaky, "r0") == "initialised" and len(calls) == 3  # retried
    fewer = docs(spark, ("a", None, "A", "1"))
    c.set_filter("titles", ["a"])
    narrow = Monitor.of(spark, m.root, c)
    assert kinds(narrow.changes(fewer)) == [("documents_removed", "b", "b")]
    narrow.filter_baseline = True
    assert narrow.changes(fewer).count() == 0
    c.clear_filters()
    assert kinds(m.changes(fewer)) == [("documents_removed", "b", "b")]
    section = fewer.first()["section"]
    assert Monitor.of(spark, m.root, c, Exclusions(top_sections=(section.split(" / ")[0].upper(),))).changes(fewer).count() == 0
    for k in range(4):
        assert m.run(lambda k=k: docs(spark, ("a", None, "A", f"v{k}")), f"c{k}") == "changed"
    log = m.history().collect()
    assert [r["seq"] for r in log] == ["c3", "c2"] and log[0]["details"] == ["1 document(s) modified"]
    assert sorted(x.name for x in (tmp_path / "m/reports").iterdir() if x.suffix == ".html") == ["changed-c2.html", "changed-c3.html"]
    page = report.history_page(m.history())
    assert 'href="reports/changed-c3.html"' in page and "1 document(s) modified" in page


def test_report_sections(spark):
    changes = diff.documents(docs(spark, ("a", None, "<A>", "1")), docs(spark, ("a", None, "<A>", "2"), ("b", None, "B", "3")))
    details = spark.createDataFrame([("a", 0, "Line(s) 1 <changed>"), ("zz", 0, "no")], "key string, place int, detail string")
    previews = spark.createDataFrame([("a", 0, None, 2, None, "data:image/png;base64,xx", None), ("a", 1, 1, 1, None, None, "n")], "key string, place int, old_page int, new_page int, old_data string, new_data string, note string")
    records = spark.createDataFrame([("added", "C1", None, "EA")], "kind string, code string, old_unit string, new_unit string")
    page = report.change_report(changes, "t", details=details, previews=previews, records=records)
    assert page.index("document(s) added</h2>") < page.index("document(s) modified</h2>") and "&lt;A&gt;" in page and "<A>" not in page
    assert "Line(s) 1 &lt;changed&gt;" in page and ">no<" not in page and "<td>C1</td>" in page
    assert "No previous page (added)." in page and "AFTER — PAGE 2" in page and page.count("Preview unavailable.") == 2


def test_state_is_never_absent(spark, tmp_path):
    path = f"file://{tmp_path}/s.json"
    for k in range(3):
        write_json(spark, path, {"k": k})
        assert read_json(spark, path) == {"k": k}
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["s.json"]
