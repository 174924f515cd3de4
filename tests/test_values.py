"""Values of operators that depend on order or on supplied functions, on hand-made frames."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.functions import nested as N
from evidentia.operators import greedy as G
from evidentia.sources import legacy, pages

FOLDER = "/root/testdata/sf0.001"


def test_windows_are_picked(spark):
    rows = [(1, 1, "a", 0, 100, 40, 9.0), (1, 2, "a", 20, 120, 40, 8.0), (1, 3, "a", 90, 190, 50, 7.0), (1, 4, "b", 0, 100, 30, 6.0), (1, 5, "b", 0, 10, 10, 6.0), (2, 6, "a", 0, 1, 500, 1.0)]
    frame = spark.createDataFrame(rows, "query_id long, id long, doc string, start int, end int, tokens int, score double")
    got = [(r.query_id, r.id, r.position) for r in G.pick_windows(frame, 3, 110).orderBy("query_id", "position").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (1, 5, 3)]  # 2 overlaps 1, 4 is over the budget, 5 fits


def test_groups_are_evicted(spark):
    rows = [(1, 1, "g", 9.0, 50, False), (1, 2, "h", 1.0, 30, False), (1, 3, "h", 2.0, 30, False), (1, 4, "p", 0.0, 40, True), (1, 5, "k", 2.0, 10, False)]
    frame = spark.createDataFrame(rows, "query_id long, id long, `group` string, score double, tokens int, protected boolean")
    got = {r.id: r.kept for r in G.evict_groups(frame, 100).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}  # k goes first, then h: 160, 150, 90


def test_primary_visuals(spark):
    rows = [(1, 10, 5.0, [7, 8]), (1, 11, 4.0, [7]), (1, 12, 4.0, [7, 9]), (1, 13, 1.0, [])]
    got = [(r.case_id, r.asset_id, r.position) for r in G.primary_visuals(spark.createDataFrame(rows, "query_id long, case_id long, score double, assets array<long>"), 5).orderBy("position").collect()]
    assert got == [(10, 7, 1), (12, 9, 2)]


def test_set_cover(spark):
    edges = [(1, 10, r) for r in (1, 2)] + [(1, 11, r) for r in (1, 2, 3)] + [(1, 12, 4)] + [(1, 13, 4)]
    got = [(r.evidence_id, r.newly) for r in G.set_cover(spark.createDataFrame(edges, "query_id long, evidence_id long, requirement_id long"), 9).orderBy("position").collect()]
    assert got == [(11, 3), (12, 1)]


def test_compression(spark):
    text = "Plain words here. " * 30 + "The token matters. Next one. " + "Other rights. " * 3 + "Tail text. " * 40
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.id: r.text for r in G.compressed(rows, ["token", "rights"], 80).collect()}
    assert got[2] == "short" and got[3] == "" and len(got[1]) <= 80
    assert got[1] == "Plain words here. The token matters. Next one. Other rights. Other rights."


def test_query_windows(spark):
    """The chosen windows are the best by terms and then by place that fit, whatever order they are listed in."""
    terms = {"the", "token", "rights", "stupid"}
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {}
    for r in plans.QUERIES["R19_query_windows"](spark, FOLDER).collect():
        got.setdefault(r.doc_id, set()).add(r.start)
    for d, t in docs.items():
        cut = [(s, t[s : s + 600]) for s in range(0, max(len(t), 1), 480)]
        order = sorted(cut, key=lambda x: (-len(terms & set(re.findall("[a-z0-9]{2,}", x[1].lower().replace("ß", "ss")))), x[0]))
        used, want = 0, set()
        for s, body in order:
            if used + len(body) <= 1800:
                used += len(body)
                want.add(s)
        assert got.get(d, set()) == want


def test_directory_packets(spark):
    rows = [("c", i, "x" * n) for i, n in enumerate((4, 4, 30, 3, 3))] + [("d", 9, "y")]
    got = {(r.category, r.member): r.packet for r in G.directory_packets(spark.createDataFrame(rows, "category string, member long, text string"), 10).collect()}
    assert got == {("c", 0): 0, ("c", 1): 0, ("c", 2): 1, ("c", 3): 2, ("c", 4): 2, ("d", 9): 0}


def test_colours(spark):
    x = np.arange(12, dtype=float)
    (r,) = G.colour_descriptors(spark.createDataFrame([(1, x.tolist())], "id long, pixels array<double>")).collect()
    p = x.reshape(-1, 3)
    assert np.allclose(r.descriptor, np.concatenate([p.mean(0), p.std(0), *np.quantile(p, (0.25, 0.5, 0.75), axis=0)]), atol=1e-6)


def test_supplied_functions(spark):
    files = spark.createDataFrame([("f", b"abc"), ("g", b"")], "path string, content binary")
    got = {(r.file, r["rank"]): (r.text, r.confirmed) for r in pages.image_candidates(files, lambda d: [(d.decode(), 0.5), ("second", 0.1)] if d else []).collect()}
    assert got == {("f", 1): ("abc", False), ("f", 2): ("second", False)}
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.id: list(r.vector) for r in pages.encoded(docs, lambda ts: [[float(len(t)), 1.0] for t in ts], batch=1).collect()} == {1: [1.0, 1.0], 2: [0.0, 1.0]}
    got = {r.id: r.vector[0] for r in plans.QUERIES["D30_encode"](spark, FOLDER).collect()}
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id = 3").first().text
    assert got[3] == hashlib.sha256(text.encode()).digest()[0] / 255


def test_images_of_scanned_pages_are_recovered(spark):
    page = b"1 0 obj << /Type /Page /Contents 2 0 R /Resources << /XObject << /I 3 0 R >> >> >> endobj\n2 0 obj << >> stream\n\nendstream endobj\n3 0 obj << /Filter /DCTDecode >> stream\nPIXELS\nendstream endobj\n"
    plain = b"1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << >> stream\nBT (a page with enough of its own text to be read directly) Tj ET\nendstream endobj\n"
    files = spark.createDataFrame([("scan", page), ("text", plain), ("none", b"")], "path string, content binary")
    got = [(r.file, r.page, r.text) for r in pages.visual_recovery(files, lambda d: [(d.decode(), 0.9)]).collect()]
    assert got == [("scan", 1, "PIXELS")]


def test_tables_of_pages():
    cells = pages.table_cells([(50, 700, "title"), (50, 600, "a"), (150, 601, "1"), (50, 580, "b"), (151, 580, "2"), (158, 580, "more"), (50, 560, "alone")])
    assert cells == [(1, 1, "a"), (1, 2, "1"), (2, 1, "b"), (2, 2, "2 more")]
    assert pages.table_cells([(50, 600, "a"), (50, 580, "b")]) == [] and pages.table_cells([]) == []


def test_legacy_workbooks(spark):
    from evidentia.plans.files import _legacy

    names = [f"name {i} é" for i in range(400)]  # strings that go over several records are read on
    book = _legacy(names[:40])
    cells = legacy.workbook(book)
    assert [c[4] for c in cells if c[3] == 1 and c[0] == "nations"] == names[:40] and cells[-1] == ("more", "hidden", 1, 1, "TRUE", "boolean")
    assert legacy._rk((-5 & 0x3FFFFFFF) << 2 | 2) == -5 and legacy._rk(500 << 2 | 3) == 5.0
    reader = legacy._Parts([b"\x05\x00\x00ab", b"\x01c\x00d\x00", b"\x00e"])
    assert reader.string() == "abcde"
    files = spark.createDataFrame([("a", book), ("b", b"nothing"), ("c", book[:700])], "path string, content binary")
    got = {r.file: r.n for r in legacy.xls_cells(files).groupBy("file").agg(F.count_if(F.col("kind") == "unreadable").alias("n")).collect()}
    assert got["a"] == 0 and got["b"] == 1


def test_pruned_metadata(spark):
    rows = spark.createDataFrame([(1, '{"a":0,"b":false,"c":"","d":[null,{"e":{}},"x"],"f":{"g":[]}}'), (2, None)], "id int, j string")
    assert {r.id: r.p for r in rows.select("id", N.pruned_json(F.col("j")).alias("p")).collect()} == {1: '{"a":0,"b":false,"d":["x"]}', 2: None}
