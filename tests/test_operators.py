"""Operators on hand-made frames: nulls, ties, empty inputs, order of selection."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import values as V
from evidentia.operators import catalog as C
from evidentia.operators import corpus as K
from evidentia.operators import evidence as E
from evidentia.operators import greedy as G
from evidentia.operators import retrieval as R
from evidentia.operators import web as W
from evidentia.sources import markup as M
from evidentia.sources import tables as S


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="板厚 1220×2440mm®") == ["1220×2440mm", "板", "厚", "板厚"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []
    assert one(spark, T.context_terms(F.col("t")), t="Straße a 石材幕墙板") == ["strasse", "石材", "材幕", "幕墙", "墙板"]
    assert one(spark, T.session_terms(F.col("t")), t="the 板 of 石材 x.y") == ["x.y", "石材"]


def test_squeezed_and_estimates(spark):
    assert one(spark, T.squeezed(F.col("t")), t=" 石 材  a  b ") == "石材 a b"
    assert one(spark, T.estimated_tokens(F.col("t")), t="石材 abcdefghi !!!") == 2 + 3 + 2
    assert one(spark, T.estimated_tokens(F.col("t")), t="") == 0
    for text in ("石材 abcdefghi !!!", "a/b 1.5% x_y", "é à"):
        assert one(spark, T.estimated_tokens(F.col("t")), t=text) == G.estimate(text)


def test_scripts(spark):
    s = one(spark, T.scripts(F.col("t")), t="かな漢字 the total")
    assert s[0]["code"] == "en" and s[1]["script"] == "Jpan"
    assert one(spark, T.scripts(F.col("t")), t="123")[0]["script"] == "Zyyy"
    assert one(spark, T.scripts(F.col("t")), t="  ") == []


def test_values(spark):
    assert one(spark, V.number(F.col("t")), t="(1,234.5)") == -1234.5
    assert one(spark, V.number(F.col("t")), t="nan") is None
    assert one(spark, V.period(F.col("t")), t="2024 年 3 月 31 日") == "2024-03"
    assert one(spark, V.period(F.col("t")), t="2024-02-30") is None
    assert one(spark, V.period(F.col("t"), F.lit("2023")), t="7月") == "2023-07"
    assert one(spark, V.previous_period(F.col("t")), t="2024-01") == "2023-12"
    url = "HTTP://A.Example.com:80//x//y?utm_source=a&q=1&fbclid=z#top"
    assert one(spark, V.canonical_url(F.col("t")), t=url) == "http://a.example.com/x/y?q=1&fbclid=z"
    assert one(spark, V.canonical_url(F.col("t")), t="ftp://x/") == ""
    assert one(spark, V.canonical_url(F.col("t")), t="https://user@x.com/") == ""
    assert one(spark, V.publisher(F.col("t")), t="https://www.a.co.uk/x") == "a.co.uk"


def test_box_distance(spark):
    box = lambda *x: F.array(*map(F.lit, x))
    get = lambda a, b: spark.range(1).select(V.box_distance(a, b).alias("x")).first()["x"]
    assert get(box(0.0, 0.0, 1.0, 1.0), box(4.0, 5.0, 6.0, 7.0)) == 5.0
    assert get(box(0.0, 0.0, 1.0, 1.0), box(1.0, 1.0, 2.0, 2.0)) == 0.0
    assert get(box(1.0, 0.0, 1.0, 1.0), box(1.0, 1.0, 2.0, 2.0)) == 900.0


def test_scopes(spark):
    rows = spark.createDataFrame([(1, None), (2, "internal"), (3, "public")], "id int, access_scope string")
    ids = lambda s: [r.id for r in K.eligible(rows, s).orderBy("id").collect()]
    assert ids(["public"]) == [1, 3] and ids([]) == [] and ids(None) == [1, 2, 3]


def test_bm25_statistics_cover_all_rows(spark):
    docs = spark.createDataFrame([(1, "red stone"), (2, "red red brick"), (3, "blue"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "red"), (2, "missing"), (3, "")], "query_id long, text string")
    every = {(r.query_id, r.id): r.score for r in R.bm25(queries, docs).collect()}
    some = {(r.query_id, r.id): r.score for r in R.bm25(queries, docs, spark.createDataFrame([(2,)], "id long")).collect()}
    assert set(every) == {(1, 1), (1, 2)} and some == {(1, 2): every[1, 2]}


def test_fusion_ties_go_down_by_id(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 5, 2)], "query_id long, id long, rank int")
    assert [r.id for r in R.fused([a, b]).orderBy("rank").collect()] == [7, 5]


def test_first_fit_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 1, 4), (1, 2, 9), (1, 3, 3)], "q int, id int, size int")
    kept = [r.id for r in E.first_fit(items, ["q"], ["id"], "id", "size", 8).where("kept").orderBy("id").collect()]
    assert kept == [1, 3]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 21)], "k int, s int, e int")
    got = E.merged_intervals(rows, ["k"], "s", "e").first()
    assert (got.pieces, got.covered) == (2, 10)


def test_near_duplicates_are_not_pairwise(spark):
    long = "x" * 100
    rows = [(1, 1, "d", 3.0, long), (1, 2, "d", 2.0, long + "yy"), (1, 3, "e", 1.0, long + "yy"), (1, 4, "d", 0.5, " ")]
    kept = [r.id for r in G.distinct_greedily(spark.createDataFrame(rows, "query_id long, id long, doc string, score double, text string")).orderBy("position").collect()]
    assert kept == [1, 3]


def test_set_cover(spark):
    edges = [(1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 2, 3), (1, 3, 3)]
    out = G.set_cover(spark.createDataFrame(edges, "query_id long, evidence_id long, requirement_id long"), 5).orderBy("position").collect()
    assert [(r.evidence_id, r.newly) for r in out] == [(1, 2), (2, 1)]


def test_groups_leave_whole(spark):
    rows = [(1, 1, "a", 9.0, 5, False), (1, 2, "b", 1.0, 4, False), (1, 3, "b", 0.5, 4, False), (1, 4, "c", 0.1, 3, True)]
    out = G.evict_groups(spark.createDataFrame(rows, "query_id long, id long, group string, score double, tokens int, protected boolean"), 9)
    assert {r.id for r in out.where("kept").collect()} == {1, 4}


def test_components(spark):
    edges = [(1, 1, 10), (1, 2, 10), (1, 2, 11), (1, 3, 12)]
    out = G.conflict_components(spark.createDataFrame(edges, "query_id long, group_id long, evidence_id long"))
    assert {(r.group_id, r.component) for r in out.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_windows_cover_and_go_forward():
    random.seed(1)
    text = " ".join("".join(random.choice("abc ") for _ in range(random.randint(1, 12))) + random.choice([".", "", "\n"]) for _ in range(400))
    spans = G.cut(text, 60, 10)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d
    assert all(G.estimate(text[a:b]) <= 60 for a, b in spans)
    assert G.cut("", 10, 2) == []


def test_admission(spark):
    rows = [("http://localhost/x", "t"), ("https://a.bad.com/", "t"), ("javascript:1", "t"), ("https://ok.com/", " "), ("https://ok.com/", "t")]
    got = [r.x for r in spark.createDataFrame(rows, "u string, b string").select(W.rejection(F.col("u"), F.col("b"), ["bad.com"]).alias("x")).collect()]
    assert got == ["non_public_url", "blocked_domain", "unsafe_url", "empty_source", ""]


def test_web_rank_needs_every_score(spark):
    rows = [(1, 0.1, 1), (1, 0.9, 2), (2, 0.1, 1), (2, None, 2)]
    out = W.ranked(spark.createDataFrame(rows, "q int, s double, r int"), "q", "s", "r").collect()
    assert {(x.q, x.r): x.position for x in out} == {(1, 1): 2, (1, 2): 1, (2, 1): 1, (2, 2): 2}


def test_missing_group(spark):
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "a")], "id int, g string")
    assert {r.g: r.n for r in C.grouped(rows, ["g"], "id").collect()} == {C.MISSING: 2, "a": 1}


def test_fuzzy_needs_one_hit(spark):
    left = spark.createDataFrame([(1, "Stone Panel A"), (2, "panel"), (3, "granite board"), (4, None)], "id int, name string")
    right = spark.createDataFrame([(7, "stone panel a"), (8, "granite"), (9, "board of granite board")], "match int, label string")
    got = {r.id: (r.match, r.how) for r in C.fuzzy_matched(left, right).collect()}
    assert got[1] == (7, "equal") and 2 not in got and 3 not in got


def test_strict_lines_raise(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('﻿{"a": 1}\n\n{"a": 2}\nnot json\n[1]\n', encoding="utf-8")
    assert sorted(r.a for r in S.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="not a record"):
        S.json_lines_strict(spark, str(p), "a int").collect()


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿名称;值\n板;1\n".encode())
    (tmp_path / "b.csv").write_bytes("名称\t值\n板\t2\n".encode("gb18030"))
    got = {(r.address, r.value) for r in S.csv_cells(spark, str(tmp_path)).collect()}
    assert {("A1", "名称"), ("B2", "1"), ("B2", "2")} <= got


def test_workbook_and_document(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    got = {r.address: (r.value, r.formula, r.merged) for r in S.xlsx_cells(S.files(spark, str(tmp_path / "a.xlsx"))).collect()}
    assert got == {"A1": ("name", None, "A1:A2"), "B1": ("2", "=1+1", None)}

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = [(r.kind, r.heading, r.text) for r in M.docx_scan(S.files(spark, str(tmp_path / "a.docx"))).orderBy("block").collect()]
    assert got == [("heading", "Top", "Top"), ("paragraph", "Top", "body"), ("cell", "Top", "c")]


def test_archive_guards(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../up.txt", "x")
        z.writestr("bomb", "0" * 1_000_000)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {(r.name, r.refused) for r in M.zip_scan(S.files(spark, str(tmp_path))).collect()}
    assert got == {("ok.txt", None), ("../up.txt", "unsafe_name"), ("bomb", "ratio"), ("", "not_a_zip")}


def test_html_and_xml(spark):
    html = "<h1>T</h1><script>x</script><p>a &amp; b</p><table><tr><td>1</td><td>2</td></tr></table><img alt='pic'>"
    got = [(k, r, c, t) for k, _, r, c, t in M.html_elements(html)]
    assert got == [("heading", 0, 0, "T"), ("text", 0, 0, "a & b"), ("cell", 1, 1, "1"), ("cell", 1, 2, "2"), ("image", 0, 0, "pic")]
    assert M.xml_tables('<r><i k="1"><a>x</a><a>y</a></i><i/></r>') == [("r/i", 1, "@k", "1"), ("r/i", 1, "a", "x | y"), ("r/i/a", 1, "#text", "x"), ("r/i/a", 2, "#text", "y")]
    bad = spark.createDataFrame([(1, "<a>"), (2, None)], "id int, x string")
    assert M.xml_scan(bad, "id", "x").count() == 0


def test_canonical_addresses(spark):
    rows = [(1, "http://x.org/a?b=%7e%2a+c&referrer=1&e&SPM=2"), (2, "https://müller.de:443/ü"), (3, "http://x.org/a?b=~*+c&e="), (4, "http://x.org/?q=%zz")]
    got = {r.id: r.canonical for r in W.first_seen(spark.createDataFrame(rows, "id int, url string"), "id").collect()}
    assert got == {1: "http://x.org/a?b=~%2A+c&e=", 2: "https://xn--mller-kva.de/ü", 4: "http://x.org/?q=%25zz"}


def test_located_rows_stay_apart(spark):
    rows = spark.createDataFrame([("a hall", 1), ("a hall", 1), ("none", None)], "name string, n int")
    rules = spark.createDataFrame([(2, "hall", "second"), (1, "a ", "first")], "ordinal int, marker string, location string")
    assert sorted((r.name, r.location) for r in C.located(rows, rules, "name").collect()) == [("a hall", "first"), ("a hall", "first"), ("none", None)]


def test_windows_reach_over_wide_gaps():
    text = ("word" + " " * 60) * 300
    assert G.cut(text, 200, 0)[0][1] > 200 * 8 + 64 and G.estimate(text[: G.cut(text, 200, 0)[0][1]]) <= 200


def test_repeated_entries(spark):
    text = "\n".join(["- a", "- b", "- c"] * 3 + ["plain", "- a"])
    got = E.repeated_entries(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.repeated, r.excess) for r in got] == [(3, 6)]


def test_cycles(spark):
    block = "\n".join("line %d %s" % (i, "x" * 90) for i in range(3)) + "\n"
    rows = spark.createDataFrame([(1, block * 3), (2, block * 2), (3, None)], "doc_id int, text string")
    assert [(r.id, r.period) for r in G.cycles(rows).collect()] == [(1, 3)]


def test_diversity_and_pool_on_nothing(spark):
    none = spark.createDataFrame([], "query_id long, id long, source string, score double")
    assert R.diverse(none).count() == 0
    assert K.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quota_counts_by_day(spark):
    rows = [(i, datetime(2024, 1, 1 + i // 5, i % 24)) for i in range(10)]
    out = W.quota(spark.createDataFrame(rows, "id int, ts timestamp"), "ts", "id", 3).collect()
    assert sum(r.admitted for r in out) == 6 and {r.used for r in out} == {1, 2, 3, 4, 5}
