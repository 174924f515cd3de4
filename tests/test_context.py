"""Admission to questions, pools of visuals, session windows, ordered contexts and facts of rows, each against hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from evidentia.operators import context as C
from evidentia.operators import retrieval as R
from evidentia.operators import selection as S
from evidentia.operators import web as W
from evidentia.operators.facts import row_facts


def test_admission_reasons(spark):
    rows = [
        ("wool panel", "https://ok.com:444/", "wool", "x", "unsafe_url"),
        ("wool panel", "https://ok.com:443/", "wool", "x", ""),
        ("wool panel", "https://ok.com/", "other", "nothing", "no_query_overlap"),
        ("wool panel", "https://ok.com/", "other", "a Panel of", ""),
        ("wool panel", "https://a.bad.com/", "other", "nothing", "blocked_domain"),
        ("wool panel", "https://a.bad.com/", "某某成人版 下载", "x", "seo_download_pollution"),
        ("wool panel", "https://ok.com/", "XXX video wool", "x", "unrelated_adult_landing_page"),
        ("sex education", "https://ok.com/", "xxx video of sex", "x", ""),
        ("wool panel", "http://127.0.0.1/", " ", None, "empty_source"),
        ("wool panel", "http://127.0.0.1/", "wool", None, "non_public_url"),
        ("2024年5月1日", "https://ok.com/", "other", "x", ""),
        (None, "https://ok.com/", "other", "x", ""),
        ("wool panel", None, "wool", "x", "unsafe_url"),
    ]
    frame = spark.createDataFrame(rows, "q string, u string, t string, b string, want string")
    got = frame.select(W.admission(F.col("q"), F.col("u"), F.col("t"), F.col("b"), ["bad.com"]).alias("got"), "want", "u", "t").collect()
    assert [(r.u, r.t, r.got) for r in got] == [(r.u, r.t, r.want) for r in got]


def test_pools_don_t_share_places(spark):
    asked = spark.createDataFrame([("由哪些 材料组成",), ("如何检测平整度",), ("多少钱",), (None,)], "q string").select(S.asks_for_form(F.col("q")).alias("x"))
    assert [r.x for r in asked.collect()] == [True, True, False, False]
    rows = [(q, kind, i, i, 60 - i if i > 40 else None, i, q == 1) for q in (1, 2) for kind in ("text", "visual") for i in range(1, 61)]
    out = R.rerank_pools(spark.createDataFrame(rows, "query_id int, kind string, id int, rank int, lexical_rank int, dense_rank int, predicate boolean")).collect()
    got = {(q, k): sorted(r.id for r in out if (r.query_id, r.kind) == (q, k)) for q in (1, 2) for k in ("text", "visual")}
    assert got[1, "text"] == [*range(1, 25), *range(53, 61)] and got[2, "text"] == [*range(1, 17), *range(53, 61)]
    assert got[1, "visual"] == got[2, "visual"] == [1, 2, 3, 4, 5, 6, 59, 60]


WINDOW = "window_id int, session int, document int, `order` int, text string, ranking string, kind string, first boolean, last boolean"


def test_session_windows(spark):
    windows = [
        (1, 7, 1, 1, "index of sheets", None, "document_index", True, False),
        (2, 7, 1, 2, "index of more panels", None, "document_index", False, True),
        (3, 7, 1, 3, "[TABLE id=1 sheet=Prices (net) state=visible] 2024-05 panel panel", None, "table", True, False),
        (4, 7, 1, 4, "[TABLE id=1 sheet=Prices (net) state=visible] x", None, "table", False, True),
        (5, 7, 1, 5, "kind=paragraph panel", "no term here", "text", False, False),
        (6, 7, 1, 6, "kind=derived_text y", None, "table", False, True),
        (7, 7, 1, 7, "source=pdf; panel A1='" + "word " * 14 + "' B1='" + "word " * 15 + "'", None, "text", True, True),
        (8, 8, 2, 8, "panel 2024-05", None, "text", True, True),
        (9, 7, 1, 9, None, None, None, None, None),
    ]
    questions = [(1, 7, "Panel in 2024-05, 2024-05 of prices (NET)?", False), (2, 7, "tell", True), (3, 9, "panel", True), (4, 7, None, None), (5, 7, "panels prices(net)x", False)]
    q = spark.createDataFrame(questions, "query_id int, session int, text string, whole boolean")
    out = {(r.query_id, r.window_id): (r.score, r.reserved, r.position) for r in C.session_windows(q, spark.createDataFrame(windows, WINDOW)).collect()}
    rare = math.log1p(9 / 3)  # eight windows of the session, two with the term

    def worth(c):
        return rare * (1 + c / (c + 1.5))

    # "prices" stands in windows 3 and 4, so does "net"; "panel" in 3 and 7
    assert out[1, 3] == (pytest.approx(worth(2) + 2 * worth(1) + math.log1p(9 / 2) * 1.4 + 4 + 16, abs=1e-6), False, 1)
    assert out[1, 4] == (pytest.approx(2 * worth(1) + 4, abs=1e-6), False, 2)
    assert out[1, 7] == (pytest.approx(0.25 * worth(1), abs=1e-6), False, 3)
    assert {k for k in out if k[0] == 1} == {(1, 3), (1, 4), (1, 7)}
    assert {w: s for (k, w), (s, _, _) in out.items() if k == 2} == {1: 8.0, 3: 2.5, 4: 2.5, 5: 0.15, 6: 0.02, 7: 0.3, 9: 0.12}
    assert out[2, 1][1:] == (True, 1) and out[2, 3][2] == 2 and out[2, 4][2] == 3
    assert not [k for k in out if k[0] in (3, 4)]
    assert out[5, 2][0] == pytest.approx(math.log1p(9 / 2) * 1.4 - 0.25, abs=1e-6) and (5, 3) in out and out[5, 3][0] < 4
    assert len(C.session_windows(q, spark.createDataFrame(windows, WINDOW), 1).collect()) == 3
    assert C.session_windows(q, spark.createDataFrame([], WINDOW)).count() == 0


def test_session_windows_without_broadcasts(spark, monkeypatch):
    from evidentia.operators import catalog, containment

    windows = [(i, i % 3, i // 4, i, f"[TABLE sheet=s{i % 5} state=x] p{i % 7} wool 2024-0{i % 6}", None, "document_index" if i % 9 == 0 else "text", i % 4 == 0, i % 4 == 3) for i in range(60)]
    q = spark.createDataFrame([(i, i % 3, f"p{i} wool 2024-0{i} s{i}", i % 2 == 0) for i in range(6)], "query_id int, session int, text string, whole boolean")
    whole = sorted(map(tuple, C.session_windows(q, spark.createDataFrame(windows, WINDOW)).collect()))
    monkeypatch.setattr(catalog.sized_broadcast, "__defaults__", (0,))
    monkeypatch.setattr(containment, "NAME_BYTES", 0)
    assert sorted(map(tuple, C.session_windows(q, spark.createDataFrame(windows, WINDOW)).collect())) == whole and len(whole) > 60


EVIDENCE = "query_id int, question string, id int, ordinal int, source_type string, text string, ranking string, targets array<string>, aspect string, goals map<string,double>, reranked boolean, source_group string, chunk string, authority string, navigation boolean"


def test_ordered_context(spark):
    question = "wool panel thickness 2024-05 Plan A"
    table = "[ROW 2] A2='wool panel' B2='1,200.5'\n[TABLE_CONTEXT] thickness"
    rows = [
        (1, question, 1, 1, "company_rag", None, None, None, None, None, None, None, None, None, None),
        (1, question, 2, 2, "company_rag", "wool", None, ["wool", "panel"], "panel", {"g": 0.5}, None, None, None, "T1_x", None),
        (1, question, 3, 3, "customer_document", table, "nothing", [], None, None, None, "plan a", None, None, None),
        (1, question, 4, 4, "visual", "must not exceed 5 mm panel 2024-05", None, None, None, None, None, "plan", "c", "company_reviewed_material", None),
        (1, question, 5, 5, "company_rag", "wool", None, None, None, None, None, None, None, None, True),
        (2, question, 6, 1, None, "full steel plate", None, ["steel plate wide", "Ｓｔｅｅｌ"], None, {"a": 0.2, "b": 0.9}, True, None, None, None, None),
        (2, None, 7, 2, None, None, None, None, None, None, False, None, None, None, None),
    ]
    out = {r.id: r for r in C.ordered_context(spark.createDataFrame(rows, EVIDENCE)).collect()}
    term = lambda n: 0.08 + 0.04 * math.log1p(n)
    assert out[1].score == pytest.approx(60 / 61 + 0.25, abs=1e-6)
    assert out[2].score == pytest.approx(60 / 62 + term(4) + 2 + min(0.9, 0.3 + 0.55) + 0.25 + 0.16, abs=1e-6) and out[2].local_rank == 2
    assert out[3].score == pytest.approx(60 / 61 + 0.8 + 0.08 + 0.7 + 0.3, abs=1e-6)
    assert out[4].score == pytest.approx(60 / 61 + term(5) + term(7) + 0.24 + 0.5 + 0.7 + 0.08 + 0.08, abs=1e-6)
    assert out[6].score == pytest.approx(5.4 + 0.15 * (60 / 61 + 3.6 + 0.6), abs=1e-6)
    assert out[7].score == pytest.approx(0.15 * 60 / 62, abs=1e-6)
    assert sorted(out) == [1, 2, 3, 4, 6, 7] and [i for i in sorted(out, key=lambda i: out[i].position) if i < 6] == sorted((1, 2, 3, 4), key=lambda i: -out[i].score)
    assert C.ordered_context(spark.createDataFrame([], EVIDENCE)).count() == 0


def test_facts_of_rows_and_lines(spark):
    texts = [
        (1, "[COLUMNS] A=Product | B=Thickness | C=unit\nA1='Rock Wool' B1='5' C1='cm' D1[width]='1,200mm' E1[period]='2023'"),
        (2, "A1[Model]='' A2[产品]='X 1' B1[price]='20' C1[成本]='3 usd'\nB1[price]='7 usd'"),
        (3, "[BLOCK id=b page=2] Panel P has thickness: 10cm, weight is 2 kg\n[NOTE] mass 3 kg"),
        (4, "x" * 81 + " width 3 m, width 4m"),
        (5, "Panel width 3 mx and 板厚为5毫米"),
        (6, None),
        (7, ""),
        (8, "width 3 m"),
        (9, "A1[product]='P' B1[width]='1 m' C1[width]='2 m'"),
    ]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    out = [(r.id, r.line, r.entity, r.metric, r.value, r.unit, r.scope) for r in row_facts(docs, scope=F.lit("all")).orderBy("id", "line", "ordinal").collect()]
    assert out == [
        (1, 1, "rockwool", "thickness", 50.0, "mm", "2023"),
        (1, 1, "rockwool", "width", 1200.0, "mm", "2023"),
        (2, 0, "x1", "cost", 3.0, "USD", "all"),
        (3, 0, "panelp", "thickness", 100.0, "mm", "all"),
        (3, 0, "panelphasthickness:10cm", "weight", 2.0, "kg", "all"),
        (5, 0, "panelwidth3mxand", "thickness", 5.0, "mm", "all"),
        (9, 0, "p", "width", 2000.0, "mm", "all"),
    ]
    named = [(r.id, r.entity, r.value) for r in row_facts(docs.where("doc_id in (4, 8)"), entity=F.lit("E 1")).orderBy("id", "ordinal").collect()]
    assert named == [(4, "e1", 3000.0), (4, "e1", 4000.0), (8, "e1", 3000.0)]


def test_domain_priorities(spark):
    rows = [
        (["overview", "standard"], ["01_standard_specification"], None, ["canonical_product_profile"], True, 7),
        (["overview"], None, ["enterprise_product_catalogue", "enterprise_product_master_profile"], None, None, 6),
        (["overview", "procedure"], ["03_construction_method"], ["internal_product_comparison"], [None], True, 1),
        (["overview"], ["03_construction_method"], [], None, True, 0),
        (["standard", "procedure"], ["01_standard_specification", "04_node_atlas"], None, None, True, 1),
        (["atlas"], ["03_construction_method"], None, None, False, 2),
        (["atlas"], ["03_construction_method", "04_node_atlas"], None, None, False, 3),
        (["standard"], ["03_construction_method", "01_standard_specification"], None, None, False, 3),
        ([], ["03_construction_method"], None, ["canonical_product_profile"], True, 0),
        (None, None, None, None, None, 0),
    ]
    frame = spark.createDataFrame(rows, "r array<string>, d array<string>, c array<string>, l array<string>, s boolean, want int")
    out = frame.select(R.domain_priority(F.col("r"), F.col("d"), F.col("c"), F.col("l"), F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_metrics_of_labels(spark):
    from evidentia.operators.sheets import resolved_metrics

    told = spark.createDataFrame([("Gross", "weight"), ("gross ", "weight"), ("net", "weight"), ("Net", "cost"), ("width", "cost"), ("", "area"), (None, "area"), ("x", None)], "label string, metric string")
    labels = ["Price", "板厚", "total mass", "mass and width", "Gross", "net", "width", "x", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id int, label string")
    got = {r.id: r.metric for r in resolved_metrics(rows, "label", told).collect()}
    assert [got[i] for i in range(len(labels))] == ["cost", "thickness", "weight", None, "weight", None, "width", None, None, None]
    assert resolved_metrics(rows, "label", told.where("false")).count() == len(labels)
