"""Audits, rules, orders, merges and packers on hand-made rows and against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.operators import audit as A
from evidentia.operators import greedy as G
from evidentia.operators import packing as K
from evidentia.operators import relations as L
from evidentia.operators import selection as S
from evidentia.operators import sheets as H


def test_numbers_need_their_evidence(spark):
    cited = "revenue=1,234.56 rate 12 percent page=7 A3='5' loss -40.25 2.345"
    cases = [
        ("revenue is 1234.56 or 1,234.6, rate 12%", []), ("the rate is 0.12 or 13%", ["0.12", "13%"]), ("revenue rate:\n1. first\n2) second (3) third", ["3"]),
        ("revenue rate:\n1. first\n2) second", []), ("see page 7 and row 3, not page 8, revenue", ["8"]), ("亏损 40.25 loss", []), ("亏损 40.3 loss", []), ("gain 40.25 loss", ["40.25"]),
        ("loss 2.35, 2.3, 2.4", ["2.4"]), ("revenue 最佳", []), ("nothing alike", []), (None, []), ("revenue 12 pour cent and 百分之12, 12％", []), ("第3行 revenue 第9页", ["9"]), ("1,234.560 loss 40.250", ["1,234.560", "40.250"]),
    ]
    rows = [(i, text, cited, []) for i, (text, _) in enumerate(cases)] + [(100, "revenue in report 2031.xlsx", cited, ["2031", "report 2031.xlsx"]), (101, None, None, None)]
    got = {r.id: r for r in A.support_audit(spark.createDataFrame(rows, "id long, answer string, evidence string, names array<string>")).collect()}
    assert [got[i].numbers for i in range(len(cases))] == [n for _, n in cases]  # half up; numbered items, pages and rows claim nothing
    assert got[0].passed and got[100].numbers == [] and got[9].promises == ["最佳"] and not got[9].passed
    assert not got[10].passed and got[10].overlap == 0 and tuple(got[101])[1:5] == (0, [], [], False)


def test_clauses_with_unsupported_numbers_go(spark):
    cases = [
        ("It costs twelve. It weighs 99 kg.", ["99"], "It costs twelve."), ("总额 12 元，占比 30%，合计 5 元。", ["30%"], "总额 12 元，合计 5 元。"), ("结论：1）增长 5%；2）成本 3 元；", ["5%"], "结论：成本 3 元；"),
        ("1,300 units", ["300"], ""), ("as it is 5", [], "as it is 5"), (None, ["5"], ""), ("a 1.5 b 5", ["5"], ""), ("a 1.5 b", ["5"], "a 1.5 b"),
        ("1. one\n3. three 77。\n4. four。", ["77"], None),
    ]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, answer string, numbers array<string>")
    got = {r.id: r.kept for r in frame.select("id", A.without_clauses(F.col("answer"), F.col("numbers")).alias("kept")).collect()}
    assert [got[i] for i, c in enumerate(cases) if c[2] is not None] == [c[2] for c in cases if c[2] is not None]
    assert "77" not in got[8] and "four" in got[8]


def test_support_audit_frame(spark):
    rows = spark.createDataFrame([(1, "the price is 12.3 now. It weighs 99 kg.", "price 12.26", ["x"]), (2, None, None, None)], "id long, answer string, evidence string, names array<string>")
    got = {r.id: (r.numbers, r.passed, r.kept) for r in A.support_audit(rows).collect()}
    assert got == {1: (["99"], False, "the price is 12.3 now."), 2: ([], False, "")}


@pytest.mark.parametrize(
    ("question", "text", "want"),
    [
        ("厚度是多少", "厚度 12 mm，宽 3 m", ["12 mm", "3 m"]), ("厚度是多少", "重 3 m", []), ("厚度是多少", "厚度十", []), ("what", "12 mm", None),
        ("比例和温度", "比例 1:3，温度 20℃", ["1:3", "20℃"]), ("比例和温度", "比例 1:3", []), (None, None, None), ("几天能干", "养护 7 天", ["7 天"]),
    ],
)
def test_values_of_a_dimension(spark, question, text, want):
    got = spark.createDataFrame([(question, text)], "q string, t string").select(A.dimension_values(F.col("q"), F.col("t")).alias("x")).first().x
    assert got == want


def test_a_continued_passage_is_joined(spark):
    rows = [(1, "厚度是多少", 1, 10, "d", "的厚度为 5 mm"), (1, "厚度是多少", 2, 11, "d", "喷涂于基层"), (1, "厚度是多少", 3, 12, "e", "厚度 9 mm"), (2, "厚度分别是多少", 1, 20, "d", "厚度 5 mm"), (2, "厚度分别是多少", 2, 21, "d", "厚度 5 mm、6 mm")]
    got = {r.query_id: (r.id, r.text) for r in A.numeric_passages(spark.createDataFrame(rows, "query_id int, question string, rank int, id int, document string, text string")).collect()}
    assert got == {1: (10, "喷涂于基层的厚度为 5 mm"), 2: (21, "厚度 5 mm、6 mm")}


def test_rules(spark):
    choice = "一体板采用点粘法还是条粘法，应依据什么条件选择"
    asked = "规范对基层和饰面有何要求"
    cases = [
        ("source", "石材防护施工", "", "石材防护方案", [], ["石材"], 32), ("rare_pairs", "石材防护", "石材与防护", "", ["石材", "防护", "材防"], [], 48),
        ("rare_characters", "问题，耐候胶缝", "耐候", "", ["耐", "候", "胶"], [], 80), ("rare_characters", "问题，耐候胶缝", "耐", "", ["耐", "候"], [], 0),
        ("phrases", "幕墙材料如何", "幕墙材料", "", [], [], 12 + 7 + 7), ("phrases", "多少材料板", "多少材料板", "", [], [], 12 + 7 + 7),
        ("subject", asked, "基层与饰面", "", [], [], 180), ("subject", asked, "基层", "", [], [], 35), ("subject", "x", "y", "", [], [], 0), ("subject", "外墙面砖的流程", "外墙的面砖", "", [], [], 180),
        ("precondition", "注胶前如何处理", "注胶缝应先清理，再注胶", "", [], [], 220), ("precondition", "注胶前如何处理", "注胶要先清理", "", [], [], 90), ("precondition", "注胶前如何处理", "石材先清理再", "", [], [], 0),
        ("choice", choice, "点粘法用于高度不大于24m，条粘法另行", "", [], [], 360), ("choice", choice, "点粘法与条粘法适用", "", [], [], 220), ("choice", choice, "点粘法适用", "", [], [], 0), ("choice", "x", "y", "", [], [], 0),
        ("form", "由哪些材料组成", "由石材、胶和保温层组成", "", [], [], 0.18), ("form", "如何检测平整度", "用靠尺检查平整度", "", [], [], 0.18), ("form", "x", "由a、b、cd和e组成", "", [], [], 0), ("form", "包括哪些", "主要有石材与胶条等，以及", "", [], [], 0.1),
        ("choice", None, None, None, None, [], 0), ("form", None, None, None, None, [], 0),
    ]
    for generic in ([], ["石材"]):
        own = [(i, c) for i, c in enumerate(cases) if c[5] == generic]
        frame = spark.createDataFrame([(i, c[1], i, c[2], c[3], None, c[4]) for i, c in own], "query_id long, question string, id long, text string, label string, heading string, rare array<string>")
        got = {r.id: r for r in S.rule_bonuses(frame, generic).collect()}
        for i, c in own:
            assert got[i][c[0]] == c[6], c


def test_rule_bonuses_with_rare_terms(spark):
    docs = spark.createDataFrame([(i, "石材普通" if i < 90 else "耐候胶") for i in range(100)], "id long, text string")
    q = spark.createDataFrame([(1, "石材耐候胶"), (2, "plain"), (3, None)], "query_id long, question string")
    rare = {r.query_id: set(r.rare) for r in S.rare_terms(q, docs).collect()}
    assert rare == {1: {"耐", "候", "胶", "耐候", "候胶"}, 2: set(), 3: set()}
    rows = q.join(S.rare_terms(q, docs), "query_id").select("query_id", "question", F.lit(7).cast("long").alias("id"), F.lit("耐候胶").alias("text"), F.lit("石材").alias("label"), F.lit("产品体系").alias("heading"), "rare")
    got = {r.query_id: r for r in S.rule_bonuses(rows, [], ["体系"]).collect()}
    assert (got[1].source, got[1].rare_pairs, got[1].rare_characters, got[1].phrases, got[1].overview) == (16, 48, 100, 7, 1)
    assert got[2].source == 0 and got[3].choice == 0


def plain_order(rows):
    """Chunks' first, last and middle windows; one of each group in turn; then others and indexes."""
    content = [r for r in rows if r["scope"] == "content"]
    chunks = defaultdict(list)
    for r in content:
        chunks[r["document"], r["chunk"]].append(r)
    seq = []
    for own in chunks.values():
        seq += own[:1] + (own[-1:] + own[1:-1] if len(own) > 1 else [])
    groups = defaultdict(list)
    for r in seq:
        groups[r["document"], r["grp"]].append(r)
    queues = [sorted(own, key=lambda r: r["historical"]) for own in groups.values()]
    out = [q[i] for i in range(max(map(len, queues), default=0)) for q in queues if i < len(q)]
    return [r["id"] for r in out + [r for r in rows if r["scope"] == "other"] + [r for r in rows if r["scope"] == "document_index"]]


def test_generation_order_and_trim(spark):
    rng, rows = random.Random(4), []
    for q in range(40):
        for i in range(rng.randint(1, 14)):
            rows.append({"query_id": q, "id": q * 100 + i, "rank": i + 1, "scope": rng.choice(["content", "content", "other", "document_index"]), "document": rng.choice("ab"), "chunk": rng.choice("xy"), "grp": rng.choice("gh"), "historical": rng.random() < 0.3, "tokens": rng.randint(1, 30)})
    frame = spark.createDataFrame(rows, "query_id long, id long, rank int, scope string, document string, chunk string, grp string, historical boolean, tokens long")
    got = defaultdict(list)
    for r in S.trimmed(S.generation_order(frame), 60).orderBy("query_id", "position").collect():
        got[r.query_id].append((r.id, r.kept))
    for q in range(40):
        own = [r for r in rows if r["query_id"] == q]
        order = plain_order(own)
        assert [i for i, _ in got[q]] == order
        by = {r["id"]: r for r in own}
        held = set()
        for doc in {r["document"] for r in own}:
            mine = [i for i in order if by[i]["document"] == doc]
            held.add(next((i for i in mine if by[i]["scope"] == "content"), mine[0]))
        kept = list(order)
        while sum(by[i]["tokens"] for i in kept) > 60 and set(kept) - held:
            kept.remove([i for i in kept if i not in held][-1])
        assert [i for i, k in got[q] if k] == kept


def test_merged_rounds(spark):
    rng = random.Random(9)
    old, new = [], []
    for q in range(30):
        ids = rng.sample(range(1, 12), rng.randint(0, 6))
        for n, i in enumerate(ids):
            old.append((q, n, f"u{rng.randint(0, 3)}", rng.choice("abc") + str(n), f"W{i}"))
        for n in range(rng.randint(0, 6)):
            prior = [r for r in old if r[0] == q]
            new.append((q, n, *(rng.choice(prior)[2:4] if prior and rng.random() < 0.4 else (f"u{rng.randint(0, 3)}", rng.choice("xyz")))))
    got = defaultdict(list)
    o = spark.createDataFrame(old, "query_id int, position int, url string, excerpt string, id string")
    for r in S.merged_rounds(o, spark.createDataFrame(new, "query_id int, position int, url string, excerpt string"), ["url", "excerpt"]).orderBy("query_id", "position").collect():
        got[r.query_id].append((r.id, r.url, r.excerpt, r["round"], r.previous))
    for q in range(30):
        own = [r for r in old if r[0] == q]
        known = {}
        for r in own:
            known.setdefault((r[2], r[3]), r[4])
        used, seen, want, n = {r[4] for r in own}, set(), [], 1
        for round_, key in [*((2, r[2:4]) for r in new if r[0] == q), *((1, r[2:4]) for r in own)]:
            if key in seen:
                continue
            seen.add(key)
            if key in known:
                want.append((known[key], *key, round_, None))
                continue
            while f"W{n}" in used:
                n += 1
            used.add(f"W{n}")
            before = sorted((int(r[4][1:]) for r in own if r[2] == key[0]))
            want.append((f"W{n}", *key, round_, ",".join(f"W{x}" for x in before) or None))
        assert got[q] == want


def test_preview(spark):
    rows = [(1, b, i, b * 10 + i, f"text {w} " + "x" * 50, ["text", w], [["b2"], ["none"]]) for b in (0, 1) for i, w in enumerate([f"a{b}", f"b{b + 1}", f"c{b}"])]
    frame = spark.createDataFrame(rows, "query_id long, bucket int, position int, id long, text string, terms array<string>, goals array<array<string>>")
    assert [r.id for r in S.preview(frame, limit=4, characters=1000).orderBy("position").collect()] == [11, 0, 10, 1]
    assert [r.id for r in S.preview(frame, limit=4, characters=130).orderBy("position").collect()] == [11, 0]
    assert S.preview(frame.where("false")).count() == 0


def test_aspects_are_recovered(spark):
    labelled = spark.createDataFrame([(1, ["fire", "test"], "Book"), (2, ["fireproof"], "Book"), (3, ["other"], "No")], "id long, labels array<string>, title string")
    docs = spark.createDataFrame([(1, "fire test book"), (2, "fireproof text"), (3, "other"), (4, "nothing")], "id long, text string")
    aspects = spark.createDataFrame([(7, "fire"), (8, "absent")], "query_id long, aspect string")
    more = {(r.aspect, r.expansion): r.score for r in S.aspect_expansions(aspects.select("aspect"), labelled).collect()}
    assert more == {("fire", "Book"): 6, ("fire", "test"): 2, ("fire", "fireproof"): 2}
    seen = spark.createDataFrame([(7, 1)], "query_id long, id long")
    assert [(r.query_id, r.id, r["rank"]) for r in S.aspect_recovery(aspects, labelled, docs, seen).collect()] == [(7, 2, 2)]


def test_packed_lines():
    lines = ["a" * 40, "b" * 90, "", "c" * 10, "d" * 10]
    for headers in ([], ["H" * 20, "I" * 40]):
        got = list(K.packed(lines, headers, 100, 50))
        top = "H" * 20 + "\n" + "I" * (29 - len(K.CUT_HEADER)) + K.CUT_HEADER if headers else ""
        assert all(t.startswith(top) for t, _ in got) and sorted({i for _, own in got for i in own}) == [0, 1, 2, 3, 4]
        body = "\n".join(t[len(top) :].removeprefix("\n") for t, _ in got)
        assert body.replace("\n", "") == "".join(lines)
        assert all(len(t) <= 100 or len(own) == 1 for t, own in got)
    assert list(K.packed([], ["x"])) == [] and list(K.packed(["x"], [])) == [("x", [0])]


def test_row_chunks(spark):
    rows = [(1, "[T]", 1, [("A", "name"), ("B", "x"), ("C", "1")]), (1, "[T]", 2, [("A", "12"), ("B", "y" * 30), ("C", "z" * 30), ("D", None), ("E", "e" * 400)])]
    frame = spark.createDataFrame(rows, "doc long, header string, row long, cells array<struct<col:string,value:string>>")
    out = K.row_chunks(frame, 40).orderBy("row", "part").collect()
    assert [(r.row, r.part, r.oversized) for r in out][:2] == [(1, 1, False), (2, 1, False)]
    assert out[1].text.startswith("[T]\n[ROW] A2='12' | B2='") and "[ABOVE] A1='name'" in out[1].text
    assert out[-1].oversized and all("A2='12'" in r.text for r in out[1:]) and all(r.tokens == G.estimate(r.text) for r in out)


def test_formulas_are_shared():
    row = "A1='1' formula='A1*2' | A2='2' formula='A2*2' | A3='3' formula='B9'"
    assert K.shared_formulas(row) == "A1='1' formula_template=F1 | A2='2' formula_template=F1 | A3='3' formula='B9'\n[FORMULA_TEMPLATES] F1: {cell}*2"
    assert K.shared_formulas("no formula") == "no formula"


def test_summary_packets_cover_all_text(spark):
    rows = [("d", i, i, f"s{i // 2}", "word " * n) for i, n in enumerate((10, 2000, 5, 0, 700))] + [("e", 0, 0, "s", None)]
    out = K.summary_packets(spark.createDataFrame(rows, "doc string, chunk long, ordinal int, section string, text string"), 300).collect()
    for _, chunk, _, _, text in rows[:-1]:
        spans = sorted((r.start, r.end) for r in out if r.chunk == chunk and r.doc == "d")
        assert (spans or [(0, 0)])[0][0] == 0 and (spans or [(0, 0)])[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    first = [r.section for r in sorted({(r.position, r.packet, r.section) for r in out}, key=lambda x: x[0]) for r in [type("R", (), {"section": r[2]})]]
    assert first[:3] == ["s0", "s1", "s2"] or len(set(first[:3])) >= 2


def test_directories(spark):
    rows = [("c", p, m, f"name {m}", "detail" if m % 2 else None, 5) for p in (1, 2) for m in range(5)]
    lists = K.compacted_directory(spark.createDataFrame(rows, "category string, packet int, member int, name string, detail string, expected long"))
    (r,) = lists.collect()
    assert (r.n, r.expected) == (5, 5) and r.text.split("\n")[:2] == ["name 0", "name 1；detail"]
    (t,) = K.trimmed_directory(lists, 8).collect()
    assert t.partial and t.n >= 1 and G.estimate("\n".join(r.text.split("\n")[: t.n])) <= 8 < G.estimate("\n".join(r.text.split("\n")[: t.n + 1]))


def test_statements(spark):
    cells = [(1, 1, 1, "title"), (1, 3, 1, "项目"), (1, 3, 2, "本期金额"), (1, 3, 3, "上期金额"), (1, 4, 1, "板 厚"), (1, 4, 2, "1,200"), (1, 4, 3, "(30)"), (1, 5, 1, "其他"), (1, 5, 2, "9"), (2, 1, 1, "x"), (3, 1, 1, "item"), (3, 1, 2, "2024年3月"), (3, 2, 1, "cost price"), (3, 2, 2, "7"), (3, 3, 1, "price"), (3, 3, 2, None)]
    out = sorted((r.doc, r.row, r.metric, r.role, r.period, r.value) for r in H.statement_facts(spark.createDataFrame(cells, "doc int, row int, col int, value string")).collect())
    assert [x[:4] + x[5:] for x in out] == [(1, 4, "thickness", "current", 1200.0), (1, 4, "thickness", "prior", -30.0), (3, 2, "cost", "current", 7.0)] and [x[4] for x in out] == [None, None, "2024-03"]


def test_text_facts(spark):
    rows = [(1, "2024年3月厚度12万元；去年同期(5)元。重量无；单价 3 亿元"), (2, None), (3, "去年同期 5 元")]
    out = [(r.id, r.metric, r.period, r.value) for r in H.text_facts(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("id", "clause").collect()]
    assert out == [(1, "thickness", "2024-03", 120000.0), (1, "thickness", "2024-02", -5.0), (1, "cost", "2024-03", 3e8)]


def test_empty_frames(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    cells = none("doc long, row int, col int, value string")
    for out in (H.headers(cells), H.sections(cells), H.statement_facts(cells), H.box_groups(none("page long, x0 double, y0 double, x1 double, y1 double")), S.rule_bonuses(none("query_id long, question string, id long, text string, label string, heading string, rare array<string>")), A.citations(none("answer int, evidence_id int, position int"), none("evidence_id int, ordinal int, document_name string, source_page int, sheet_name string, source_range string, section_heading string")), L.scope_notes(none("id int, scope string"), none("id int, url string, document string, page int"), none("note int"), none("note int, id int"), none("note int, id int"), none("id int"))):
        assert out.count() == 0


def test_regions_of_questions(spark):
    places = spark.createDataFrame([("山东省",), ("青岛市",), (None,), ("",)], "name string")
    q = spark.createDataFrame([(1, "山东的项目"), (2, "不含青岛 市的项目"), (3, "青岛市和山东省"), (4, None)], "query_id int, question string")
    assert sorted((r.query_id, r.region) for r in L.named_regions(q, places).collect()) == [(1, "山东"), (3, "山东"), (3, "青岛")]
