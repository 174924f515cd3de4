"""Operators over groups of any size against plain versions; none leaves its work to one task a group."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from evidentia.functions import nested
from evidentia.operators import greedy as G
from evidentia.operators import sheets as H


def plan(df):
    return df._jdf.queryExecution().toString()


def test_conflict_components(spark):
    rng = random.Random(3)
    edges = [(q, rng.randrange(120), rng.randrange(1000, 1130)) for q in (1, 2) for _ in range(130)] + [(3, i, 2000 + i) for i in range(40)] + [(3, i + 1, 2000 + i) for i in range(40)] + [(4, 7, 1), (5, 1, 1), (5, 1, 1)]
    out = G.conflict_components(spark.createDataFrame(edges, "query_id long, group_id long, evidence_id long"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for q, g, e in edges:
        a, b = sorted((root((q, 0, g)), root((q, 1, e))))
        up[b] = a
    want = {(q, g): root((q, 0, g))[2] for q, g, _ in edges}
    assert {(r.query_id, r.group_id): r.component for r in out.collect()} == want and "Pandas" not in plan(out)
    assert G.conflict_components(spark.createDataFrame([], "query_id long, group_id long, evidence_id long")).count() == 0


def test_set_cover(spark):
    rng = random.Random(4)
    edges = [(q, rng.randrange(30), rng.randrange(25)) for q in range(3) for _ in range(60)]
    out = G.set_cover(spark.createDataFrame(edges, "query_id long, evidence_id long, requirement_id long"), 6)
    want = []
    for q in range(3):
        sets = defaultdict(set)
        for p, e, r in edges:
            if p == q:
                sets[e].add(r)
        left = set().union(*sets.values())
        for n in range(1, 7):
            e = min(sets, key=lambda e: (-len(sets[e] & left), e))
            if not sets[e] & left:
                break
            want.append((q, e, n, len(sets[e] & left)))
            left -= sets[e]
    assert sorted(map(tuple, out.collect())) == sorted(want) and "Pandas" not in plan(out)
    assert G.set_cover(spark.createDataFrame([], "query_id long, evidence_id long, requirement_id long"), 3).count() == 0


def test_packets_of_a_large_category(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("a" if i % 3 else None, i, "x" * rng.choice((0, 1, 2, 5, 9, 40))) for i in range(700)] + [("one", 1, "y" * 99)]
    monkeypatch.setattr(G, "BLOCK", 50)
    out = G.directory_packets(spark.createDataFrame(rows, "category string, member long, text string"), 12)
    want = {}
    for c in ("a", None, "one"):
        packet = used = 0
        for _, m, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if used and used + len(t) + 1 > 12:
                packet, used = packet + 1, 0
            used += len(t) + 1
            want[c, m] = packet
    assert {(r.category, r.member): r.packet for r in out.collect()} == want and "Pandas" not in plan(out)


def test_records_without_their_keys(spark):
    rows = spark.createDataFrame([(1, '{"a":"x","b":null}'), (2, '{"b":"q","a":"y"}'), (3, '{"c":1}')], "id int, record string")
    got = sorted((r.columns, r.id, r["values"], r.n_records) for r in nested.factored(rows).collect())
    assert got == [("a,b", 1, ["x", None], 2), ("a,b", 2, ["y", "q"], 2), ("c", 3, ["1"], 1)]


def test_headers_are_carried_down(spark):
    cells = [
        (1, 1, 1, "Report"), (1, 2, 2, "2024年"), (1, 3, 2, "单位 kg"), (1, 3, 3, "price"), (1, 4, 1, "steel"), (1, 4, 2, "12.5"), (1, 4, 3, " "), (1, 5, 1, "Second"),
        (1, 6, 1, "wood"), (1, 6, 2, "1,200 mm"), (1, 6, 3, "x"), (1, 7, 2, "a"), (1, 8, 2, "b"), (1, 9, 2, "c"), (1, 9, 3, "n" * 221), (1, 10, 2, "7%"), (1, 10, 3, "y"), (2, 1, 1, "alone"), (2, 2, 1, "5"), (2, 3, 1, None),
    ]
    merges = [(1, 1, 1, 3), (1, 2, 2, 3), (1, 5, 1, 3), (1, 5, 1, 2)]
    out = H.table_contexts(spark.createDataFrame(cells, "doc int, row int, col int, value string"), spark.createDataFrame(merges, "doc int, row int, col int, end int"))
    assert {(r.doc, r.row, r.col): (r.section, r.headers) for r in out.collect()} == {
        (1, 4, 1): ("Report", ""), (1, 4, 2): ("Report", "2024年 / 单位 kg"), (1, 6, 1): ("Second", ""), (1, 6, 2): ("Second", "2024年"), (1, 6, 3): ("Second", "2024年 / price"),
        (1, 10, 2): ("Second", "a / b / c"), (1, 10, 3): ("Second", "2024年 / price"), (2, 2, 1): ("", "alone"),
    }


def test_facts_of_wide_tables(spark):
    cells = [
        (1, 1, 1, "Title"), (1, 2, 1, "月份"), (1, 2, 2, "板厚"), (1, 2, 3, "备注"), (1, 2, 4, "单价"), (1, 3, 1, "2024-01"), (1, 3, 2, "12"), (1, 3, 3, "9"), (1, 3, 4, ""), (1, 4, 1, "合计"), (1, 4, 2, "5"),
        (1, 5, 1, "月 份"), (1, 5, 2, "3"), (1, 6, 1, "2024年2月"), (1, 6, 4, "(7)"), (1, 6, 2, "none"), (2, 1, 1, "板厚"), (2, 2, 1, "5"),
    ]
    out = H.wide_facts(spark.createDataFrame(cells, "doc int, row int, col int, value string"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 2, "thickness", "板厚", "2024-01", 12.0), (1, 2, 6, 4, "cost", "单价", "2024-02", -7.0)]
    assert H.wide_facts(spark.createDataFrame([], "doc int, row int, col int, value string")).count() == 0


def test_whole_texts_are_previewed(spark):
    from evidentia import plans

    assert plans.QUERIES["R22_preview_selection"](spark, "/root/testdata/sf0.001").where(F.col("id").isNotNull()).count() > 0
