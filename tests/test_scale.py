"""What holds above the bounds: containment without products, ranks without whole groups, queries in blocks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import catalog, containment, evidence, ranks, relations, retrieval, selection


def plan(df):
    return df._jdf.queryExecution().toString()


TEXTS = [(1, "abcabc"), (2, ""), (3, None), (4, "岩棉 夹芯板,岩棉"), (5, "xx\nyy"), (6, "aaaa"), (7, "b"), (8, "the 😀 end"), (8, "twice abc")]
NAMES = ["abc", "abc", "", None, "岩棉", "夹芯板", "x\ny", "aa", "a", "b", "😀", "zzzz", "cab", "bc", "nd"]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_contained(spark, monkeypatch, bound):
    monkeypatch.setattr(containment, "NAME_BYTES", bound)
    texts, names = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string")
    out = containment.contained(texts, "id", "text", names, "name")
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted({(i, n) for i, t in TEXTS for n in NAMES if t and n and n in t}) and len(got) == len(set(got))
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out)
    for a, b in ((texts.where("false"), names), (texts, names.where("false"))):
        assert containment.contained(a, "id", "text", b, "name").count() == 0


def test_a_million_names(spark):
    """Above the automaton's bound: every text finds its own name, and no join is a product."""
    names = spark.range(1_000_000).select(F.concat(F.lit("name "), F.lpad(F.conv("id", 10, 36), 5, "0"), F.lit(" of")).alias("name"))
    texts = spark.range(0, 1_000_000, 20_000).select("id", F.concat(F.lit("seen: name "), F.lpad(F.conv("id", 10, 36), 5, "0"), F.lit(" of old")).alias("text"))
    out = containment.contained(texts, "id", "text", names, "name")
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out)
    got = out.join(texts, "id").where(F.contains("text", F.col("name")))
    assert got.count() == got.select("id").distinct().count() == 50


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_joins_by_containment(spark, monkeypatch, bound):
    monkeypatch.setattr(containment, "NAME_BYTES", bound)
    left = spark.createDataFrame([(1, "Acme Panels 12"), (2, "Other"), (3, "ACME-panels"), (4, "Zenith"), (5, None)], "id int, name string")
    right = spark.createDataFrame([(10, "acme panels"), (11, "Zenith Industries"), (12, "zenith indust"), (13, "panels 12 ab")], "match int, label string")
    assert sorted(map(tuple, catalog.fuzzy_matched(left, right).collect())) == [(1, 10, "contained"), (3, 10, "equal")]
    rules = spark.createDataFrame([(1, "th", "north"), (2, "er", "east"), (3, "", "else")], "ordinal int, marker string, location string")
    rows = spark.createDataFrame([("north",), ("other",), ("er",), ("x",), ("x",), (None,)], "name string")
    assert sorted(map(tuple, catalog.located(rows, rules, "name").collect()), key=repr) == sorted([("north", "north"), ("other", "north"), ("er", "east"), ("x", "else"), ("x", "else"), (None, None)], key=repr)
    texts = spark.createDataFrame([(1, "我要岩棉夹芯板"), (2, "岩棉"), (3, "a-b-c x")], "doc_id int, text string")
    names = spark.createDataFrame([(1, "岩棉夹芯板"), (2, "岩棉"), (3, "-b-c"), (4, "-b-c")], "name_id int, name string")
    assert sorted(map(tuple, catalog.mentions(texts, names).collect())) == [(1, 1), (3, 3), (3, 4)]
    lines = spark.createDataFrame([(1, 1, "- A1 (seen)"), (1, 2, "- A1 again"), (1, 3, "A1 and B2"), (2, 1, "B2")], "section int, position int, line string")
    out = evidence.canonical_listing(lines, spark.createDataFrame([("A1",), ("B2",)], "member string"))
    assert sorted(map(tuple, out.collect())) == [(1, "A1", 1), (2, "B2", 1)]
    places = spark.createDataFrame([("江苏省",), ("浙江省",)], "name string")
    asked = spark.createDataFrame([(1, "江苏的项目"), (2, "除 江苏 外 浙江省"), (3, None)], "query_id int, question string")
    out = relations.named_regions(asked, places)
    assert {tuple(r) for r in out.collect()} >= {(1, "江苏"), (2, "浙江")} and "NestedLoop" not in plan(out)
    labelled = spark.createDataFrame([(1, ["spring", "blue"], "T1"), (2, ["leaf", "green"], "T2")], "id int, labels array<string>, title string")
    out = selection.aspect_expansions(spark.createDataFrame([("ring",), ("green leaf",)], "aspect string"), labelled)
    assert {(r.aspect, r.expansion, r.score) for r in out.collect()} == {("ring", "blue", 2), ("ring", "spring", 2), ("ring", "T1", 3), ("green leaf", "leaf", 2), ("green leaf", "green", 2), ("green leaf", "T2", 3)}
    assert "NestedLoop" not in plan(out)


def test_ranks_are_those_of_a_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 17 == 0 else ["a", "b"][int(rng.integers(0, 2))], float(rng.integers(0, 50)), None if i % 13 == 0 else i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, grp string, score double, part int").repartition(6)
    for keys in (["grp"], ["grp", "part"], []):
        w = Window.partitionBy(*keys)
        want = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("n", F.count("*").over(w))
        got = ranks.ranked_within(df, keys, ["-score", "id"], total="n")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert "row_number" not in plan(got)
    assert ranks.ranked_within(df.where("false"), ["grp"], ["id"]).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)] + [(300, None), (301, [1.0])], "id int, vector array<double>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, retrieval.cosine_top(q, v, 7).collect()))
    monkeypatch.setattr(retrieval, "BATCH_BYTES", 2000)
    assert sorted(map(tuple, retrieval.cosine_top(q, v, 7).collect())) == whole and len(whole) == 700


def test_terms_of_any_number_score_windows(spark, monkeypatch):
    from evidentia.operators import catalog as C

    texts = [(i, f"panel p{i % 9} wool p{i % 4} panel-wool 岩棉板 p{i}") for i in range(60)]
    w, q = spark.createDataFrame(texts, "window_id int, text string"), spark.createDataFrame([(1, "p3 wool"), (2, "岩棉 p4 p17"), (3, "none")], "query_id int, text string")
    whole = sorted(map(tuple, retrieval.window_scores(q, w).collect()))
    assert {r[0] for r in whole} == {1, 2}
    monkeypatch.setattr(C.sized_broadcast, "__defaults__", (0,))
    assert sorted(map(tuple, retrieval.window_scores(q, w).collect())) == whole
