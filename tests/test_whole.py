"""Queries take whole tables: the same rows under other ids give the same results."""

import pytest
from pyspark.sql import functions as F

from evidentia import plans

FOLDER = "/root/testdata/sf0.001"
FAR = 1_000_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The smallest tables with all order keys raised by FAR."""
    path = str(tmp_path_factory.mktemp("far"))
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    rows.withColumn("l_orderkey", F.col("l_orderkey") + FAR).write.parquet(f"{path}/lineitem.parquet")
    spark.read.parquet(f"{FOLDER}/supplier.parquet").write.parquet(f"{path}/supplier.parquet")
    return path


@pytest.mark.parametrize(
    ("name", "key"),
    [("R12_budgeted_windows", "query_id"), ("R14_group_eviction", "query_id"), ("R24_coverage_first", "query_id"), ("R32_primary_visuals", "case_id"), ("F27_canonical_listing", "section"), ("A11_conflict_components", None)],
)
def test_order_keys_are_not_cut(spark, far, name, key):
    near, moved = plans.QUERIES[name](spark, FOLDER), plans.QUERIES[name](spark, far)
    if key:
        moved = moved.withColumn(key, F.col(key) - FAR)
    want = sorted(map(tuple, near.collect()))
    assert want and sorted(map(tuple, moved.select(*near.columns).collect())) == want


def test_conflict_components_of_all_edges(spark):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey").collect()
    label = {(s % 7, p): p for s, p, _ in rows}
    edges = {}
    for s, p, o in rows:
        edges.setdefault((s % 7, o), set()).add(p)
    while True:
        before = dict(label)
        for (q, _), parts in edges.items():
            least = min(label[q, p] for p in parts)
            label |= {(q, p): least for p in parts}
        if label == before:
            break
    got = {(r.query_id, r.group_id): r.component for r in plans.QUERIES["A11_conflict_components"](spark, FOLDER).collect()}
    assert got == label


def test_cycles_anywhere_in_a_document(spark, tmp_path):
    lines = lambda name, n, width: "".join(f"{name} line {i} {'x' * width}\n" for i in range(n))
    rows = [
        (1, lines("late", 20, 60) + lines("block", 4, 70) * 3 + "end"), (3, lines("b", 3, 75) * 3), (2, lines("b", 3, 75) * 2),
        (4, lines("short", 3, 2) * 3), (5, "y" * 1000), (7, "z " * 400), (6, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["A26_cycles"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.period) for r in got) == [(1, 4), (3, 3)]
