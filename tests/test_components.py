"""Components by rounds of two shuffles each."""

import random

from evidentia.operators import components as C
from evidentia.operators import greedy as G
from evidentia.sources import workspace


def test_a_round_is_two_shuffles(spark, monkeypatch):
    rng = random.Random(11)
    links = [(q, rng.randrange(60), rng.randrange(60)) for q in (1, 2) for _ in range(50)] + [(3, i, i + 1) for i in range(50)] + [(4, 0, i) for i in range(30)] * 2 + [(5, 1, 1), (5, None, 2), (None, 1, 2)]
    plans, write = [], workspace.written
    monkeypatch.setattr(workspace, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    out = C.components(spark.createDataFrame(links, "q int, a int, b int"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for q, a, b in links:
        if None not in (q, a, b) and a != b:
            low, high = sorted((root((q, a)), root((q, b))))
            up[high] = low
    want = [(*x, root(x)[1]) for x in list(up)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plans = [p.split("== Initial Plan ==")[-1] for p in plans]
    assert len(plans) > 2 and all(p.count("Exchange ") <= 2 and "Join" not in p for p in plans)


def test_nulls_link_nothing(spark):
    rows = [(1, 5, 10), (1, 6, 10), (1, 7, None), (1, 8, None), (1, None, 10), (None, 3, 1), (None, 4, 1), (1, 6, 11), (1, 9, 11), (1, 5, 10)]
    out = G.conflict_components(spark.createDataFrame(rows, "query_id int, group_id int, evidence_id int"))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, 5, 5), (1, 6, 5), (1, 9, 5), (1, 7, 7), (1, 8, 8), (1, None, None), (None, 3, 3), (None, 4, 4)], key=repr)
