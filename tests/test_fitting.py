"""Fitting into budgets by blocks of whole questions and by joins: both as the plain loop, the first without tables between its steps."""

import random

from evidentia.operators import budget as B
from evidentia.operators import fitting
from evidentia.sources import workspace

from .test_budget import NAMES, SCHEMA, case, plain


def test_small_questions_are_fitted_in_one_pass(spark, monkeypatch):
    """Rows of questions that a task can hold cost one table (of larger questions), not thirty; any block size gives the same."""
    rng = random.Random(8)
    cases = [case(rng, q) for q in range(60)]
    rows = spark.createDataFrame([r for c in cases for r in c], SCHEMA)
    made, write = [], workspace.written
    monkeypatch.setattr(workspace, "written", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(fitting, "BLOCK", 20)
    out = B.fit(rows, 40, 45, carry=("requirements",))
    got = {(r.query_id, r.id): (r.kept, r.step, r.reduced) for r in out.collect()}
    want = {}
    for q, c in enumerate(cases):
        step, reduced, _ = plain(c, [], 40, 45)
        want |= {(q, r[1]): (r[1] not in step, step.get(r[1]), r[1] in reduced) for r in c}
    assert got == want and len(made) <= 2
    assert sorted(map(tuple, B.requirement_coverage(rows, out).collect())) == sorted(map(tuple, B.requirement_coverage(rows, out.drop("requirements")).collect()))


def test_large_questions_go_by_joins(spark, monkeypatch):
    rng = random.Random(9)
    cases = [case(rng, q) for q in range(40)]
    lists = [(q, r[1], k, rng.choice([1, 2])) for q, c in enumerate(cases) for r in c if r[6] >= 10 for k in range(3)]
    rows = spark.createDataFrame([r for c in cases for r in c] + [(None, i, *[None] * (len(NAMES) - 2)) for i in range(8)], SCHEMA)
    members = spark.createDataFrame(lists, "query_id long, id long, place int, tokens int")
    found = []
    for whole in (6, 1000):
        monkeypatch.setattr(B, "WHOLE", whole)
        found.append(sorted(map(tuple, B.fit(rows, 40, 45, members).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == rows.count()


def test_odd_scores_and_units_by_both_ways(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(10)
    rows = [(1, i, rng.choice(["a", None, ""]), rng.choice([None, "x", ""]), rng.choice([None, "d"]), rng.choice([nan, inf, -inf, -0.0, 0.0, None, 1.0]), rng.randint(-3, 30), rng.choice([None, 40]), rng.choice([None, [], [None], ["r", "r", None], ["s"]]), rng.choice([None, True]), False, rng.random() < 0.2, None, rng.choice([None, -1, 0, 5])) for i in range(40)]
    rows = spark.createDataFrame(rows + [(2, *r[1:]) for r in rows[:5]], SCHEMA)
    found = []
    for whole in (0, 1000):
        monkeypatch.setattr(B, "WHOLE", whole)
        found.append([sorted(map(tuple, B.fit(rows, a, f).collect())) for a, f in ((200, 300), (0, 0))])
    assert found[0] == found[1]
