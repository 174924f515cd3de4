"""Fitting into budgets against a plain loop over one question's rows."""

import random

import pytest

from evidentia.operators import budget as B

SCHEMA = "query_id long, id long, `group` string, source string, document string, score double, tokens int, final_tokens int, requirements array<string>, factual boolean, listed boolean, mandatory boolean, conflict boolean, reduced_tokens int"
NAMES = [c.split()[0].strip("`") for c in SCHEMA.replace(", ", ",").split(",")]


def case(rng, q):
    """Rows of a question; groups of conflicts conflict as a whole."""
    out, sides = [], {g: rng.random() < 0.4 for g in "abc"}
    for i in range(rng.randint(1, 14)):
        group = rng.choice(["a", "b", "c", None, None, None])
        tokens = rng.choice([5, 10, 10, 25])
        out.append((q, i, group, rng.choice("xyz"), f"d{rng.randint(0, 3)}", rng.choice([None, 0.1, 0.5, 0.9]), tokens, tokens + rng.choice([0, 3]), rng.sample("rstuv", rng.choice([0, 0, 1, 2, 3])) or None, rng.random() < 0.8, rng.random() < 0.07, rng.random() < 0.07, bool(group) and sides[group], rng.choice([None, None, 2])))
    return out


def plain(rows, members, audit, final):
    rows = [dict(zip(NAMES, r)) for r in rows]
    for r in rows:
        r["score"], r["requirements"], r["unit"] = r["score"] or 0.0, set(r["requirements"] or ()), r["group"] or ("row", r["id"])
    long_ = lambda left, less=0: sum(r["tokens"] for r in left) - less > audit or sum(r["final_tokens"] for r in left) - less > final
    step, reduced, counts = {}, set(), {}
    if not long_(rows):
        return step, reduced, counts
    order, picked = sorted(rows, key=lambda r: (-r["score"], r["id"])), []
    todo = {k for r in rows if r["factual"] for k in r["requirements"]}
    while todo:
        best = max((r for r in order if r["factual"]), key=lambda r: len(r["requirements"] & todo))
        picked.append(best)
        todo -= best["requirements"]
    order = picked + [r for r in order if r not in picked]
    best = {}
    for r in order:
        key = (r["source"], r["document"] if r["mandatory"] else None, r["mandatory"])
        if r["factual"] and not r["listed"] and (key not in best or r["score"] > best[key]["score"]):
            best[key] = r
    reserved = {r["id"] for r in best.values()}
    left = list(order)

    def next_unit():
        units = {}
        for r in left:
            units.setdefault(r["unit"], []).append(r)
        last = sorted(units.values(), key=lambda u: -max(left.index(r) for r in u))
        bound = lambda u: any(r["listed"] or r["mandatory"] for r in u)
        clash = lambda u: any(r["conflict"] for r in u)
        own = lambda u: any(r["id"] in reserved for r in u)
        fact = lambda u: any(r["factual"] for r in u)
        needed = lambda u: any(not any(k in r["requirements"] for r in left if r not in u) for x in u for k in x["requirements"])
        spared = lambda u: len(units) == 1 or (fact(u) and not any(fact(v) for v in last if v is not u))
        for u in last:
            if not (bound(u) or clash(u) or own(u) or needed(u) or spared(u)):
                return "group", u
        for u in last:
            if len(u) == 1 and not (bound(u) or clash(u) or own(u) or spared(u)):
                return "cell", u
        for u in reversed(list(units.values())):
            if clash(u) and not bound(u) and not spared(u):
                return "conflict", u
        for u in last:
            if len(u) == 1 and own(u) and not (bound(u) or clash(u) or spared(u)) and not any(map(clash, last)):
                return "source", u
        return None

    while long_(left) and (found := next_unit()):
        for r in found[1]:
            step[r["id"]] = found[0]
            left.remove(r)
    less = 0
    for r in sorted(left, key=lambda r: (-r["tokens"], r["id"])):
        if long_(left, less) and r["reduced_tokens"] is not None and r["reduced_tokens"] < r["tokens"] and not r["conflict"]:
            reduced.add(r["id"])
            less += r["tokens"] - r["reduced_tokens"]
    lists = {r["id"]: [t for _, i, _, t in members if i == r["id"]] for r in left if r["id"] not in reduced}
    sizes = {i: len(x) for i, x in lists.items()}
    while long_(left, less) and any(len(x) > 1 for x in lists.values()):
        i = min((i for i in lists if len(lists[i]) > 1), key=lambda i: (-sum(lists[i]), i))
        less += lists[i].pop()
    return step, reduced, {i: len(x) for i, x in lists.items() if len(x) < sizes[i]}


@pytest.mark.parametrize("audit, final", [(60, 70), (25, 1000), (1000, 30)])
def test_fit_as_plain(spark, audit, final):
    rng = random.Random(audit)
    cases = [case(rng, q) for q in range(150)]
    lists = [[(q, r[1], k, rng.choice([1, 2])) for r in rows if r[6] >= 10 for k in range(rng.choice([0, 3, 5]))] for q, rows in enumerate(cases)]
    rows = spark.createDataFrame([r for c in cases for r in c], SCHEMA)
    members = spark.createDataFrame([m for c in lists for m in c], "query_id long, id long, place int, tokens int")
    out = B.fit(rows, audit, final, members)
    got = {(r.query_id, r.id): (r.kept, r.step, r.reduced, r.members_left) for r in out.collect()}
    want, seen = {}, set()
    for q, (c, m) in enumerate(zip(cases, lists)):
        step, reduced, counts = plain(c, m, audit, final)
        seen |= {*step.values(), *(["reduced"] if reduced else []), *(["members"] if counts else [])}
        want |= {(q, r[1]): (r[1] not in step, step.get(r[1]), r[1] in reduced, counts.get(r[1])) for r in c}
    assert got == want
    assert seen == {*B.STEPS, "reduced", "members"}
    left = {(r.query_id, r.requirement): (r.offered, r.kept, r.covered) for r in B.requirement_coverage(rows, out).collect()}
    for (q, name), found in left.items():
        own = [r[1] for r in cases[q] if name in (r[8] or ())]
        kept = sum(want[q, i][0] for i in own)
        assert found == (len(own), kept, kept > 0)


def test_fit_of_nothing_and_nulls(spark):
    assert B.fit(spark.createDataFrame([], SCHEMA), 10, 10).count() == 0
    rows = [(None, i, None, None, None, None, 8, None, [None], None, None, None, None, None) for i in (1, 2, 3)]
    out = {r.id: (r.kept, r.step) for r in B.fit(spark.createDataFrame(rows, SCHEMA), 16, 10).collect()}
    assert out == {1: (True, None), 2: (True, None), 3: (False, "group")}


def test_query_as_plain(spark):
    from evidentia import plans
    from evidentia.plans.evidence import offered_evidence
    from evidentia.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    asked = {}
    for r in offered_evidence(Tables(spark, folder)).select(*[n if n != "group" else "`group`" for n in NAMES]).collect():
        asked.setdefault(r.query_id, []).append((*r[:8], [k for k in r[8] if k], *r[9:]))
    want = {}
    for q, rows in asked.items():
        step, reduced, _ = plain(rows, [], 90, 98)
        want |= {(q, r[1]): (r[1] not in step, step.get(r[1]), r[1] in reduced) for r in rows}
    got = {(r.query_id, r.id): (r.kept, r.step, r.reduced) for r in plans.QUERIES["R14_budget_fit"](spark, folder).collect()}
    assert got == want and {v[1] for v in want.values()} == {None, *B.STEPS}
    counts = {}
    for q, rows in asked.items():
        for r in rows:
            for k in r[8]:
                counts.setdefault((q, k), []).append(want[q, r[1]][0])
    found = {(r.query_id, r.requirement): (r.offered, r.kept, r.covered) for r in plans.QUERIES["R14_requirement_coverage"](spark, folder).collect()}
    assert found == {k: (len(v), sum(v), any(v)) for k, v in counts.items()}
