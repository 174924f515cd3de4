"""What tasks do and hold as tables grow: pairs in blocks, and tasks of a stated number of rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.operators import greedy, packing, relations, retrieval, spread
from evidentia.sources import markup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_node_assets_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK", 3)
    nodes = spark.createDataFrame([(i, ["A", "B"][i % 2], "ring" if i % 3 else "bolt", None if i % 5 == 0 else "m", "public" if i % 7 else "internal") for i in range(40)] + [(1, "B", "ring", "m", "public")], "asset long, form string, kind string, method string, scope string")
    asked = [(i, ["A"] if i % 2 else [], ["ring", "bolt"] if i % 3 else ["bolt"], ["m"] if i % 5 == 0 else []) for i in range(20)] + [(3, [], ["ring"], []), (4, [], [], []), (None, [], ["bolt"], [])]
    questions = spark.createDataFrame(asked, "query_id long, forms array<string>, kinds array<string>, methods array<string>")
    excluded = spark.createDataFrame([(8,)], "asset long")
    out = relations.node_assets(questions, nodes, excluded)
    held = [r for r in nodes.collect() if r.scope == "public" and r.asset != 8]
    want = {(q, r.asset) for q, forms, kinds, methods in asked for r in held if r.kind in kinds and (not forms or r.form in forms) and (not methods or r.method in methods)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Generate explode(r" in plan(out)  # pairs come of blocks, and aren't shuffled


def test_scope_notes_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK", 2)
    rows = spark.createDataFrame([(i, "internal" if i % 9 == 8 else "public") for i in range(30)], "id long, scope string")
    sources = [(i, f"u{i % 3}" if i % 2 else None, "d" if i % 4 else None, i % 2) for i in range(26)] + [(5, "u0", None, None), (7, "u0", None, None), (7, "u1", None, None)]
    references = spark.createDataFrame(sources, "id long, url string, document string, page int")
    targets = [(n, n * 2 % 30) for n in range(20)] + [(3, 7), (3, 5), (11, 28)]
    frame = lambda x: spark.createDataFrame(x, "note long, id long")
    public = spark.createDataFrame([(i,) for i in range(30) if i % 6 != 5], "id long")
    out = relations.scope_notes(rows, references, spark.createDataFrame([(n,) for n in range(19)], "note long"), frame(targets), frame([(4, 5), (6, 1)]), public)
    keys = {}
    for i, url, document, page in sources:
        if url or (document and page is not None):
            keys.setdefault(i, set()).add(url or (document, page))
    good = [(n, i) for n, i in targets if n < 19 and n != 4 and i % 6 != 5]
    want = {(i, n) for i in range(30) if i % 9 != 8 for n, j in good if i == j or keys.get(i, set()) & keys.get(j, set())}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Generate explode(r" in plan(out)


@pytest.mark.parametrize("held", [100, 30, 0])
def test_pairs_with_a_side_that_tasks_hold(spark, monkeypatch, held):
    """By a join where the side is small, in blocks where it isn't: the same pairs, also of rows that are equal or without a value."""
    monkeypatch.setattr(spread, "HELD", held)
    left = [((i % 3, [f"x{i % 2}"]), i % 50) for i in range(90)] + [(None, 1), ((0, ["x0"]), None), ((9, []), 2)]
    right = [((i % 3, [f"x{i % 2}"]), f"q{i}") for i in range(31)] + [(None, "q"), ((1, ["x1"]), None), ((1, ["x1"]), None), ((8, []), "r")]
    kind = "p struct<n: int, w: array<string>>, "
    out = spread.matched(spark.createDataFrame(left, kind + "a long"), spark.createDataFrame(right, kind + "b string"), "p", "a", "b")
    assert Counter(map(tuple, out.collect())) == Counter((a, b) for k, a in left for m, b in right if k is not None and k == m)
    assert ("Generate explode" in plan(out)) == (held < 100)
    assert spread.matched(spark.createDataFrame(left, kind + "a long"), spark.createDataFrame([], kind + "b string"), "p", "a", "b").count() == 0


def test_questions_that_ask_once_are_joined(spark):
    out = plans.QUERIES["J19_node_assets"](spark, FOLDER)
    assert "_k" in plan(out)  # a join by a number of what they ask, whose pairs are written without a list


FOLDER = "/root/testdata/sf0.001"


def dealt(spark, name):
    """Whether a query's work is dealt out by a stated number of rows."""
    return "REPARTITION_BY_NUM" in plan(plans.QUERIES[name](spark, FOLDER))


def test_lines_are_dealt_out_by_rows(spark):
    assert dealt(spark, "F25_source_compaction") and dealt(spark, "R03_rule_bonuses")
    text = "[TABLE id=x]\n[COLUMNS] A=p | B=q | C=r\n[ROW source=s;row:1] A1='1' | C1='2'\n[COLUMNS] D=z"
    rows = spark.createDataFrame([(text,), ("[COLUMNS] A=p",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(packing.narrowed(F.col("t"))).collect()] == ["[TABLE id=x]\n[COLUMNS] A=p | C=r\n[ROW] A1='1' | C1='2'\n[COLUMNS] D=z", "[COLUMNS] A=p", "", None]


def test_wide_facts_read_their_table_once(spark):
    assert plan(plans.QUERIES["D07_wide_facts"](spark, FOLDER)).count("FileScan") == 1


def test_xml_is_dealt_out_by_rows(spark):
    assert dealt(spark, "S11_xml_scan")
    docs = spark.createDataFrame([(1, "<t><r k='1'>x</r><r><a>1</a><a>2</a></r></t>"), (2, "<t>"), (3, None)], "id int, x string")
    assert [tuple(r) for r in markup.xml_scan(docs, "id", "x").collect()] == [(1, "t/r", 1, "@k", "1"), (1, "t/r", 1, "#text", "x"), (1, "t/r", 2, "a", "1 | 2"), (1, "t/r/a", 1, "#text", "1"), (1, "t/r/a", 2, "#text", "2")]


def test_row_facts_are_dealt_out_by_rows(spark):
    assert dealt(spark, "D12_row_facts")


def test_citations_are_dealt_out_by_rows(spark):
    assert dealt(spark, "D26_citations")


def test_violations_are_dealt_out_by_rows(spark):
    assert dealt(spark, "D27_pack_violations")


def test_header_contexts_read_cells_and_merges_once(spark):
    assert plan(plans.QUERIES["W08_header_context"](spark, FOLDER)).count("FileScan") == 2


def test_windows_are_handed_on_before_a_batch_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a bc. def " * (30 * i)) for i in range(9)] + [(9, None)], "doc_id long, text string").coalesce(1)
    whole = [tuple(r) for r in greedy.windows(docs, 40, 8).collect()]
    monkeypatch.setattr(greedy, "HELD", 100)
    assert [tuple(r) for r in greedy.windows(docs, 40, 8).collect()] == whole and len(whole) > 20


def test_places_of_terms_are_counted_in_the_vocabulary(spark, monkeypatch):
    names, write = [], retrieval.workspace.written
    monkeypatch.setattr(retrieval.workspace, "written", lambda df, name: names.append(name) or write(df, name))
    texts = ["aa aaa xaax there he 岩棉板 岩棉岩棉 岩", "HE/aa 岩 棉 岩棉", "a-a-a", "", None, "other he"]
    windows = spark.createDataFrame(list(enumerate(texts)), "window_id int, text string")
    queries = spark.createDataFrame([(1, "aa he"), (2, "岩棉板 a-a-a the")], "query_id int, text string")
    out = {(r.query_id, r.window_id): r.score for r in retrieval.window_scores(queries, windows).collect()}
    own = {0: {"aa", "he", "岩棉", "棉板", "岩棉板"}, 1: {"岩棉"}, 2: {"a-a-a"}, 5: {"he"}}
    df, want = Counter(t for terms in own.values() for t in terms), {}
    for q, terms in ((1, {"aa", "he"}), (2, {"岩棉板", "岩棉", "棉板", "a-a-a"})):
        for w, held in own.items():
            parts = [math.log(1 + 7 / (df[t] + 1)) * (1 + c / (c + 1.5)) for t in terms & held for c in [texts[w].lower().count(t)]]
            want |= {(q, w): round(sum(parts), 9)} if parts else {}
    assert out == pytest.approx(want) and "tokens" in names


def plain_chunks(rows, budget):
    """D02 a row at a time."""
    import re

    out, tables = [], {}
    for doc, header, row, cells in sorted(rows, key=lambda r: r[2]):
        above = tables.setdefault(doc, {})
        shown = {c: f"{c}{row}='{v}'" for c, v in cells if v is not None}
        first = list(shown)[:2] if len(shown) > 2 else []
        text = lambda group, first=first, shown=shown, header=header: f"{header}\n[ROW] " + " | ".join(shown[c] for c in dict.fromkeys([*first, *group]))
        groups = [[]]
        for c in shown:
            if groups[-1] and greedy.estimate(text([*groups[-1], c])) > budget:
                groups.append([])
            groups[-1].append(c)
        for n, group in enumerate(filter(None, groups), 1):
            body = text(group)
            near = [above[c] for c in dict.fromkeys([*first, *group]) if c in above]
            full = body + "\n[ABOVE] " + " | ".join(near) if near else body
            body = full if greedy.estimate(full) <= budget else body
            out.append((doc, row, n, body, greedy.estimate(body), greedy.estimate(body) > budget))
        above.update({c: shown[c] for c, v in cells if v and len(v) <= 100 and not re.fullmatch(r"[\d.,/ -]+", v)})
    return out


@pytest.mark.parametrize("dealt", [False, True])
def test_row_chunks_equal_a_plain_loop(spark, monkeypatch, dealt):
    """Tables over several batches, columns named twice, odd signs, long headers and rows without cells."""
    import random

    import pyarrow as pa

    from evidentia.operators import rowchunks

    types = pa.schema([("doc", pa.int64()), ("header", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.struct([("col", pa.string()), ("value", pa.string())])))])
    rng = random.Random(8)
    words = ["", "x", "岩棉板 a", "12", "1,200.5", "٣٤", "a.b-c/d%e", "a..b.", ".a", "é_1", "long word " * 9, "y" * 101, "\u00a0\u2003q", "😀 z", "a\nb", "%", "it's | x", None]
    rows = []
    for doc in [None, *range(12)]:
        for row in rng.sample(range(1, 10**6), rng.choice((1, 3, 40, 400))):
            n = rng.choice((0, 1, 2, 3, 5, 9))
            names = [rng.choice("ABC") for _ in range(n)] if rng.random() < 0.2 else rng.sample(["A", "B", "C", "岩", "E9", "F", "", "a.b", "H", "I"], n)
            rows.append((doc, rng.choice(("[T]", f"[TABLE id={doc}]\n[COLUMNS] A=x", "标题-1", "", "h/")), row, [(c, rng.choice(words)) for c in names]))
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    monkeypatch.setattr(rowchunks, "HELD", 500)
    try:
        frame = spark.createDataFrame(rows, "doc long, header string, row long, cells array<struct<col: string, value: string>>")
        for budget in (9, 30, 44, 384):
            got = sorted((tuple(r) for r in packing.row_chunks(frame.repartition(3, "doc") if dealt else frame, budget, dealt).collect()), key=repr)
            assert got == sorted(plain_chunks(rows, budget), key=repr)
            # texts are handed on in small parts
            ordered = pa.Table.from_pylist([{"doc": d, "header": h, "row": r, "cells": [{"col": c, "value": v} for c, v in cells]} for d, h, r, cells in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))], schema=types)
            parts = list(rowchunks.chunked(ordered.to_batches(max_chunksize=50), budget))
            assert max(p.num_rows for p in parts) < 50 and sorted((tuple(r.values()) for p in parts for r in p.to_pylist()), key=repr) == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)


def test_row_chunks_deal_lines_out_once(spark):
    text = plan(plans.QUERIES["D02_table_row_chunks"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in text and text.count("Exchange ") == 1
