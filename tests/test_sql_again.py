"""Queries against their SQL on rows that the smallest tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query over frames by table's name, the others being the smallest ones, and of its SQL over the same tables."""

    def run(name, **frames):
        con = duckdb.connect()
        for table in ("documents", "benchmark", "embeddings", "lineitem", "orders", "customer", "supplier", "part"):
            path = f"{tmp_path}/{table}.parquet"
            (frames[table] if table in frames else spark.read.parquet(f"{FOLDER}/{table}.parquet")).write.parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        got = plans.QUERIES[name](spark, str(tmp_path))
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({plans.SQL[name]})").fetchall()
        return sorted(map(tuple, got.select(*names).collect()), key=repr), sorted(want, key=repr)

    return run


def test_all_projects_get_a_product(spark, both):
    got, want = both("J22_nearest_product")
    assert got == want
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4)).distinct().count()
    assert len({r[1] for r in got}) == rows


def test_units_end_before_other_letters(spark, both):
    texts = ["token 5 ciónosl", "token 5 cios", "token 5 kgs", "token 5 ab_", "the 5 einä", "token 5 MMä", "token 55e6é"]
    frame = spark.createDataFrame([(i, s, "en", "src2", len(s)) for i, s in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = both("D14_relation_tags", documents=frame)
    assert got == want and len({r[1] for r in got}) == 2


def test_lines_with_equal_ids_stay_apart(spark, both):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(1).drop("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    keys = spark.createDataFrame([(7, 1, 1_000_005, 20.0), (7, 2, 5, 20.0), (7, 3, 5, 60.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    got, want = both("R25_budget_expansion", lineitem=lines.crossJoin(keys))
    assert got == want and len(got) == 3


def test_row_of_a_text_with_line_ends(spark, both):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("item_id % 20 = 0").orderBy("item_id").first()["text"]
    words = item.split()[:6]
    texts = [" ".join(words) + " x", f"{words[0]}\n{' '.join(words[1:])}\r\n'end' not\nonly", f"q\r{' '.join(words)}"]
    frame = spark.createDataFrame([(i, s, "de", "src1", len(s)) for i, s in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = both("R23_ordered_context", documents=frame)
    assert want and got == want


def test_scores_of_many_queries_take_little_memory():
    """A task holds a tile of scores, not those of all queries; ties go by id."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from evidentia.operators import retrieval

    v = np.random.default_rng(1).integers(-2, 3, (20_000, 4)).astype(float)
    v[::7] = v[1]
    q = retrieval._unit(v[:2000])
    tracemalloc.start()
    got = {}
    for batch in retrieval.tiles(pa.array(range(20_000)), v, pa.array(range(2000)), q, 5):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6  # all scores of the batch are 320 MB
    for k in range(0, 2000, 100):
        score = np.round(retrieval._unit(v) @ q[k], 9)
        assert [i for _, i in sorted(got[k])] == [i for _, i in sorted(zip(-score, range(20_000), strict=True))[:5]]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_signs_are_counted_once(spark):
    text = plan(plans.QUERIES["F11_language_candidates"](spark, FOLDER))
    assert 0 < text.count(r"[\x{0590}-\x{05ff}]") <= 2


def test_languages_of_odd_texts(spark, both):
    """Cue words beside other letters and marks, texts with other scripts, and letters that aren't ASCII alone."""
    texts = ["ofé", "éyear x", "the_x", "thé and", "the\u0301 x", "año total1", "xſtatement", " ſtatement", "1ſ", "XſTATEMENT", "ſtatements", "é", "ß 1", "привет the", "岩棉板 report 岩棉", "岩total棉", "かな x", "", " ", "12 %", None, "a\nof\u00a0b", "q\x00the", "😀date😀", "ªof", "Ⅳfor"]
    frame = spark.createDataFrame([(i, s, "en", "src2", len(s or "")) for i, s in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = both("F11_language_candidates", documents=frame)
    assert got == want and len({r[0] for r in got}) == 2


@pytest.mark.parametrize("name", ["D02_table_row_chunks", "D03_context_packing", "D19_summary_packets"])
def test_documents_cost_no_call_of_their_own(spark, name):
    assert "flatmapgroupsinpandas" not in plan(plans.QUERIES[name](spark, FOLDER))


def test_rows_without_a_document_are_one(spark):
    from evidentia.operators import packing

    cells = [("A", "x"), ("B", "1"), ("C", "y")]
    rows = spark.createDataFrame([(None, "h", 1, cells), (2**60 + 1, "h", 1, cells), (None, "h", 2, cells)], "doc long, header string, row long, cells array<struct<col: string, value: string>>")
    got = sorted(((r.doc, r.row, "[ABOVE]" in r.text) for r in packing.row_chunks(rows).collect()), key=repr)
    assert got == [(2**60 + 1, 1, False), (None, 1, False), (None, 2, True)]


def test_periods_of_lines_equal_a_plain_search():
    import numpy as np

    from evidentia.operators import greedy

    def plain(h, n):
        for s in range(len(h)):
            for p in range(3, 41):
                if s + 3 * p <= len(h) and h[s : s + p] == h[s + p : s + 2 * p] == h[s + 2 * p : s + 3 * p] and sum(n[s : s + p]) >= 240 and len(set(h)) < len(h) - 5:
                    return p
        return None

    rng, seen = np.random.default_rng(3), set()
    for _ in range(300):
        block = list(rng.integers(0, 4, rng.integers(3, 9)))
        h = [int(x) for x in [*rng.integers(0, 9, rng.integers(0, 8)), *block * int(rng.integers(1, 5)), *rng.integers(0, 9, 4)]]
        n = [20 + 15 * x for x in h]
        want = plain(h, n)
        assert greedy._period(np.array(h), np.array(n)) == want
        seen.add(want)
    assert len(seen) > 3


def test_alike_names_leave_few_candidates(spark, both, monkeypatch):
    """Names over the automaton's bound that share all short grams: still the SQL's rows, also where several share a name or an id."""
    from evidentia.operators import containment

    monkeypatch.setattr(containment, "NAME_BYTES", 10)
    customers = [(i, f"Customer#{i:09d}") for i in range(300)] + [(400, "Customer#000000399 x"), (401, "xCustomer#000000500"), (402, "short"), (403, "Customer#0000005"), (404, None), (405, "Customer#000000007"), (406, "Customer#000000399x"), (406, "none of these")]
    suppliers = [(i, f"Supplier#{i:09d}") for i in range(200, 520)] + [(600, "Supplier#000000399"), (601, "Supplier#000000210"), (602, None)]
    got, want = both("J06_fuzzy_catalogue", customer=spark.createDataFrame(customers, "c_custkey long, c_name string"), supplier=spark.createDataFrame(suppliers, "s_suppkey long, s_name string"))
    assert got == want and {r[0] for r in got} == {"equal", "contained"}
    names = spark.createDataFrame([(f"customer{i:09d}",) for i in range(500)], "name string")
    sizes = []
    monkeypatch.setattr(containment, "_grams", lambda text, n, f=containment._grams: (sizes.append(n), f(text, n))[1])
    assert containment.contained(names, "name", "name", names.withColumnRenamed("name", "n"), "n").count() == 500
    assert min(sizes) == 16
