"""Amounts, marks of units, and passages that become one, against hand-made cases."""

from pyspark.sql import functions as F

from evidentia.functions import values as V
from evidentia.operators.provenance import fingerprint, merged_passages

LONG = "The Same Passage of more than thirty-two letters, Straße"


def test_amounts(spark):
    texts = ["共 1,234.5 万元，(12) 亿；x7 3.5.2 -4元", "(5 and 6) or (-7)", "9" * 400, "", None, "价12万"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.amount_candidates(F.col("t")).alias("c")).collect()
    got = {r.i: [tuple(x) for x in r.c] for r in rows}
    assert got[0] == [("1,234.5 万元", 1234.5, "万元", 1e4, 12345000.0), ("(12) 亿", -12.0, "亿", 1e8, -12e8), ("3.5", 3.5, None, 1.0, None), ("-4元", -4.0, "元", 1.0, -4.0)]
    assert got[1] == got[2] == got[3] == got[4] == got[5] == []


def test_unit_marks(spark):
    texts = ["US$5 and us$ 7, usd, USD in Thousands; ¥3 ¥4 thousands", "人民币 亿元 億 元 million Millions", None, "usdx millionth"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.unit_marks(F.col("t")).alias("m")).collect()
    got = {r.i: [(x.kind, x.raw, x.currency, x.factor) for x in r.m] for r in rows}
    assert got[0] == [("currency", "US$", "USD", None), ("currency", "usd", "USD", None), ("currency", "$", None, None), ("currency", "¥", None, None), ("scale", "in Thousands", None, 1e3), ("scale", "thousands", None, 1e3)]
    assert got[1] == [("currency", "人民币", "CNY", None), ("scale", "million", None, 1e6), ("scale", "Millions", None, 1e6), ("scale", "亿元", None, 1e8), ("scale", "億 元", None, 1e8)]
    assert got[2] == got[3] == []
    many = spark.range(1).select(F.size(V.unit_marks(F.lit(" ".join(f"in{' ' * k}millions" for k in range(1, 30))))).alias("n"), F.size(V.unit_marks(F.lit(" ".join(f"in{' ' * k}millions" for k in range(1, 30))), None)).alias("all")).first()
    assert (many.n, many.all) == (16, 29)


def test_passages(spark):
    rows = [
        (1, 1, 5, LONG, "f", None, {"a": 1.0, "b": 2.0}, ["x", "y"]),
        (1, 2, 3, LONG.upper().replace("SS", "ß") + " !", "g", False, {"a": 3.0}, ["z", "x", None]),
        (1, 3, 9, LONG, "f", True, {"a": 9.0}, ["r"]),
        (1, 4, 10, LONG, "f", True, None, None),
        (1, 5, 10, LONG, "g", True, {}, []),
        (1, 6, 11, "short", "f", None, {"a": 1.0}, None),
        (1, 7, 12, "short", "f", None, None, ["s"]),
        (2, 8, 1, LONG, "f", None, {"c": 4.0}, ["x"]),
        (None, 9, None, None, None, None, None, None),
        (None, 10, None, LONG, None, None, None, None),
        (None, 11, None, LONG, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "query_id int, id int, place int, text string, document string, required boolean, goals map<string,double>, aspects array<string>")
    kept, members = merged_passages(frame)
    got = {(r.query_id, r.id): (r.n, r.goals, r.aspects) for r in kept.collect()}
    assert got == {
        (1, 2): (2, {"a": 3.0, "b": 2.0}, ["z", "x", "y"]), (1, 3): (2, {"a": 9.0}, ["r"]), (1, 5): (1, {}, []), (1, 6): (1, {"a": 1.0}, []), (1, 7): (1, {}, ["s"]),
        (2, 8): (1, {"c": 4.0}, ["x"]), (None, 9): (1, {}, []), (None, 10): (2, {}, []),
    }
    assert {(r.query_id, r.id): r.kept_id for r in members.collect()} == {(1, 1): 2, (1, 2): 2, (1, 3): 3, (1, 4): 3, (1, 5): 5, (1, 6): 6, (1, 7): 7, (2, 8): 8, (None, 9): 9, (None, 10): 10, (None, 11): 10}
    assert merged_passages(frame.limit(0))[0].count() == 0
    assert spark.range(1).select(fingerprint(F.lit("Ab 厚-ß1"))).first()[0] == "ab厚ss1"
