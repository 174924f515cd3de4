"""Queries of tables, audits, ranking rules and relations (inventory A, D, F, J, P, R, T, U, W) over the driver's tables.

The tables hold no Han text; where an operator reads it, digits of their columns are written as Han signs (``han``).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import packing as K
from ..operators import relations as L
from ..operators import selection as S
from ..operators import sheets as H
from ..operators.catalog import sized_broadcast
from ..operators.spread import spread
from .registry import Tables, query
from .signs import SIGNS

_SIGNS = SIGNS


def han(*parts: str) -> Column:
    return F.concat(*(F.translate(F.col(p).cast("string"), "0123456789", _SIGNS) for p in parts))


def _han(*parts: str) -> str:
    return " || ".join(f"translate({p}::VARCHAR, '0123456789', '{_SIGNS}')" for p in parts)


def _lines(t: Tables, *more: Column):
    """One row an order's line number: the smallest flag, status and part, and the largest quantity."""
    lines = spread(t.lineitem, t.lineitem, "l_orderkey", each=100_000)
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"), F.max("l_quantity").alias("q"))


_LINES = "SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_partkey) AS p, min(l_suppkey) AS u, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _cells(rows, *cells: tuple[int, Column]):
    """(doc, row, col, value) of rows (doc, row, ...): a cell for each (column, value)."""
    return rows.select("doc", "row", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in cells))).alias("c")).select("doc", "row", "c.col", "c.value")


# tables

_SHEET = f"SELECT l_orderkey AS doc, 2 * l_linenumber + u % 2 AS row, f, p FROM ({_LINES})"


def _sheet(t: Tables):
    return _lines(t).select(F.col("l_orderkey").alias("doc"), (2 * F.col("l_linenumber") + F.col("u") % 2).alias("row"), "f", F.col("p").cast("string").alias("p"))


@query("W13_table_split", f"""WITH r AS (SELECT doc, row, f = 'R' AS head, f = 'A' AS title, coalesce(row - lag(row) OVER w > 1, false) AS gap FROM ({_SHEET}) WINDOW w AS (PARTITION BY doc ORDER BY row)),
 a AS (SELECT *, coalesce(lag(title) OVER w, false) AS below, coalesce(lag(gap) OVER w, false) AS apart, min(CASE WHEN head THEN row END) OVER (PARTITION BY doc) AS first FROM r WINDOW w AS (PARTITION BY doc ORDER BY row)),
 b AS (SELECT *, head AND row > first AND (gap OR (below AND apart)) AS starts FROM a), c AS (SELECT *, (starts AND NOT below) OR (coalesce(lead(starts) OVER w, false) AND title) AS begins FROM b WINDOW w AS (PARTITION BY doc ORDER BY row))
 SELECT doc, row, 1 + sum(begins::INT) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section FROM c""")
def table_split(t: Tables):
    """Lines as rows of a sheet: returned ones head a table (an item and an amount), accepted ones are titles of one cell."""
    head, title = F.col("f") == "R", F.col("f") == "A"
    return H.sections(_cells(_sheet(t), (1, F.when(head, "项目").otherwise(F.col("p"))), (2, F.when(head, "金额").when(~title, F.col("f")))))


_GRID = "SELECT l_orderkey AS doc, l_linenumber AS row, min(l_suppkey) % 3 + 1 AS col, min(l_suppkey) % 3 + 1 + min(l_partkey) % 3 AS last, CASE WHEN max(l_quantity) > 22 THEN max(l_quantity)::BIGINT || ' mm' WHEN min(l_partkey) % 4 = 0 THEN '宽 ' || min(l_returnflag) || ' kg' ELSE min(l_returnflag) || min(l_linestatus) END AS value, max(l_quantity) > 22 AS data FROM lineitem GROUP BY ALL"


@query("W08_header_context", f"""WITH RECURSIVE g AS ({_GRID}), w AS (SELECT doc, greatest(max(CASE WHEN data THEN col ELSE last END), max(col)) AS width FROM g GROUP BY doc), k AS (SELECT g.*, width, row_number() OVER (PARTITION BY doc ORDER BY row) AS i, NOT data AND col = 1 AND last = width AND width > 1 AS whole FROM g JOIN w USING (doc)),
 f AS (SELECT doc, c, 0::BIGINT AS i, '' AS section, []::VARCHAR[] AS h, '' AS s0, []::VARCHAR[] AS h0 FROM w, (SELECT unnest(range(1, 6)) AS c) WHERE c <= width
 UNION ALL SELECT f.doc, f.c, k.i, CASE WHEN whole THEN value ELSE section END, CASE WHEN whole THEN list_filter(h, lambda x: NOT contains(x, 'kg')) WHEN NOT data AND c BETWEEN col AND last THEN list_concat(h, [value])[-3:] ELSE h END, section, h FROM f JOIN k ON k.doc = f.doc AND k.i = f.i + 1)
 SELECT k.doc, k.row, k.col, s0 AS section, array_to_string(h0, ' / ') AS headers FROM k JOIN f ON f.doc = k.doc AND f.i = k.i AND f.c = k.col WHERE data""")
def header_context(t: Tables):
    """Each order as a sheet of a cell a line: large quantities are data, other lines headers over up to three columns, some with a unit."""
    g = spread(t.lineitem, t.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row")).agg((F.min("l_suppkey") % 3 + 1).alias("col"), F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    value = F.when(F.col("q") > 22, F.concat(F.col("q").cast("long"), F.lit(" mm"))).when(F.col("p") % 4 == 0, F.concat(F.lit("宽 "), "f", F.lit(" kg"))).otherwise(F.concat("f", "s"))
    merges = g.where("q <= 22").select("doc", "row", "col", (F.col("col") + F.col("p") % 3).alias("end"))
    return H.table_contexts(g.select("doc", "row", "col", value.alias("value")), merges, like=t.lineitem)


@query("D07_wide_facts", """WITH r AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey AS k, o_orderdate AS d FROM orders), x AS (SELECT *, k % 9 = 4 AS again, sum((k % 9 = 4)::INT) OVER (PARTITION BY doc ORDER BY row) + 1 AS section FROM r)
 SELECT doc, section::BIGINT AS section, row, c AS col, CASE WHEN c = doc % 2 + 2 THEN 'thickness' ELSE 'cost' END AS metric, CASE WHEN c = doc % 2 + 2 THEN '板厚' ELSE '单价' END AS label, strftime(d, '%Y-%m') AS period, CASE WHEN c = doc % 2 + 2 THEN k % 1000 ELSE k % 77 END::DOUBLE AS value
 FROM x, (SELECT unnest([2, 3, 4]) AS c) WHERE NOT again AND k % 5 <> 0 AND (c = doc % 2 + 2 OR (c = 4 AND k % 4 <> 1))""")
def wide_facts(t: Tables):
    """Each customer's orders as a wide table whose columns stand in another order by customer: a month, a thickness, a remark and a price.
    Some rows repeat the header, some have no month, some no price."""
    k, swap = F.col("o_orderkey"), F.col("doc") % 2 == 1
    r = spread(t.orders, t.orders, "o_custkey", each=100_000).withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("doc", F.col("o_custkey"))
    month = F.when(k % 9 == 4, "月 份").when(k % 5 == 0, "合计").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    thick, note, price = (k % 1000).cast("string"), F.when(k % 2 == 0, "7 days").otherwise("12"), F.when(k % 4 == 1, F.lit(" ")).otherwise((k % 77).cast("string"))
    cells = lambda row, *values: [F.struct(row.alias("row"), F.lit(i).alias("col"), v.alias("value")) for i, v in enumerate(values, 1)]
    body = cells(F.col("row"), month, F.when(swap, note).otherwise(thick), F.when(swap, thick).otherwise(note), price)
    head = cells(F.lit(0), F.lit("月份"), F.when(swap, "备注").otherwise("板厚"), F.when(swap, "板厚").otherwise("备注"), F.lit("单价"))
    # a document's rows stay in the task that numbered them
    return H.wide_facts(r.select("doc", F.explode(F.when(F.col("row") == 1, F.array(*head, *body)).otherwise(F.array(*body))).alias("c")).select("doc", "c.*"))


@query("D32_header_inference", f"WITH r AS (SELECT doc, row, f, p, row_number() OVER (PARTITION BY doc ORDER BY row) AS n FROM ({_SHEET})), k AS (SELECT *, CASE f WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS tier FROM r WHERE n <= 30), b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tier, row) AS i FROM k WHERE tier IS NOT NULL) SELECT doc, row, CASE f WHEN 'R' THEN '厚度|宽度' ELSE '备注|x' || p END AS labels FROM b WHERE i = 1")
def header_inference(t: Tables):
    """Returned lines have two metrics, accepted ones two texts, others a text and a number (half of them texts: no header)."""
    first = F.when(F.col("f") == "R", "厚度").when(F.col("f") == "A", "备注").otherwise("y")
    second = F.when(F.col("f") == "R", "宽度").when(F.col("f") == "A", F.concat(F.lit("x"), "p")).otherwise(F.col("p"))
    return H.headers(_cells(_sheet(t), (1, first), (2, second)))


@query("D08_statement_facts", "SELECT p_partkey AS doc, 2 AS row, CASE p_size % 3 WHEN 0 THEN 'thickness' WHEN 1 THEN 'weight' ELSE 'cost' END AS metric, role, CASE role WHEN 'current' THEN '2024' ELSE '2023' END AS period, CASE role WHEN 'current' THEN p_size::DOUBLE ELSE (p_partkey % 1000)::DOUBLE END AS value FROM part, (SELECT unnest(['current', 'prior']) AS role) WHERE p_size % 7 <> 0 OR role = 'prior'")
def statement_facts(t: Tables):
    """Each part as a statement: a header with two dated columns (or amounts by name), a metric with its two values, an unknown item."""
    p = t.part.select(F.col("p_partkey").alias("doc"), "p_size", "p_partkey")
    named = F.when(F.col("p_size") % 3 == 0, "板厚").when(F.col("p_size") % 3 == 1, "重 量").otherwise("单价（元）" if False else "单价")
    odd = F.col("p_partkey") % 2 == 1
    head = p.select("doc", F.lit(1).alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in ((1, F.lit("项目")), (2, F.when(odd, "2024年").otherwise("2024年本期金额")), (3, F.lit("附注")), (4, F.when(odd, "2023年").otherwise("2023年 上期金额"))))) ).alias("c")).select("doc", "row", "c.*")
    value = F.when(F.col("p_size") % 7 == 0, "其中").otherwise(F.col("p_size").cast("string"))
    body = p.select("doc", F.lit(2).alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in ((1, named), (2, value), (4, (F.col("p_partkey") % 1000).cast("string")))))).alias("c")).select("doc", "row", "c.*")
    other = p.select("doc", F.lit(3).alias("row"), F.lit(1).alias("col"), F.lit("其他").alias("value"))
    return H.statement_facts(head.unionByName(body).unionByName(other))


@query("D09_free_text_facts", "SELECT p_partkey AS id, clause, metric, period, value, unit FROM (SELECT p_partkey, p_size, unnest([{'clause': 1, 'metric': 'thickness', 'period': '2024-03', 'value': p_size * 10000.0, 'unit': 'yuan'}, {'clause': 2, 'metric': 'thickness', 'period': '2024-02', 'value': p_size + 1.0, 'unit': 'yuan'}, {'clause': 4, 'metric': 'cost', 'period': '2024-03', 'value': NULL, 'unit': 'unknown'}]) AS x FROM part), (SELECT 1) WHERE true".replace("SELECT p_partkey AS id, clause, metric, period, value, unit", "SELECT p_partkey AS id, x.clause, x.metric, x.period, x.value::DOUBLE AS value, x.unit"))
def free_text_facts(t: Tables):
    text = F.concat(F.lit("2024年3月，厚度 "), F.col("p_size").cast("string"), F.lit(" 万元，去年同期 "), (F.col("p_size") + 1).cast("string"), F.lit(" 元；完。单价 "), F.col("p_size").cast("string"), F.lit(" 件"))
    return H.text_facts(t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("D11_fact_validation", f"WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS fact, f AS metric, CASE WHEN s = 'O' THEN NULL ELSE '2024' END AS period, CASE WHEN q < 10 THEN NULL ELSE q END AS value FROM ({_LINES})) SELECT doc, fact, 'duplicate_fact' AS issue FROM (SELECT *, row_number() OVER (PARTITION BY doc, metric, coalesce(period, '') ORDER BY fact) AS n FROM r) WHERE n > 1 UNION ALL SELECT doc, fact, 'invalid_amount' FROM r WHERE value IS NULL UNION ALL SELECT doc, fact, 'period_missing' FROM r WHERE period IS NULL")
def fact_validation(t: Tables):
    return H.fact_issues(_lines(t).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("fact"), F.col("f").alias("metric"), F.when(F.col("s") != "O", "2024").alias("period"), F.when(F.col("q") >= 10, F.col("q")).alias("value")))


@query("A24_table_synopsis", f"""WITH r AS ({_LINES}), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, CASE WHEN s = 'O' THEN 3 ELSE 2 END AS hi FROM r)
 SELECT l_orderkey AS doc, count(*) AS n_rows, max(hi)::BIGINT AS n_columns, count(CASE WHEN f = 'R' THEN 1 END)::BIGINT AS formulas, concat_ws(':', min(l_linenumber), 1, max(l_linenumber), max(hi)) AS range, string_agg('1=' || p || ' | 2=' || u || CASE WHEN s = 'O' THEN ' | 3=' || f ELSE '' END, chr(10) ORDER BY l_linenumber) FILTER (WHERE n <= 3) AS samples FROM n GROUP BY l_orderkey""")
def table_synopsis(t: Tables):
    rows = _lines(t).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row"), "f", "s", F.col("p").cast("string").alias("p"), F.col("u").cast("string").alias("u"))
    cell = lambda c, v, formula=None: F.struct(F.lit(c).alias("col"), v.alias("value"), (formula if formula is not None else F.lit(None).cast("string")).alias("formula"))
    cells = F.filter(F.array(cell(1, F.col("p")), cell(2, F.col("u"), F.when(F.col("f") == "R", F.concat(F.lit("=A"), F.col("row").cast("string")))), cell(3, F.when(F.col("s") == "O", F.col("f")))), lambda c: c["value"].isNotNull())
    return H.synopsis(rows.select("doc", "row", F.explode(cells).alias("c")).select("doc", "row", "c.col", "c.value", "c.formula"))


_BOXES = "SELECT l_orderkey AS page, (l_partkey % 90) / 100.0::DOUBLE AS x0, (l_suppkey % 70) / 100.0::DOUBLE AS y0, (l_partkey % 90) / 100.0::DOUBLE + l_quantity / 100.0::DOUBLE AS x1, (l_suppkey % 70) / 100.0::DOUBLE + (l_linenumber + 1) / 20.0::DOUBLE AS y1 FROM lineitem"


@query("W19_box_islands", f"""WITH e AS (SELECT * FROM ({_BOXES}) WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) BETWEEN 0.005 AND 0.9 AND greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) <= 8),
 a AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e), b AS (SELECT *, sum((top IS NULL OR x0 >= top)::INT) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS col FROM a),
 c AS (SELECT * EXCLUDE (top), max(y1) OVER (PARTITION BY page, col ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b), d AS (SELECT *, sum((top IS NULL OR y0 >= top)::INT) OVER (PARTITION BY page, col ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM c),
 l AS (SELECT page, col, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM d GROUP BY ALL) SELECT page, col::BIGINT AS column, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(n)::BIGINT AS n, string_agg(n::VARCHAR, ',' ORDER BY line) AS row_counts FROM l GROUP BY page, col""")
def box_islands(t: Tables):
    x0, y0 = F.col("l_partkey") % 90 / 100.0, F.col("l_suppkey") % 70 / 100.0
    return H.box_groups(t.lineitem.select(F.col("l_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") / 100.0).alias("x1"), (y0 + (F.col("l_linenumber") + 1) / 20.0).alias("y1")))


# chunks and packets


@query("D02_table_row_chunks")
def table_row_chunks(t: Tables):
    """Each order as a table; a small budget makes groups of cells."""
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"))
    cells = F.array(cell("A", F.col("p")), cell("B", F.col("u")), cell("C", F.col("f")), cell("D", F.col("s")), cell("E", F.col("q")), cell("F", F.concat("f", "s")))
    rows = _lines(t).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("row"), F.concat(F.lit("[TABLE id="), F.col("l_orderkey").cast("string"), F.lit("]\n[COLUMNS] A=part | B=supplier")).alias("header"), cells.alias("cells"))
    # lines are dealt out by order, their table
    return K.row_chunks(rows, 44, dealt=True)


def _documents(t: Tables):
    """A document a customer: blocks are its orders, its table their lines."""
    own = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    blocks = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("position"), F.lit("paragraph").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.concat_ws(" ", "o_orderpriority", F.col("o_totalprice").cast("string"))).alias("text"))
    rows = _lines(t).join(own, "l_orderkey").select("doc", F.col("l_orderkey").cast("string").alias("tab"), F.col("l_linenumber").alias("row"), "p", "u")
    cells = rows.select("doc", "tab", "row", F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("p").cast("string").alias("value")), F.struct(F.lit(2).alias("col"), F.col("u").cast("string").alias("value")))).alias("c")).select("doc", "tab", "row", "c.col", "c.value", F.lit(False).alias("header"))
    heads = rows.select("doc", "tab").distinct().select("doc", "tab", F.lit(0).alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("col"), F.lit("part").alias("value")), F.struct(F.lit(2).alias("col"), F.lit("supplier").alias("value")))).alias("c")).select("doc", "tab", "row", "c.col", "c.value", F.lit(True).alias("header"))
    return t.customer.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name")), blocks, cells.unionByName(heads)


@query("D03_context_packing")
def context_packing(t: Tables):
    """Lines of each document packed in small chunks, so that table headers repeat."""
    return K.context_chunks(K.model_lines(*_documents(t)), 160, 60)


@query("D04_model_chunks", f"""WITH own AS (SELECT o_orderkey AS l_orderkey, o_custkey AS doc FROM orders), r AS (SELECT doc, l_orderkey::VARCHAR AS tab, l_linenumber AS row FROM ({_LINES}) JOIN own USING (l_orderkey)),
 l AS (SELECT c_custkey AS doc, 'index' AS part, false AS header, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT doc, 'index', false, count(DISTINCT tab) FROM r GROUP BY doc UNION ALL SELECT o_custkey, 'evidence', false, count(*) FROM orders GROUP BY ALL UNION ALL SELECT doc, 'table-' || tab, true, 2 FROM r GROUP BY doc, tab UNION ALL SELECT doc, 'table-' || tab, false, count(*) FROM r GROUP BY doc, tab)
 SELECT doc, part, header, sum(n)::BIGINT AS n FROM l GROUP BY doc, part, header""")
def model_chunks(t: Tables):
    return K.model_lines(*_documents(t)).groupBy("doc", "part", "header").agg(F.count("*").alias("n"))


@query("D18_directory_trim", "WITH m AS (SELECT c_nationkey || ':' || c_mktsegment AS category, c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '；' || c_mktsegment ELSE '' END AS line FROM customer) SELECT category, count(*) AS n, count(*) AS expected, string_agg(line, chr(10) ORDER BY c_custkey) AS text FROM m GROUP BY category")
def directory_trim(t: Tables):
    """Packets of customers by nation and segment, each listed twice, as one list a category."""
    category = F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment")
    rows = t.customer.select(category.alias("category"), F.explode(F.array(F.lit(1), F.lit(2))).alias("packet"), F.col("c_custkey").alias("member"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("detail"))
    return K.compacted_directory(rows.withColumn("expected", F.count("*").over(Window.partitionBy("category", "packet"))))


@query("D19_summary_packets")
def summary_packets(t: Tables):
    """Documents as chunks of 2,000 characters, three a section."""
    rows = t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,2000}"), F.lit(0))).alias("ordinal", "text"))
    return K.summary_packets(rows.select("doc", F.col("ordinal").cast("long").alias("chunk"), "ordinal", F.concat(F.lit("s"), F.floor(F.col("ordinal") / 3).cast("string")).alias("section"), "text"), 600)


@query("F25_source_compaction", f"SELECT l_orderkey, l_linenumber, '[TABLE id=x]' || chr(10) || '[COLUMNS] A=part | B=supplier' || CASE WHEN s = 'O' THEN ' | D=state' ELSE '' END || chr(10) || '[ROW] A' || l_linenumber || '=''' || p || ''' | B' || l_linenumber || '=''' || u || '''' || CASE WHEN s = 'O' THEN ' | D' || l_linenumber || '=''O''' ELSE '' END AS text FROM ({_LINES})")
def source_compaction(t: Tables):
    n = F.col("l_linenumber").cast("string")
    cell = lambda c, v: F.concat(F.lit(c), n, F.lit("='"), v, F.lit("'"))
    state = F.when(F.col("s") == "O", F.concat(F.lit(" | "), cell("D", F.lit("O")))).otherwise("")
    text = F.concat(F.lit("[TABLE id=x]\n[COLUMNS] A=part | B=supplier | C=date | D=state\n[ROW source=sheet:x;row:"), n, F.lit("] "), cell("A", F.col("p").cast("string")), F.lit(" | "), cell("B", F.col("u").cast("string")), state)
    return _lines(t).select("l_orderkey", "l_linenumber", K.narrowed(text).alias("text"))


# audits and citations


def _answers(t: Tables):
    """Each assistant turn with the turn before it in its conversation as evidence."""
    rows = t.conversations.withColumn("evidence", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), "evidence", F.array().cast("array<string>").alias("names"))


@query("D23_support_audit")
def support_audit(t: Tables):
    return A.support_audit(_answers(t)).select("id", "overlap", F.size("numbers").alias("n_numbers"), F.size("promises").alias("n_promises"), "passed")


@query("D24_clause_filter")
def clause_filter(t: Tables):
    return A.support_audit(_answers(t)).select("id", "kept")


@query("D25_citation_contract", """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), e AS (SELECT l_orderkey, bool_and(l_partkey IN (SELECT l_partkey FROM c WHERE c.l_orderkey = l.l_orderkey)) AS ok FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l GROUP BY l_orderkey)
 SELECT o_orderkey AS answer, aspect, CASE WHEN aspect = 0 AND e.ok THEN 'covered' WHEN aspect = 1 AND o_orderkey % 3 = 0 THEN 'missing' ELSE 'unaccounted' END AS state FROM orders JOIN (SELECT unnest([0, 1]) AS aspect) a ON true LEFT JOIN e ON o_orderkey = l_orderkey""")
def citation_contract(t: Tables):
    """Aspect 0 quotes the order's priority and cites its parts; aspect 1 says that evidence is missing, in words the answer has for every third order."""
    answers = t.orders.select(F.col("o_orderkey").alias("answer"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, " no evidence").otherwise("")).alias("reply"), F.substring("o_orderpriority", 1, 5).alias("said"))
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("answer")).agg(F.collect_set("l_partkey").alias("evidence"))
    first = answers.join(parts, "answer").select("answer", F.lit(0).alias("aspect"), F.lit(1).alias("position"), F.col("said").alias("quote"), F.lit("answered").alias("status"), "evidence")
    second = answers.select("answer", F.lit(1).alias("aspect"), F.lit(1).alias("position"), F.lit("no evidence").alias("quote"), F.lit("evidence_missing").alias("status"), F.array().cast("array<bigint>").alias("evidence"))
    cited = t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("evidence_id"))
    return A.coverage_contract(answers.select("answer", F.explode(F.array(F.lit(0), F.lit(1))).alias("aspect")), first.unionByName(second), answers.select("answer", "reply"), cited)


@query("D26_citations", """WITH q AS (SELECT l_suppkey AS answer, l_partkey AS evidence_id, min(l_orderkey * 1000000 + l_partkey) AS position FROM lineitem GROUP BY ALL), f AS (SELECT p_partkey AS evidence_id, o AS ordinal, p_brand AS document_name, CASE WHEN o < 3 THEN p_size % 5 END AS source_page, CASE WHEN o = 3 THEN 's' || p_size % 2 END AS sheet_name, NULL::VARCHAR AS source_range, p_type AS section_heading FROM part, (SELECT unnest([1, 2, 3]) AS o)),
 j AS (SELECT *, row_number() OVER (PARTITION BY answer, evidence_id, document_name, source_page, sheet_name, source_range, section_heading ORDER BY position, ordinal) AS k FROM q JOIN f USING (evidence_id)) SELECT answer, row_number() OVER (PARTITION BY answer ORDER BY position, ordinal) AS n, evidence_id, document_name, source_page, sheet_name, source_range, section_heading FROM j WHERE k = 1""")
def citation_rows(t: Tables):
    requests = spread(t.lineitem, t.lineitem, "l_partkey").groupBy(F.col("l_suppkey").alias("answer"), F.col("l_partkey").alias("evidence_id")).agg(F.min(F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("position"))
    o = F.col("ordinal")
    references = t.part.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ordinal")).select(F.col("p_partkey").alias("evidence_id"), "ordinal", F.col("p_brand").alias("document_name"), F.when(o < 3, F.col("p_size") % 5).alias("source_page"), F.when(o == 3, F.concat(F.lit("s"), (F.col("p_size") % 2).cast("string"))).alias("sheet_name"), F.lit(None).cast("string").alias("source_range"), F.col("p_type").alias("section_heading"))
    return A.citations(requests, references, like=t.lineitem)


@query("D33_source_locations", """WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), j AS (SELECT l_orderkey, p_size AS page, p_brand AS sheet, p_type AS heading, min(i) AS i FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM r) JOIN part ON l_partkey = p_partkey WHERE p_size <= 12 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS n FROM j)
 SELECT o_orderkey AS chunk, coalesce(n, 1) AS n, page, sheet, NULL::VARCHAR AS range, CASE WHEN n IS NULL THEN o_orderkey::VARCHAR ELSE heading END AS heading FROM orders LEFT JOIN (SELECT * FROM k WHERE n <= 3) k ON o_orderkey = l_orderkey""")
def source_locations(t: Tables):
    refs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    chunks = t.orders.join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("chunk"), F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"))
    places = t.part.where("p_size <= 12").select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("page"), F.col("p_brand").alias("sheet"), F.lit(None).cast("string").alias("range"), F.col("p_type").alias("heading"))
    return A.located_citations(chunks, places, 3)


_QUESTION = "CASE p_size % 3 WHEN 0 THEN '厚度是多少' WHEN 1 THEN '养护期多少天' ELSE '比例分别多少' END"
_PASSAGE = "CASE p_partkey % 4 WHEN 0 THEN '厚度 ' || p_size || ' mm' WHEN 1 THEN '养护期 ' || p_size || '天' WHEN 2 THEN '比例 ' || p_size || '% 和 1:3' ELSE '宽度 ' || p_size || ' mm' END"


def _passages(t: Tables):
    n = F.col("p_size").cast("string")
    question = F.when(F.col("p_size") % 3 == 0, "厚度是多少").when(F.col("p_size") % 3 == 1, "养护期多少天").otherwise("比例分别多少")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("厚度 "), n, F.lit(" mm"))).when(k == 1, F.concat(F.lit("养护期 "), n, F.lit("天"))).when(k == 2, F.concat(F.lit("比例 "), n, F.lit("% 和 1:3"))).otherwise(F.concat(F.lit("宽度 "), n, F.lit(" mm")))
    return t.part.select("p_partkey", "p_brand", "p_size", question.alias("question"), text.alias("text"))


@query("P15_numeric_dimension", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 4 = 0 THEN p_size || ' mm' WHEN p_size % 3 = 1 AND p_partkey % 4 = 1 THEN p_size || '天' WHEN p_size % 3 = 2 AND p_partkey % 4 = 2 THEN p_size || '%|1:3' ELSE '' END AS found FROM part")
def numeric_dimension(t: Tables):
    return _passages(t).select("p_partkey", F.array_join(A.dimension_values(F.col("question"), F.col("text")), "|").alias("found"))


@query("D36_numeric_passage", f"SELECT p_brand || ':' || p_size AS query_id, min(p_partkey) AS id, min_by(text, p_partkey) AS text FROM (SELECT *, {_PASSAGE} AS text FROM part) WHERE (p_size % 3 = 0 AND p_partkey % 4 = 0) OR (p_size % 3 = 1 AND p_partkey % 4 = 1) OR (p_size % 3 = 2 AND p_partkey % 4 = 2) GROUP BY 1")
def numeric_passage(t: Tables):
    rows = _passages(t).select(F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("query_id"), "question", F.col("p_partkey").alias("rank"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("document"), "text")
    return A.numeric_passages(rows)


# ranking rules and orders


@query("R03_rule_bonuses")
def rule_bonuses(t: Tables):
    """Lines of orders: the order's number is the question, part and supplier are the text."""
    rows = _lines(t).select(F.col("l_orderkey").alias("query_id"), han("l_orderkey").alias("question"), F.col("l_linenumber").cast("long").alias("id"), F.concat(han("p"), F.lit("，"), han("u")).alias("text"), han("u").alias("label"), F.lit("").alias("heading"))
    rare = S.rare_terms(rows.select("query_id", "question").distinct(), t.part.select(F.col("p_partkey").alias("id"), han("p_partkey").alias("text")))
    return S.rule_bonuses(rows.join(rare, "query_id"), ["厚度"])


@query("R10_product_match", f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'code' WHEN 1 THEN CASE WHEN length(p_partkey::VARCHAR) > 1 THEN 'variant' END WHEN 2 THEN 'name' WHEN 3 THEN CASE WHEN length(p_partkey::VARCHAR) > 1 THEN 'words' END END AS how FROM (SELECT *, {_han('p_partkey')} AS h FROM part)")
def product_match(t: Tables):
    """Requests by code, by a variant's signs, by name, by signs of the label, and for something else."""
    k, own = F.col("p_size") % 5, han("p_partkey")
    number = F.col("p_partkey").cast("string")
    asked = F.when(k == 0, F.concat(F.lit("x"), number)).when((k == 1) | (k == 3), own).when(k == 2, F.concat(F.lit("panel "), F.translate(number, "0123456789", "abcdefghij"))).otherwise("zzz")
    question = F.concat(F.lit("请给我发 "), asked, F.lit(" 的图片"))
    label = F.when(k == 0, F.concat(F.lit("Panel X"), number)).when(k == 3, own).otherwise("")
    name = F.when(k == 2, F.concat(F.lit("Panel® "), F.translate(number, "0123456789", "abcdefghij")))
    return t.part.select("p_partkey", S.product_match(question, label, F.when(k == 1, own), name).alias("how"))


_TERMS = "list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]{{2,}}'))"


@query("R20_question_excerpt", f"""WITH j AS (SELECT doc_id, d.text, {_TERMS.format('b.text')} AS q FROM documents d JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id WHERE d.text <> ''), w AS (SELECT doc_id, text, s, len(list_intersect(q, {_TERMS.format('substr(text, s + 1, 540)')})) AS n FROM (SELECT *, unnest(range(0, length(text), 270)) AS s FROM j)), b AS (SELECT doc_id, any_value(text) AS text, min_by(s, {{'a': -n, 'b': s}}) AS s FROM w GROUP BY doc_id)
 SELECT doc_id, CASE WHEN length(text) <= 700 THEN text WHEN s < 160 THEN substr(text, 1, 700) ELSE substr(text, 1, 140) || chr(10) || '[...]' || chr(10) || substr(text, s + 1, 540) END AS excerpt FROM b""")
def question_excerpt(t: Tables):
    """Documents for the benchmark item of their number."""
    items = t.benchmark.select("item_id", T.plain_terms(F.col("text"), 2, False).alias("q"))
    rows = t.documents.where("text <> ''").join(sized_broadcast(items), F.col("doc_id") % t.benchmark.count() == F.col("item_id"))
    return rows.select("doc_id", S.question_excerpt(F.col("text"), F.col("q")).alias("excerpt"))


@query("R22_preview_selection")
def preview_selection(t: Tables):
    """Ten documents or so for each tenth of a benchmark item's documents, by language in turn; an item's halves are its goals."""
    half = F.floor(F.length("text") / 2).cast("int")
    items = t.benchmark.select("item_id", F.array(T.plain_terms(F.substr("text", F.lit(1), half), 2, False), T.plain_terms(F.substr("text", half + 1), 2, False)).alias("goals"))
    n = t.benchmark.count()
    rows = t.documents.where("text <> ''").withColumn("query_id", F.col("doc_id") % (10 * n))
    rows = rows.join(sized_broadcast(items), F.col("query_id") % n == F.col("item_id"))
    return S.preview(rows.select("query_id", F.col("lang").alias("bucket"), F.col("doc_id").alias("position"), F.col("doc_id").alias("id"), "text", T.plain_terms(F.col("text"), 2, False).alias("terms"), "goals"))


def _ranked_lines(t: Tables):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("q"), "l_linenumber"))
    return _lines(t).withColumn("rank", rank).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("id"), "rank", "f", "s", "p", "u", "q")


@query("R24_coverage_first", f"""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber) AS rank, f, s, u % 3 AS document, q FROM ({_LINES})), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY rank) = 1 AS brings FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT brings, rank) AS turn FROM a),
 w AS (SELECT *, q >= 5 AND row_number() OVER (PARTITION BY query_id, document, s ORDER BY q DESC, turn) = 1 AS wins FROM o) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY NOT wins, turn) AS position FROM w""")
def coverage_first(t: Tables):
    return S.coverage_first(_ranked_lines(t).select("query_id", "id", "rank", F.array("f").alias("aspects"), (F.col("u") % 3).alias("document"), F.create_map("s", F.col("q") / 50).alias("goals")))


_ASPECTS = "SELECT unnest(['ring', 'red', 'ECONOMY', 'PROMO']) AS aspect"


@query("R30_aspect_recovery", f"""WITH d AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS l, p_brand FROM part), m AS (SELECT DISTINCT aspect, p_partkey FROM ({_ASPECTS}), (SELECT p_partkey, unnest(l) AS label FROM d) WHERE contains(label, aspect) OR contains(aspect, label)),
 s AS (SELECT aspect, label AS expansion, 2 * count(*) AS score FROM m JOIN (SELECT p_partkey, unnest(l) AS label FROM d) USING (p_partkey) WHERE label <> aspect GROUP BY ALL UNION ALL SELECT aspect, p_brand, 3 * count(*) FROM m JOIN d USING (p_partkey) GROUP BY ALL), g AS (SELECT aspect, expansion, sum(score)::BIGINT AS score FROM s GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY score DESC, length(expansion), expansion) AS n FROM g) WHERE n <= 4""")
def aspect_expansions(t: Tables):
    aspects = t.spark.createDataFrame([("ring",), ("red",), ("ECONOMY",), ("PROMO",)], "aspect string")
    return S.aspect_expansions(aspects, t.part.select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("labels"), F.col("p_brand").alias("title")))


def _context_rows(t: Tables):
    scope = F.when(F.col("s") == "F", "content").when(F.col("f") == "R", "document_index").otherwise("other")
    return _ranked_lines(t).select("query_id", "id", "rank", scope.alias("scope"), (F.col("u") % 2).cast("string").alias("document"), (F.col("p") % 2).cast("string").alias("chunk"), F.col("f").alias("grp"), (F.col("q") > 30).alias("historical"), F.col("q").cast("long").alias("tokens"))


@query("R31_generation_order", f"""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber) AS rank, CASE WHEN s = 'F' THEN 'content' WHEN f = 'R' THEN 'document_index' ELSE 'other' END AS scope, (u % 2)::VARCHAR AS document, (p % 2)::VARCHAR AS chunk, f AS grp, q > 30 AS historical, q::BIGINT AS tokens FROM ({_LINES})),
 c AS (SELECT *, min(rank) OVER (PARTITION BY query_id, document, chunk) AS b, row_number() OVER (PARTITION BY query_id, document, chunk ORDER BY rank) AS x, row_number() OVER (PARTITION BY query_id, document, chunk ORDER BY rank DESC) AS z FROM r WHERE scope = 'content'), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, CASE WHEN x = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, rank) AS seq FROM c),
 e AS (SELECT *, row_number() OVER (PARTITION BY query_id, document, grp ORDER BY historical, seq) AS turn, min(seq) OVER (PARTITION BY query_id, document, grp) AS g FROM d), o AS (SELECT query_id, id, scope, document, tokens, 0 AS k1, turn AS k2, g AS k3 FROM e UNION ALL SELECT query_id, id, scope, document, tokens, CASE scope WHEN 'other' THEN 1 ELSE 2 END, rank, 0 FROM r WHERE scope <> 'content'),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, k3, id) AS position FROM o), h AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY (scope = 'content') DESC, position) = 1 AS held FROM p)
 SELECT query_id, id, position, held OR sum(CASE WHEN held THEN tokens ELSE 0 END) OVER (PARTITION BY query_id) + sum(CASE WHEN held THEN 0 ELSE tokens END) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100 AS kept FROM h""")
def generation_order(t: Tables):
    return S.trimmed(S.generation_order(_context_rows(t)), 100).select("query_id", "id", "position", "kept")


# merged sources


@query("U01_union_rounds", f"""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS position, 'u' || p % 20 AS url, f, s, p FROM ({_LINES})), o AS (SELECT query_id, position, url, f AS excerpt, 2 * position AS k FROM r WHERE p % 3 <> 0), n AS (SELECT query_id, position, url, CASE WHEN s = 'O' THEN f ELSE 'new' END AS excerpt FROM r WHERE p % 3 <> 1),
 u AS (SELECT query_id, position, url, excerpt, 2 AS round FROM n UNION ALL SELECT query_id, position, url, excerpt, 1 FROM o), one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, url, excerpt ORDER BY round DESC, position) = 1), known AS (SELECT query_id, url, excerpt, min_by(k, position) AS k FROM o GROUP BY ALL),
 j AS (SELECT one.*, known.k, row_number() OVER (PARTITION BY query_id ORDER BY round DESC, one.position) AS i FROM one LEFT JOIN known USING (query_id, url, excerpt)), m AS (SELECT *, sum((k IS NULL)::INT) OVER (PARTITION BY query_id ORDER BY i) AS x FROM j),
 free AS (SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY v) AS x FROM (SELECT DISTINCT query_id FROM u), (SELECT unnest(range(1, 200)) AS v) WHERE (query_id, v) NOT IN (SELECT (query_id, k) FROM o)), b AS (SELECT query_id, url, string_agg('W' || k, ',' ORDER BY k) AS previous FROM (SELECT DISTINCT query_id, url, k FROM o) GROUP BY ALL)
 SELECT m.query_id, 'W' || coalesce(m.k, free.v) AS id, round, CASE WHEN m.k IS NULL THEN previous END AS previous, m.url, excerpt FROM m LEFT JOIN free ON free.query_id = m.query_id AND free.x = m.x AND m.k IS NULL LEFT JOIN b ON b.query_id = m.query_id AND b.url = m.url""")
def union_rounds(t: Tables):
    """Two rounds of an order's parts: the old one has ids with gaps, some content changed since."""
    rows = _lines(t).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("u"), (F.col("p") % 20).cast("string")).alias("url"), "f", "s", "p")
    old = rows.where("p % 3 <> 0").select("query_id", "position", "url", F.col("f").alias("excerpt"), F.concat(F.lit("W"), (2 * F.col("position")).cast("string")).alias("id"))
    new = rows.where("p % 3 <> 1").select("query_id", "position", "url", F.when(F.col("s") == "O", F.col("f")).otherwise("new").alias("excerpt"))
    return S.merged_rounds(old, new, ["url", "excerpt"]).drop("position")


@query("U09_requirement_search_merge", f"""WITH q AS (SELECT l_orderkey AS query_id, l_linenumber AS position, f || s AS query, q = 50 AS stops FROM ({_LINES})), e AS (SELECT *, coalesce(sum(stops::INT) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM q),
 r AS (SELECT l_orderkey AS query_id, f || s AS query, l_linenumber AS rank, 'u' || p % 4 AS url, s AS excerpt FROM ({_LINES})), j AS (SELECT e.query_id, url, excerpt, min({{'position': e.position, 'rank': r.rank}}) AS first, list_sort(list_distinct(list(e.position))) AS w FROM e JOIN r ON e.query_id = r.query_id AND e.query = r.query WHERE o = 0 GROUP BY ALL)
 SELECT query_id, 'W' || row_number() OVER (PARTITION BY query_id ORDER BY first, url, excerpt) AS source_id, url, excerpt, array_to_string(w, ',') AS requirements FROM j""")
def requirement_search_merge(t: Tables):
    """Lines are requirements whose query is their flag and status; a quantity of 50 ends the quota."""
    rows = _lines(t)
    requirements = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("requirement_id"), F.col("l_linenumber").alias("position"), F.concat("f", "s").alias("query"), F.when(F.col("q") == 50, "quota_exhausted").otherwise("ok").alias("status"))
    results = rows.select(F.col("l_orderkey").alias("query_id"), F.concat("f", "s").alias("query"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("u"), (F.col("p") % 4).cast("string")).alias("url"), F.col("s").alias("excerpt"))
    return S.searched(requirements, results)


@query("U06_cell_fingerprints", "SELECT l_orderkey, id FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS id, l_discount < 0.05 AS few, row_number() OVER (PARTITION BY l_orderkey, l_discount < 0.05, l_returnflag, l_linestatus, l_suppkey % 2 ORDER BY l_linenumber * 1000000 + l_partkey) AS n FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount)) WHERE n = 1 OR few")
def cell_fingerprints(t: Tables):
    """Rows of an order with four values, or three where the discount is small, which all stay."""
    w = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_extendedprice", "l_discount")
    rows = t.lineitem.withColumn("k", F.row_number().over(w)).where("k = 1").withColumn("id", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    values = F.array("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 2).cast("string"))
    rows = rows.select("l_orderkey", "id", F.when(F.col("l_discount") < 0.05, values).otherwise(F.concat(values, F.array(F.lit("x")))).alias("values"))
    return S.cell_duplicates(rows, ["l_orderkey"], "id").select("l_orderkey", "id")


@query("U07_requirement_union", "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o) AS values FROM (SELECT l_orderkey, l_returnflag, min({'a': l_linenumber, 'b': l_returnflag}) AS o FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def requirement_union(t: Tables):
    return S.ordered_union(t.lineitem, ["l_orderkey"], F.struct("l_linenumber", "l_returnflag"), "l_returnflag")


@query("D21_requirement_grid", "WITH g AS (SELECT n_regionkey AS query_id, s_suppkey AS target_id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), a AS (SELECT r_regionkey AS query_id, unnest(['price', 'quality of ' || (SELECT min(name) FROM g WHERE query_id = r_regionkey)]) AS aspect FROM region), j AS (SELECT *, contains(aspect, name) AS named FROM a JOIN g USING (query_id) WHERE aspect IS NOT NULL) SELECT query_id, target_id, aspect, 'R' || left(sha256(target_id || chr(1) || aspect), 16) AS requirement_id FROM (SELECT *, bool_or(named) OVER (PARTITION BY query_id, aspect) AS hit FROM j) WHERE named OR NOT hit")
def requirement_grid(t: Tables):
    """A region's suppliers by price, and by the quality of the first of them by name."""
    targets = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("query_id"), F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("name"))
    first = targets.groupBy("query_id").agg(F.min("name").alias("first"))
    aspects = t.region.select(F.col("r_regionkey").alias("query_id")).join(first, "query_id", "left").select("query_id", F.explode(F.array(F.lit("price"), F.concat(F.lit("quality of "), "first"))).alias("aspect"))
    return S.requirement_grid(targets, aspects)


# filters, relations, states


@query("P06_substantive_overlap", "SELECT DISTINCT item_id AS query_id, doc_id AS id FROM (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[×*./-][a-z0-9]+)*'), lambda x: length(x) >= 1))) AS t FROM benchmark) JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:[×*./-][a-z0-9]+)*'))) AS t FROM documents) USING (t)")
def substantive_overlap(t: Tables):
    return L.substantive_overlap(t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


@query("P08_required_phrases", f"WITH p AS (SELECT p_partkey, {_han('p_partkey')} AS label, {_han('p_size')} AS question FROM part) SELECT p_partkey FROM p WHERE (NOT contains(question, '度') OR contains(label, '度')) AND (NOT contains(question, '石') OR contains(label, '石')) AND (length(question) < 2 OR contains(label, question) OR question = '厚度')")
def required_phrases(t: Tables):
    """Parts as visuals labelled with their number, asked for by their size."""
    return t.part.where(L.required_visuals(han("p_partkey"), han("p_size"), ["度", "石"], ["厚度"])).select("p_partkey")


@query("P13_region_with_exclusion", "WITH n AS (SELECT n_name AS name FROM nation), q AS (SELECT s_suppkey AS query_id, replace('show' || CASE s_suppkey % 3 WHEN 0 THEN '不含' WHEN 1 THEN '' ELSE 'all' END || n_name || '省', ' ', '') AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT DISTINCT query_id, replace(name, ' ', '') AS region FROM q, n WHERE contains(q, replace(name, ' ', '')) AND NOT ends_with(substr(q, 1, strpos(q, replace(name, ' ', '')) - 1), '不含')")
def region_with_exclusion(t: Tables):
    """Questions about suppliers' nations, every third of which excludes it."""
    k = F.col("s_suppkey") % 3
    q = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    question = F.concat(F.lit("show "), F.when(k == 0, "不含").when(k == 1, "").otherwise("all "), "n_name", F.lit("省"))
    return L.named_regions(q.select(F.col("s_suppkey").alias("query_id"), question.alias("question")), t.nation.select(F.concat("n_name", F.lit("省")).alias("name")))


@query("P20_parse_quality", f"""WITH c AS (SELECT o_custkey AS doc, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS chunks, sum(CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN length(o_orderpriority) ELSE 0 END)::BIGINT AS characters, coalesce(bool_or(o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'), false) AS answers FROM orders GROUP BY o_custkey),
 l AS (SELECT o_custkey AS doc, count(CASE WHEN q > 5 THEN 1 END) AS rows, count(CASE WHEN q / 50 < 0.7 THEN 1 END) AS unsure, count(*) AS visuals, count(CASE WHEN f <> 'R' THEN 1 END) AS ready, count(CASE WHEN s = 'O' THEN 1 END) AS ocr FROM ({_LINES}) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
 SELECT doc, chunks, characters, coalesce(rows, 0) AS rows, coalesce(visuals, 0) AS visuals, coalesce(ready, 0) AS ready, coalesce(unsure, 0) AS unsure, coalesce(ocr, 0) AS ocr, concat_ws(',', CASE WHEN NOT answers THEN 'no_extracted_answer_text' END, CASE WHEN ready < visuals THEN 'some_visual_pixels_unavailable' END, CASE WHEN unsure > 0 THEN 'low_extraction_confidence' END, CASE WHEN ocr > 0 THEN 'ocr_candidates_unverified' END) AS warnings FROM c LEFT JOIN l USING (doc)""")
def parse_quality(t: Tables):
    """A customer's orders are its chunks, their lines its places and visuals."""
    own = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    lines = _lines(t).join(own, "l_orderkey")
    chunks = t.orders.select(F.col("o_custkey").alias("doc"), F.when(F.col("o_orderstatus") == "P", "document_index").alias("kind"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("text"))
    return L.parse_quality(chunks, lines.select("doc", F.when(F.col("q") > 5, F.col("l_linenumber")).alias("row_index"), (F.col("q") / 50).alias("confidence")), lines.select("doc", (F.col("f") != "R").alias("ready"), (F.col("s") == "O").alias("ocr")))


@query("J18_family_sections", "WITH s AS (SELECT o_orderkey AS section, list_distinct(list(l_partkey)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey), x AS (SELECT section, unnest(e) AS evidence FROM s), p AS (SELECT p_partkey FROM part WHERE p_size > 5) SELECT o_custkey AS key, section, string_agg(evidence::VARCHAR, ',' ORDER BY evidence) AS evidence FROM x JOIN orders ON section = o_orderkey WHERE evidence IN (SELECT p_partkey FROM p) GROUP BY o_custkey, section")
def family_sections(t: Tables):
    """Orders are sections of their customers, their parts (as a JSON list) the evidence; small parts aren't public."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("evidence_json"))
    sections = t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("section"), F.when(F.col("o_orderstatus") == "P", "internal").otherwise("public").alias("scope"), "evidence_json")
    return L.related_sections(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("section")), sections, t.part.where("p_size > 5").select(F.col("p_partkey").alias("evidence")))


@query("J19_node_assets", "SELECT DISTINCT s_suppkey AS query_id, p_partkey AS asset FROM supplier JOIN part ON string_split(p_name, ' ')[2] = CASE WHEN s_suppkey % 2 = 0 THEN 'ring' ELSE 'bolt' END WHERE s_suppkey % 5 <> 0 AND p_size > 3 AND p_partkey % 10 <> 0 AND (s_suppkey % 3 <> 0 OR p_type = 'ECONOMY') AND (s_suppkey % 4 <> 0 OR (p_size % 2 = 0 AND p_brand = 'Brand#13'))")
def node_assets(t: Tables):
    """Parts as node assets: their type is the form, the noun of their name the kind, the brand the method, which half of them lack."""
    k = F.col("s_suppkey")
    words = lambda cond, *w: F.when(cond, F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>"))
    asked = t.supplier.select(k.alias("query_id"), words(k % 3 == 0, "ECONOMY").alias("forms"), F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("ring"))).otherwise(F.array(F.lit("bolt"))).alias("kinds"), words(k % 4 == 0, "Brand#13").alias("methods"))
    nodes = t.part.select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("form"), F.get(F.split("p_name", " "), F.lit(1)).alias("kind"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("method"), F.when(F.col("p_size") > 3, "public").otherwise("internal").alias("scope"))
    return L.node_assets(asked, nodes, t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("asset")))


@query("J22_nearest_product", """WITH c AS (SELECT vec_id // 4 AS case_id, embedding AS x FROM embeddings), p AS (SELECT label AS product, list_transform(embedding, lambda x: x) AS y FROM (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)), named AS (SELECT case_id, (case_id % 10) AS product FROM c WHERE case_id % 7 = 0 GROUP BY ALL),
 d AS (SELECT case_id, product, round(median(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))), 9) AS distance FROM c, p WHERE case_id NOT IN (SELECT case_id FROM named) GROUP BY ALL)
 SELECT case_id, min(product)::INT AS product, 'named' AS basis, NULL::DOUBLE AS distance FROM named GROUP BY case_id UNION ALL SELECT case_id, min_by(product, {'a': distance, 'b': product}), 'colour', min(distance) FROM d GROUP BY case_id""")
def nearest_product(t: Tables):
    """Four vectors are the images of a project, the first vector of each label is a product's; all projects are asked for."""
    cases = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("case_id"), F.col("embedding").alias("vector"))
    products = t.embeddings.groupBy(F.col("label").alias("product")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    named = cases.where("case_id % 7 = 0").select("case_id", (F.col("case_id") % 10).cast("int").alias("product")).distinct()
    return L.nearest_products(cases, products, named)


@query("J23_scope_notes", """WITH r AS (SELECT p_partkey AS id, p_size > 3 AS pub, CASE WHEN p_partkey % 2 = 0 THEN 'u:' || 'http://x/' || p_partkey % 50 WHEN p_size > 1 THEN 'p:' || p_brand || ':' || p_size END AS key FROM part), g AS (SELECT s_suppkey AS note, s_suppkey * 3 AS id FROM supplier), o AS (SELECT note, g.id, key FROM g JOIN r ON r.id = g.id WHERE pub AND note NOT IN (SELECT s_suppkey FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_size <= 3))
 SELECT DISTINCT r.id, o.note FROM r JOIN o ON r.id = o.id OR r.key = o.key WHERE r.pub""")
def scope_notes(t: Tables):
    """Parts have a url (even ones) or a page of their brand; notes of suppliers point at a part and rest on another, small parts not being public."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 3, "public").otherwise("internal").alias("scope"))
    even = F.col("p_partkey") % 2 == 0
    references = t.part.select(F.col("p_partkey").alias("id"), F.when(even, F.concat(F.lit("http://x/"), (F.col("p_partkey") % 50).cast("string"))).alias("url"), F.col("p_brand").alias("document"), F.when(F.col("p_size") > 1, F.col("p_size")).alias("page"))
    n = t.supplier.select(F.col("s_suppkey").alias("note"), (F.col("s_suppkey") * 3).alias("id"))
    supports = t.supplier.select(F.col("s_suppkey").alias("note"), F.col("s_suppkey").alias("id")).join(t.part.select(F.col("p_partkey").alias("id")), "id", "left_semi").select("note", "id")
    return L.scope_notes(rows, references, n.select("note"), n, supports, t.part.where("p_size > 3").select(F.col("p_partkey").alias("id")))


@query("D29_form_annotations", """WITH s AS (SELECT o_orderkey AS section, CASE o_orderkey % 3 WHEN 0 THEN '单板' WHEN 1 THEN '一体板' END AS form, o_orderkey % 11 = 0 AS mixed, o_orderkey % 2 = 0 AS titled FROM orders), e AS (SELECT DISTINCT l_orderkey AS section, l_partkey AS id FROM lineitem), h AS (SELECT id, form FROM e JOIN s USING (section) WHERE NOT mixed AND form IS NOT NULL AND titled), a AS (SELECT DISTINCT id FROM e JOIN s USING (section) WHERE mixed),
 o AS (SELECT id, min(form) AS form FROM h WHERE id NOT IN (SELECT id FROM a) GROUP BY id HAVING count(DISTINCT form) = 1) SELECT p_partkey AS id, form, CASE WHEN contains(p_name || CASE WHEN p_size % 2 = 0 THEN ' 单板' ELSE '' END, form) THEN p_name || CASE WHEN p_size % 2 = 0 THEN ' 单板' ELSE '' END ELSE p_name || CASE WHEN p_size % 2 = 0 THEN ' 单板' ELSE '' END || chr(10) || '板型标注：' || form END AS annotated FROM part JOIN o ON p_partkey = id""")
def form_annotations(t: Tables):
    """Orders are sections of a family by their number, some of both; their parts are the documents."""
    k = F.col("o_orderkey")
    family = F.when(k % 11 == 0, F.array(F.lit("single"), F.lit("composite"))).when(k % 3 == 0, F.array(F.lit("single"))).when(k % 3 == 1, F.array(F.lit("composite"), F.lit("other"))).otherwise(F.array(F.lit("other")))
    title = F.when(k % 2 == 0, F.when(k % 3 == 0, "单板图集").otherwise("一体板图集")).otherwise("图集")
    evidence = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("evidence"))
    sections = t.orders.join(evidence, k == F.col("l_orderkey")).select(k.alias("section"), title.alias("title"), family.alias("families"), "evidence")
    documents = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " 单板").otherwise("")).alias("text"))
    return L.form_annotations(documents, sections, {"single": "单板", "composite": "一体板"})


@query("D28_source_gaps", "WITH n AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS c FROM orders GROUP BY o_custkey) SELECT c_custkey AS source, CASE WHEN c_custkey % 11 = 0 THEN 'invalid_input' WHEN c_custkey % 13 = 0 THEN 'unavailable' WHEN n.n IS NULL AND c_custkey % 5 = 0 THEN 'quota_exhausted' WHEN n.n IS NULL AND c_custkey % 5 = 1 THEN 'permission_denied' WHEN c > 0 THEN 'ready' WHEN n.n > 0 THEN 'index_only' ELSE 'empty' END AS state FROM customer LEFT JOIN n ON c_custkey = o_custkey")
def source_gaps(t: Tables):
    k = F.col("c_custkey")
    sources = t.customer.select(k.alias("source"), F.when(k % 5 == 0, "quota_exhausted").when(k % 5 == 1, "not_requested").otherwise("ok").alias("status"), F.when(k % 11 == 0, "OUTPUT_SCHEMA_INVALID").when(k % 13 == 0, "WEB_TIMEOUT").alias("error"))
    return L.source_states(sources, t.orders.select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "P", "document_index").otherwise("content").alias("scope")))


@query("D31_profiles", """WITH l AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k, min(o_orderpriority) AS base FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey), c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '单板 ' || c_mktsegment WHEN 2 THEN c_mktsegment ELSE '金麻' END AS own, CASE c_custkey % 3 WHEN 0 THEN '粘锚' WHEN 1 THEN '' ELSE '干挂' END AS given FROM customer)
 SELECT c_custkey AS case_id, concat_ws('；', nullif(trim(own), ''), CASE WHEN NOT contains(own, '单板') AND NOT contains(own, '一体板') THEN '形态：' || CASE WHEN given = '粘锚' THEN '一体板' ELSE '单板' END END, CASE WHEN contains(own, '金麻') THEN NULL WHEN k = 1 THEN '色型：' || base ELSE '色型：混合' END) AS product, CASE WHEN given = '' THEN '干挂' ELSE given END AS method, CASE WHEN contains(own, '金麻') THEN 'source' WHEN k = 1 THEN 'image' ELSE 'default' END AS colour_basis FROM c LEFT JOIN l ON c_custkey = o_custkey""")
def profiles(t: Tables):
    k = F.col("c_custkey")
    product = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("单板 "), "c_mktsegment")).when(k % 4 == 2, F.col("c_mktsegment")).otherwise("金麻")
    cases = t.customer.select(k.alias("case_id"), product.alias("product"), F.when(k % 3 == 0, "粘锚").when(k % 3 == 1, "").otherwise("干挂").alias("method"))
    links = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("base"))
    return L.supplemented(cases, links, ["金麻"], {"一体板": ["粘锚"], "单板": [""]}, "干挂", "混合")


@query("D14_relation_tags", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)[0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm|m²|m2|㎡|kg|%|℃|天|小时|元|万元|亿元|[a-z]{1,3}\b)') AND len(list_intersect(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+(?:[._/-][a-z0-9]+)*'), lambda x: length(x) >= 2), ['the', 'token'])) > 0 THEN 'entity_value' END,
 CASE WHEN lang = 'de' AND (contains(text, '[ROW') OR contains(text, '[COLUMNS]') OR contains(text, '[TABLE') OR contains(text, 'Sheet') OR contains(text, 'sheet=')) THEN 'table_row' END, CASE WHEN contains(lower(text), '如果') OR contains(lower(text), '若') OR contains(lower(text), '当') OR contains(lower(text), '条件') OR contains(lower(text), '除非') OR contains(lower(text), '仅') OR contains(lower(text), 'if ') OR contains(lower(text), 'unless') OR contains(lower(text), 'when ') OR contains(lower(text), 'only ') OR contains(lower(text), 'except') OR contains(lower(text), 'provided') THEN 'condition' END, CASE WHEN source = 'src1' THEN 'visual_binding' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def relation_tags(t: Tables):
    tags = L.relation_tags(F.col("text"), F.array(F.lit("the"), F.lit("token")), F.col("lang") == "de", F.col("source") == "src1")
    return t.documents.select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("D22_evidence_projection", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'excel_range' WHEN o_orderstatus = 'O' AND o_custkey % 3 > 0 THEN 'page_region' WHEN o_orderstatus = 'P' THEN 'image_region' WHEN o_orderstatus = 'F' THEN 'generic' ELSE 'generic' END AS type, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN o_orderpriority END AS sheet, CASE WHEN (o_orderstatus = 'O' AND o_custkey % 3 > 0) OR (o_orderstatus = 'P' AND o_custkey % 3 > 0) THEN o_custkey % 3 END AS page, CASE WHEN o_orderstatus = 'P' THEN 's' || o_custkey END AS image, CASE WHEN NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0) AND NOT (o_orderstatus = 'O' AND o_custkey % 3 > 0) AND o_orderstatus <> 'P' THEN 's' || o_custkey END AS section FROM orders""")
def evidence_projection(t: Tables):
    """Orders as sources: workbooks with a sheet or none, files with a page or none, images."""
    c, none = F.col("o_custkey"), lambda x: F.lit(None).cast(x)
    kind = F.when(F.col("o_orderstatus") == "F", "excel").when(F.col("o_orderstatus") == "O", "pdf").otherwise("image")
    place = L.location(kind, F.when(c % 2 == 0, F.col("o_orderpriority")), F.lit("A1"), F.when(c % 3 > 0, c % 3), none("array<double>"), none("string"), none("long"), none("long"), F.concat(F.lit("s"), c.cast("string")))
    return t.orders.select("o_orderkey", place.alias("p")).select("o_orderkey", "p.type", "p.sheet", "p.page", "p.image", "p.section")


@query("F13_fragment_class", "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN '05_project_case' WHEN p_size % 6 = 1 AND p_partkey % 2 = 0 THEN '01_standard_specification' WHEN p_size % 6 = 1 THEN '02_product_information' WHEN p_size % 6 = 2 AND p_partkey % 2 = 0 THEN '01_standard_specification' WHEN p_size % 6 = 2 AND p_partkey % 3 = 0 THEN NULL WHEN p_size % 6 = 2 THEN '06_enterprise_information' WHEN p_size % 6 = 3 AND p_partkey % 2 = 1 THEN '03_construction_method' WHEN p_partkey % 2 = 0 THEN '01_standard_specification' END AS domain, CASE WHEN p_partkey % 3 = 0 THEN 'product_comparison' WHEN p_size % 6 = 1 AND p_partkey % 2 = 1 THEN 'test_report_or_performance' END AS subtype, CASE WHEN p_size % 6 = 0 OR (p_size % 6 IN (1, 3) AND p_partkey % 2 = 1) OR (p_size % 6 = 2 AND p_partkey % 2 = 1 AND p_partkey % 3 <> 0) THEN 'fragment' WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'needs_review' END AS basis FROM part")
def fragment_class(t: Tables):
    """Parts as fragments with a heading by size; even ones come from a technical source, every third compares products."""
    k = F.col("p_size") % 6
    heading = F.when(k == 0, "应用案例").when(k == 1, "检测报告").when(k == 2, "公司简介").when(k == 3, "施工步骤").otherwise("其他")
    domains = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("01_standard_specification"))).otherwise(F.array().cast("array<string>"))
    categories = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("internal_product_comparison"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", L.fragment_class(F.lit("text"), heading, F.col("p_name"), domains, categories).alias("c")).select("p_partkey", "c.*")


@query("F16_kind_without_negation", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 4 IN (0, 3) THEN '干挂' END, CASE WHEN p_size % 4 IN (1, 3) THEN '粘锚' END) AS methods FROM part")
def kind_without_negation(t: Tables):
    """Texts that state, exclude, or exclude one and state the other."""
    k = F.col("p_size") % 4
    text = F.when(k == 0, "采用干挂，不得使用粘锚").when(k == 1, "禁止干挂；可用粘锚").when(k == 2, "不适用于干挂").otherwise("穿透支承与粘锚")
    return t.part.select("p_partkey", F.array_join(L.stated(text, {"干挂": ["干挂", "穿透支承"], "粘锚": ["粘锚"]}), ",").alias("methods"))


@query("T06_plan_cache", "SELECT * FROM (SELECT user_id || ':' || event_type AS key, max(ts) AS ts, max_by(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1) WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 36 HOUR QUALIFY row_number() OVER (ORDER BY ts DESC) <= 100")
def plan_cache(t: Tables):
    rows = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("id"), "value")
    return L.cached_plans(rows, "36 HOURS", 100, "2024-01-25 00:00:00")
