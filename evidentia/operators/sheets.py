"""Tables inside documents: headers, sections, statement facts, synopses and boxes on a page.

Cells are rows (doc, row, col, value); a document's own rows are bounded, its number is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .spread import spread

#: Header labels by role, as they stand when normalised (fixed values).
PERIOD_LABELS = ("period", "月份", "期间", "报告期间", "日期", "date", "month")
ITEM_LABELS = ("项目", "科目", "item", "项目名称", "科目名称")
CURRENT_LABELS = ("本期金额", "本年累计数", "本期数", "期末余额", "amount", "金额", "发生额")
PRIOR_LABELS = ("上期金额", "上年累计数", "上期数", "期初余额", "prioramount", "上年金额")


def normalised_label(value: Column) -> Column:
    """A label without white space, underscores, hyphens, brackets, colons and enumeration commas, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s_\-（）()：:、]", ""))


def _names_any(label: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(label, F.lit(n))
    return out


def role(value: Column) -> Column:
    """D08. period, item, prior or current by a header's label; null for none. Periods and items are whole labels, amounts may
    hold more, and a prior amount goes before a current one."""
    label = normalised_label(value)
    return F.when(label.isin(*PERIOD_LABELS), "period").when(label.isin(*ITEM_LABELS), "item").when(_names_any(label, PRIOR_LABELS), "prior").when(_names_any(label, CURRENT_LABELS), "current")


def known_metric(value: Column) -> Column:
    """D10. The metric whose name the label is, else the only one of which a name of 4 characters or more stands in it; null otherwise."""
    label = normalised_label(value)
    exact, holds = F.lit(None).cast("string"), []
    for m, names in V.METRICS.items():
        own = [n.lower() for n in names]
        exact = F.when(label.isin(*own), m).otherwise(exact)
        long = tuple(n for n in own if len(n) >= 4)
        holds.append(F.when(_names_any(label, long), F.lit(m)))
    some = F.filter(F.array(*holds), lambda x: x.isNotNull())
    return F.coalesce(exact, F.when(F.size(some) == 1, F.get(some, F.lit(0))))


def resolved_metrics(rows: DataFrame, label: str, candidates: DataFrame) -> DataFrame:
    """D10. ``rows`` with ``metric``: by name, by the only name that the label holds, else what the candidates (label, metric) say of it.

    Candidates meet labels in normalised form; a label for which they disagree stays unresolved. Null and empty labels resolve to nothing.
    """
    told = candidates.select(normalised_label(F.col("label")).alias("_label"), "metric").where("_label <> '' and metric is not null")
    told = told.groupBy("_label").agg(F.min("metric").alias("_told"), F.max("metric").alias("_other")).where("_told = _other").drop("_other")
    out = rows.withColumn("_label", normalised_label(F.col(label))).join(told, "_label", "left")
    return out.withColumn("metric", F.coalesce(known_metric(F.col(label)), "_told")).drop("_label", "_told")


def _rows(cells: DataFrame) -> DataFrame:
    """(doc, row, cells): filled cells of each row by column."""
    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return filled.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))


def headers(cells: DataFrame, most: int = 30) -> DataFrame:
    """D32. (doc, row, labels) of each table's header: of its first ``most`` rows the first with two metrics, a period, or an item
    and a metric; without one the row with most texts, then most cells, of those with two cells or more, 60 % texts and no
    repeat; the first of equals. A table without either has none."""
    rows = _rows(cells).withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("row"))).where(F.col("n") <= most)
    of = F.transform("cells", lambda c: F.struct(known_metric(c["value"]).isNotNull().alias("metric"), normalised_label(c["value"]).alias("label"), V.number(c["value"]).isNull().alias("text")))
    rows = rows.withColumn("x", of)
    metrics = F.size(F.filter("x", lambda c: c["metric"]))
    period, item = F.exists("x", lambda c: c["label"].isin(*PERIOD_LABELS)), F.exists("x", lambda c: c["label"].isin(*ITEM_LABELS[:3]))
    texts, n = F.size(F.filter("x", lambda c: c["text"])), F.size("cells")
    plain = (n >= 2) & (texts >= 0.6 * n) & (F.size(F.array_distinct(F.transform("cells", lambda c: c["value"]))) == n)
    sure = (metrics >= 2) | period | (item & (metrics >= 1))
    order = F.struct(F.when(sure, 0).otherwise(1).alias("a"), F.when(sure, F.lit(0)).otherwise(-texts).alias("b"), F.when(sure, F.lit(0)).otherwise(-n).alias("c"), F.col("row").alias("r"))
    best = rows.where(sure | plain).groupBy("doc").agg(F.min_by(F.struct("row", "cells"), order).alias("h"))
    return best.select("doc", F.col("h.row").alias("row"), F.array_join(F.transform("h.cells", lambda c: c["value"]), "|").alias("labels"))


#: What a data cell looks like, and words of a unit, which a new section ends (fixed values).
DATA_CELL = r"(?i)^-?\d+(?:,\d{3})*(?:\.\d+)?(?:e[+-]?\d+)?\s*(?:%|mm|cm|m|kg|g|元|万元|毫米|厘米)?$"
UNIT_HINT = r"(?i)unit|单位|毫米|厘米|千克|平方米|万元|(?<![A-Za-z])(?:mm|cm|m|kg|g|kWh|MWh|megawatthours|tons?|barrels?|dollars?|cents?|USD|EUR|CNY|hours?|days?)(?![A-Za-z])"


def table_contexts(cells: DataFrame, merges: DataFrame, most: int = 3, longest: int = 220, like: DataFrame | None = None) -> DataFrame:
    """W08. (doc, row, col, section, headers): of each cell of a data row the full-width heading above it, and the last ``most`` header cells
    of its column, joined by `` / ``.

    A row with a number is data, others are headers. A merged header stands over all of its columns; one over a table's whole width begins a
    section, which ends headers that name a unit. Header cells longer than ``longest`` are left out. cells: doc, row, col (from 1),
    value; merges: doc, row, col, end (ranges within a row). A table's width is its last column or merge. Each column's marks are folded in
    order of rows; a table's columns are apart, and tables are. Cells and merges are dealt out by document once, in tasks by the rows of
    ``like`` if it is given.
    """
    filled = cells.select("doc", "row", "col", F.trim(F.coalesce("value", F.lit(""))).alias("value")).where("value <> ''")
    rows = filled.withColumn("end", F.col("col")).unionByName(merges.select("doc", "row", "col", "end").withColumn("value", F.lit(None).cast("string"))).where("doc is not null and row is not null")
    rows = spread(rows, like, "doc", each=200_000) if like is not None else rows
    by = lambda *k: Window.partitionBy("doc", *k)
    marked = rows.withColumn("end", F.greatest(F.max("end").over(by("row", "col")), "col")).where("value is not null")
    marked = marked.withColumn("data", F.bool_or(F.col("value").rlike(DATA_CELL)).over(by("row"))).withColumn("width", F.max("end").over(by()))
    whole = (F.col("col") == 1) & (F.col("end") == F.col("width")) & (F.col("width") > 1)
    marked = marked.where(F.col("data") | (F.length("value") <= longest)).withColumn("kind", F.when(F.col("data"), "data").when(whole, "section").otherwise("header"))
    to = F.when(F.col("kind") == "data", F.col("col")).when(F.col("kind") == "section", F.col("width")).otherwise(F.col("end"))
    marks = marked.select("doc", F.explode(F.sequence("col", to)).alias("over"), "row", F.col("col").alias("at"), "kind", "value").groupBy("doc", "over").agg(F.array_sort(F.collect_list(F.struct("row", "at", "kind", "value"))).alias("marks"))
    empty = F.array().cast("array<string>")
    begin = F.struct(F.lit("").alias("section"), empty.alias("headers"), F.array().cast("array<struct<row:bigint,section:string,headers:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        kept = F.filter(acc["headers"], lambda h: ~h.rlike(UNIT_HINT))
        more = F.concat(acc["headers"], F.array(m["value"]))
        headers = F.when(m["kind"] == "header", F.slice(more, F.greatest(F.size(more) - most + 1, F.lit(1)), F.lit(most))).when(m["kind"] == "section", kept).otherwise(acc["headers"])
        row = F.struct(m["row"].cast("long").alias("row"), acc["section"].alias("section"), F.array_join(acc["headers"], " / ").alias("headers"))
        out = F.when(m["kind"] == "data", F.concat(acc["out"], F.array(row))).otherwise(acc["out"])
        return F.struct(F.when(m["kind"] == "section", m["value"]).otherwise(acc["section"]).alias("section"), headers.alias("headers"), out.alias("out"))

    rows = marks.select("doc", "over", F.explode(F.aggregate("marks", begin, step, lambda acc: acc["out"])).alias("x"))
    return rows.select("doc", "x.row", F.col("over").alias("col"), "x.section", "x.headers")


def wide_facts(cells: DataFrame) -> DataFrame:
    """D07. (doc, section, row, col, metric, label, period, value) of wide tables: below the first row with a period's label, the numbers of
    each column whose label names a metric, with the period that their row has in the period's column.

    A later row with a period's label in that column begins a further section and holds no facts; the first header's columns stay. Rows
    without a period and cells without a number give none; a blank is no zero. cells: doc, row, col, value, a place once.

    All of it is windows within a document, so cells are dealt out once; labels are read where they head a column, periods in the
    period's column, and numbers in the columns of a metric.
    """
    value, by = F.col("value"), lambda *k: Window.partitionBy("doc", *k)
    filled = cells.where((F.trim(F.coalesce("value", F.lit(""))) != "") & F.col("doc").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull())
    marked = filled.select("doc", "row", "col", "value", normalised_label(value).isin(*PERIOD_LABELS).alias("is_period"))
    marked = marked.withColumn("h", F.min(F.when(F.col("is_period"), F.struct("row", "col"))).over(by())).where("row >= h.row")
    below, at = F.col("row") > F.col("h.row"), F.col("col") == F.col("h.col")
    marked = marked.withColumn("m", F.max(F.when(~below, F.struct(known_metric(value).alias("metric"), value.alias("label")))).over(by("col")))
    marked = marked.withColumn("section", F.count_if(below & at & F.col("is_period")).over(by().orderBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + 1)
    marked = marked.withColumn("p", F.max(F.when(below & at, F.struct("is_period", V.period(value).alias("period")))).over(by("row")))
    facts = marked.where(below & F.col("m.metric").isNotNull() & ~F.col("p.is_period") & F.col("p.period").isNotNull())
    return facts.select("doc", "section", "row", "col", "m.metric", "m.label", "p.period", V.number(value).alias("value")).where("value is not null")


def sections(cells: DataFrame) -> DataFrame:
    """W13. (doc, row, section): rows by table, from 1. A later header starts a table if rows are missing before it, or before the
    title (a row of one cell) right above it; the table then begins with that title. Other headers and gaps don't."""
    rows = _rows(cells).withColumn("x", F.transform("cells", lambda c: normalised_label(c["value"])))
    of = lambda names: F.exists("x", lambda c: c.isin(*names))
    head = (F.size("x") >= 2) & (of(PERIOD_LABELS) | (of(ITEM_LABELS) & of(CURRENT_LABELS + PRIOR_LABELS)))
    w = Window.partitionBy("doc").orderBy("row")
    rows = rows.select("doc", "row", head.alias("head"), (F.size("x") == 1).alias("title"), F.coalesce(F.col("row") - F.lag("row").over(w) > 1, F.lit(False)).alias("gap"))
    first = F.min(F.when(F.col("head"), F.col("row"))).over(Window.partitionBy("doc"))
    before, apart = F.coalesce(F.lag("title").over(w), F.lit(False)), F.coalesce(F.lag("gap").over(w), F.lit(False))
    rows = rows.withColumn("starts", F.col("head") & (F.col("row") > first) & (F.col("gap") | (before & apart)))
    rows = rows.withColumn("below", F.coalesce(F.lead("starts").over(w), F.lit(False)))
    begins = (F.col("starts") & ~before) | (F.col("below") & F.col("title"))
    at = F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc", "row", (at + 1).alias("section"))


def statement_facts(cells: DataFrame) -> DataFrame:
    """D08. (doc, row, metric, role, period, value) of statement tables: below the first row with an item label, rows whose item is
    a known metric, with the numbers of the current and the prior amount's column.

    Amount columns are the first of their role; without one the first (second) column headed by a period. The prior
    period, if its column has none, is the one before the current. Cells that are no numbers give no fact.
    """
    marked = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("role", role(F.col("value"))).withColumn("period", V.period(F.col("value")))
    head = marked.where("role = 'item'").groupBy("doc").agg(F.min("row").alias("head"))
    top = marked.join(head, "doc").where("row = head")
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("col")))
    at = top.groupBy("doc", "head").agg(first("item").alias("item"), first("current").alias("cur"), first("prior").alias("pri"), F.array_sort(F.collect_list(F.when(F.col("period").isNotNull(), F.struct("col", "period")))).alias("dated"))
    at = at.withColumn("cur", F.coalesce("cur", F.get("dated", F.lit(0))["col"]))
    at = at.withColumn("pri", F.coalesce("pri", F.get(F.filter("dated", lambda d: ~d["col"].eqNullSafe(F.col("cur"))), F.lit(0))["col"]))
    named = lambda c: F.get(F.filter("dated", lambda d: d["col"] == F.col(c)), F.lit(0))["period"]
    at = at.withColumn("cp", named("cur")).withColumn("pp", F.when(F.col("pri").isNotNull(), named("pri")).otherwise(V.previous_period(named("cur"))))
    body = marked.join(at.drop("dated"), "doc").where("row > head").select("doc", "row", "col", "value", "item", "cur", "pri", "cp", "pp")
    items = body.where("col = item").select("doc", "row", known_metric(F.col("value")).alias("metric")).where("metric is not null")
    amounts = body.where("col = cur or col = pri").select("doc", "row", F.when(F.col("col") == F.col("cur"), "current").otherwise("prior").alias("role"), F.when(F.col("col") == F.col("cur"), F.col("cp")).otherwise(F.col("pp")).alias("period"), V.number(F.col("value")).alias("value"))
    return items.join(amounts.where("value is not null"), ["doc", "row"]).select("doc", "row", "metric", "role", "period", "value")


def fact_issues(facts: DataFrame) -> DataFrame:
    """D11. (fact, issue): a repeat of an earlier fact's metric and period, a value that is none, a missing period.
    facts: fact (its order), metric, period, value. A null period is one period."""
    again = F.row_number().over(Window.partitionBy("doc", "metric", F.coalesce("period", F.lit(""))).orderBy("fact")) > 1
    rows = facts.withColumn("i", F.filter(F.array(F.when(again, "duplicate_fact"), F.when(F.col("value").isNull(), "invalid_amount"), F.when(F.coalesce("period", F.lit("")) == "", "period_missing")), lambda x: x.isNotNull()))
    return rows.select("doc", "fact", F.explode("i").alias("issue"))


#: What splits a text into clauses, words of an earlier period, and an amount with its unit (fixed values).
CLAUSE_ENDS = r"[，,。；;\n]+"
EARLIER = ("去年", "上年", "同期", "上期")
AMOUNT = r"([-+]?\(?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\)?)\s*(亿元|万元|元|人民币)?"
YUAN = {"元": 1.0, "人民币": 1.0, "万元": 10_000.0, "亿元": 100_000_000.0}


def text_facts(docs: DataFrame, id: str = "doc_id", text: str = "text", start_period: Column | None = None) -> DataFrame:
    """D09. (id, clause, metric, period, value, unit) of texts: per clause the first metric that it names, with the first amount
    after the name. The last period named is carried on; a clause on an earlier period takes the period before, and the last
    metric if it names none. An amount without a unit has none (value null).

    Commas end clauses, so an amount's own commas end it.
    """
    clauses = docs.select(F.col(id).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), CLAUSE_ENDS)).alias("clause", "body"), (start_period if start_period is not None else F.lit(None).cast("string")).alias("first"))
    clauses = clauses.where(F.trim("body") != "")
    own, rest = F.lit(None).cast("string"), F.col("body")
    for m, names in reversed(list(V.METRICS.items())):
        for n in reversed(names):
            at = F.instr("body", n)
            rest = F.when(at > 0, F.substr(F.col("body"), at + len(n))).otherwise(rest)
            own = F.when(at > 0, m).otherwise(own)
    w = Window.partitionBy("id").orderBy("clause").rowsBetween(Window.unboundedPreceding, 0)
    earlier = _names_any(F.col("body"), EARLIER)
    clauses = clauses.withColumn("own", own).withColumn("rest", rest).withColumn("earlier", earlier).withColumn("named", V.period(F.col("body")))
    clauses = clauses.withColumn("active", F.coalesce(F.last("named", True).over(w), "first"))
    metric = F.coalesce("own", F.when(F.col("earlier"), F.last("own", True).over(w)))
    number, unit = F.regexp_extract("rest", AMOUNT, 1), F.regexp_extract("rest", AMOUNT, 2)
    factor = F.lit(None).cast("double")
    for u, f in YUAN.items():
        factor = F.when(unit == u, f).otherwise(factor)
    out = clauses.withColumn("metric", metric).where("metric is not null").where(number != "")
    period = F.when(F.col("earlier"), V.previous_period(F.col("active"))).otherwise(F.col("active"))
    return out.select("id", "clause", "metric", period.alias("period"), (V.number(number) * factor).alias("value"), F.when(factor.isNotNull(), "yuan").otherwise("unknown").alias("unit"))


def synopsis(cells: DataFrame, samples: int = 3) -> DataFrame:
    """A24. Per table: observed rows and columns, the range they span, cells with a formula, and the first ``samples`` rows as text.
    cells: doc, row, col (a number from 1), value, formula (null: none)."""
    per = cells.groupBy("doc", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: F.concat(c["col"].cast("string"), F.lit("="), F.coalesce(c["value"], F.lit("")))), " | ").alias("line"), F.count("formula").alias("f"), F.min("col").alias("lo"), F.max("col").alias("hi"))
    wide = cells.groupBy("doc").agg(F.count_distinct("col").alias("n_columns"))
    rows = per.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("row")))
    out = rows.groupBy("doc").agg(F.count("*").alias("n_rows"), F.sum("f").alias("formulas"), F.concat_ws(":", F.min("row").cast("string"), F.min("lo").cast("string"), F.max("row").cast("string"), F.max("hi").cast("string")).alias("range"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= samples, F.struct("n", "line")))), lambda r: r["line"]), "\n").alias("samples"))
    return out.join(wide, "doc").select("doc", "n_rows", "n_columns", "formulas", "range", "samples")


def box_groups(boxes: DataFrame) -> DataFrame:
    """W19. (page, column, x0, y0, x1, y1, n, row_counts): boxes of a page in columns by their x islands, and the number of boxes in
    each y island of a column, from the top. Touching boxes are apart. boxes: page, x0, y0, x1, y1 as shares of the page; page-sized
    (over 0.9), tiny (under 0.005) and long ones (sides over 8 to 1) are left out."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = boxes.where((w > 0) & (h > 0)).where((w * h).between(0.005, 0.9) & (F.greatest(w / h, h / w) <= 8))

    def islands(rows: DataFrame, keys: list[str], lo: str, hi: str, name: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(lo, hi)
        top = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(top.isNull() | (F.col(lo) >= top), 1).otherwise(0))
        return rows.withColumn(name, F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    rows = islands(islands(rows, ["page"], "x0", "x1", "column"), ["page", "column"], "y0", "y1", "line")
    lines = rows.groupBy("page", "column", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "n"))), lambda r: r["n"].cast("string")), ",")
    return lines.groupBy("page", "column").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"), counts.alias("row_counts"))
