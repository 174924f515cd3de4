"""Evidence: citations, facts, conflicts, coverage, windows of text, first-fit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .containment import contained


def citations(texts: DataFrame, declared: DataFrame) -> DataFrame:
    """J16. (citing, cited, code): codes found in a text that another document declares and the text's own doesn't.

    texts: doc, text; declared: doc, code (as ``standard_codes`` writes them).
    """
    found = texts.select("doc", F.explode(T.standard_codes(F.col("text"))).alias("code")).distinct()
    foreign = found.join(declared, ["doc", "code"], "left_anti")
    return foreign.withColumnRenamed("doc", "citing").join(declared.withColumnRenamed("doc", "cited"), "code").where("citing <> cited").select("citing", "cited", "code").distinct()


def canonical_listing(lines: DataFrame, members: DataFrame) -> DataFrame:
    """F27. List lines that name just one member, the member's first line of each section. lines: section, position, line; members: member."""
    hit = lines.join(contained(lines.select("line").distinct(), "line", "line", members, "member").join(members, "member"), "line")
    one = hit.groupBy("section", "position").agg(F.count("*").alias("n"), F.min("member").alias("member")).where("n = 1")
    return one.groupBy("section", "member").agg(F.min("position").alias("position"))


def prose_facts(docs: DataFrame, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """D12, D13. (id, ordinal, entity, metric, value, unit) of every match of ``pattern`` in a text.

    ``pattern`` has the groups entity, metric, value, unit in this order; values go to
    base units, and a match without an entity or with an unknown unit gives no fact.
    """
    groups = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)) for g in (1, 2, 3, 4)]
    rows = docs.select(F.col(id).alias("id"), F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("e", "m", "v", "u"), strict=True)])).alias("ordinal", "f"))
    base = V.base_unit(F.col("f.u"), V.number(F.col("f.v")))
    rows = rows.select("id", "ordinal", F.regexp_replace(F.lower("f.e"), r"\s+", "").alias("entity"), V.metric(F.col("f.m")).alias("metric"), base.alias("b"))
    return rows.where("entity <> '' and b is not null").select("id", "ordinal", "entity", "metric", F.round("b.value", 10).alias("value"), F.col("b.unit").alias("unit"))


def disagreements(facts: DataFrame, keys: list[str], value: str = "value", evidence: str = "evidence_id", source: str = "source_id") -> DataFrame:
    """A10. Groups with at least two evidences and values, and two sources if every source is known."""
    out = facts.groupBy(*keys).agg(
        F.count_distinct(evidence).alias("n_evidence"), F.count_distinct(value).alias("n_values"), F.count_distinct(source).alias("n_sources"), F.count_if(F.col(source).isNull()).alias("unknown"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return out.where((F.col("n_evidence") >= 2) & (F.col("n_values") >= 2) & ((F.col("unknown") > 0) | (F.col("n_sources") >= 2))).drop("unknown")


def coverage(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """A09. Each requirement with its number of evidences and whether it is covered. edges: requirement_id, evidence_id."""
    n = edges.groupBy("requirement_id").agg(F.count_distinct("evidence_id").alias("n"))
    return requirements.join(n, "requirement_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("covered", F.col("n") > 0)


def merged_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """W14. Per key: the intervals' union as its number of pieces and total length; touching ones are one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, "_piece").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    return pieces.groupBy(*keys).agg(F.count("*").alias("pieces"), F.sum(F.col("e") - F.col("s")).alias("covered"))


def header_context(cells: DataFrame) -> DataFrame:
    """W08. The body cells with ``context``: the last three header cells above each, joined. cells: doc, row, col, value, header."""
    own = Window.partitionBy("doc", "col", "header").orderBy("row")
    three = F.when(F.col("header"), F.array(F.lag("value", 2).over(own), F.lag("value").over(own), F.col("value")))
    above = F.last("_three", True).over(Window.partitionBy("doc", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.withColumn("_three", three).withColumn("_above", above).where(~F.col("header"))
    return rows.select("doc", "row", "col", F.array_join(F.coalesce("_above", F.array().cast("array<string>")), " / ").alias("context"))


def ranges(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """W12. Contiguous runs of an index: (keys, first, last)."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    runs = rows.select(*keys, index).distinct().withColumn("_i", island)
    return runs.groupBy(*keys, "_i").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_i")


def best_window(docs: DataFrame, terms: Column, size: int = 540, text: str = "text") -> DataFrame:
    """R20. Adds ``start``: of the half-overlapping windows the first with most of the terms."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size // 2))
    rows = F.transform(starts, lambda s: F.struct((-F.size(F.array_intersect(terms, T.plain_terms(F.substr(F.col(text), s + 1, F.lit(size)), 2, False)))).alias("n"), s.alias("s")))
    return docs.withColumn("start", F.array_min(rows)["s"])


def context_score(local_rank: Column, hits: Column, authority: Column) -> Column:
    """R23. Rank within the source, weights of matched terms (0.9 at most) and the source's authority."""
    terms = F.aggregate(F.transform(hits, lambda t: 0.08 + 0.04 * F.log(1.0 + F.length(t))), F.lit(0.0), lambda a, x: a + x)
    return F.round(60.0 / (60 + local_rank) + F.least(F.lit(0.9), terms) + authority, 6)


def first_fit(items: DataFrame, keys: list[str], order: list[str], id: str, size: str, budget: int) -> DataFrame:
    """R13. First-fit packing: in order, an item that doesn't fit is left out and the next is tried.

    A fold over each key's sorted items; one row per item with ``kept``. A key's items
    are one array, so keys must be bounded, as a query's candidates are.
    """
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(id).alias("_id"), F.col(size).cast("long").alias("_size")))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["_size"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["_size"]).otherwise(0)).alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    rows = rows.withColumn("f", F.aggregate("s", start, step))
    return rows.select(*keys, F.explode(F.arrays_zip("s", F.col("f.kept").alias("k"))).alias("x"), F.col("f.used").alias("used")).select(*keys, F.col("x.s._id").alias(id), F.col("x.k").alias("kept"), "used")


def violations(packed: DataFrame, known: DataFrame, id: str, digest: str, group: str) -> DataFrame:
    """D27. (id, reason): packed rows that are unknown, differ from their digest, or are part of a group that isn't whole. Ids are known once."""
    k = known.select(F.col(id).alias("_id"), F.col(digest).alias("_digest"), F.col(group).alias("_group"))
    rows = packed.join(k, F.col(id) == F.col("_id"), "left")
    size = known.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("whole"))
    part = packed.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("held")).join(size, "_g").where("held < whole").select("_g")
    broken = packed.join(part, F.col(group) == F.col("_g"), "left_semi").select(id, F.lit("group_incomplete").alias("reason"))
    unknown = rows.where("_id is null").select(id, F.lit("unknown_id").alias("reason"))
    changed = rows.where(F.col("_digest") != F.col(digest)).select(id, F.lit("digest_differs").alias("reason"))
    return unknown.union(changed).union(broken)


def page_quality(text: Column) -> Column:
    """S14. no_text, garbled_text, sparse_text or text_layer by replacement and control signs, and length."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bad = T.counted(t, r"[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]")
    return F.when(t == "", "no_text").when(bad / F.greatest(F.length(t), F.lit(1)) > 0.02, "garbled_text").when(F.length(t) < 40, "sparse_text").otherwise("text_layer")


def repeated_entries(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A23. Lists with at least 3 repeated lines and 6 repeats in excess: (id, list, repeated, excess). A list is a run of
    list lines; blank lines don't end it, others do."""
    lines = docs.select(F.col(id).alias("id"), F.posexplode(T.lines(F.col(text))).alias("n", "line")).where(F.trim("line") != "")
    entry = F.regexp_extract("line", r"^\s*(?:[-*•]\s+|[0-9]+[.)、]\s*)(.+)$", 1)
    rows = lines.withColumn("entry", F.trim(F.regexp_replace(entry, r"\s+", " "))).withColumn("other", (F.col("entry") == "").cast("int"))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("list", F.sum("other").over(w)).where("entry <> ''")
    per = rows.groupBy("id", "list", "entry").agg(F.count("*").alias("c")).where("c > 1")
    return per.groupBy("id", "list").agg(F.count("*").alias("repeated"), F.sum(F.col("c") - 1).alias("excess")).where("repeated >= 3 and excess >= 6")
