"""What a question's context is made of: windows of a session's files, and evidence of several sources, each in order of worth.

Many questions are answered at once. Windows meet questions over shared terms, identifiers and sheet names in equi joins; only a question
about a whole file meets all windows of its session, as it admits them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import workspace
from .catalog import sized_broadcast
from .containment import contained
from .ranks import ranked_within

#: An identifier or period in a question, and its parts at any place of a text; the sheet that a window names (fixed values).
IDENTIFIER, SHEET = r"\b[0-9]{4}[/\-][0-9]{2,4}\b", r"\[TABLE[^\n]*? sheet=(.*?) state="
#: Quantities with a unit; marks of conditions and of tables (fixed values).
QUANTITY = r"(?i)-?[0-9]+(?:[,.][0-9]+)?\s*(?:mm|cm|m²|m2|㎡|m|kg/m²|kg/m2|kg|%|℃|°c|天|小时|元|万元|亿元)"
CONDITIONS = ("不得", "禁止", "不应", "不可", "不能", "仅限", "仅适用", "只适用", "除非", "条件下", "前提", "应当", "必须", "建议", "宜", "严禁", "not ", "must ", "only ", "unless ", "except ")
TABLES = ("[ROW", "[COLUMNS]", "[TABLE", "Sheet", "sheet=")
#: What a source's kind and its authority add (fixed values).
KINDS = {"customer_document": 0.30, "company_rag": 0.25, "catalog_sql": 0.12, "visual": 0.08, "public_web": 0.06}
REVIEWED = ("reviewed_company_catalog", "company_reviewed_material")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _named(name: Column, text: Column) -> Column:
    """Whether the name stands in the text as a word of its own, in any case."""
    quoted = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((name != "") & F.rlike(text, quoted), F.lit(False))


def overview_weight(text: Column, kind: Column, first: Column, last: Column) -> Column:
    """What a content window is worth to a question about a whole file: most as the first of its chunk, a table also as the last."""
    derived = _has(text, ("kind=derived_text", "LONG_TEXT_IN_DERIVED_CHUNKS"))
    table = (kind == "table") | _has(text, ("[TABLE ", "[COLUMNS]", "[ROW "))
    weight = F.when(derived, 0.2).when(table, 2.5).when(text.rlike("kind=(?:heading|title|paragraph|text)"), 2.0).when(_has(text, ("[VISUAL ",)), 0.5).otherwise(1.2)
    return F.when(first | (~derived & table & last), weight).otherwise(F.least(F.lit(0.15), weight / 10))


def pseudo_table(text: Column) -> Column:
    """Whether a window of a page's text layer has two cells of 14 words or more: prose that was taken for a table."""
    long = F.filter(T.found(text, "='([^']*)'", 1), lambda cell: T.counted(cell, "[A-Za-z]+") >= 14)
    return _has(text, ("source=pdf;", "parser=camelot-stream")) & (F.size(long) >= 2)


def session_windows(questions: DataFrame, windows: DataFrame, most: int | None = None) -> DataFrame:
    """R11. (query_id, window_id, score, reserved, position): a session's windows above 0, in order of worth to each of its questions.

    questions: query_id, session, text, whole (asks about whole files); windows: window_id, session, document, order, text, ranking (null:
    the text), kind, first, last. Sums of: rarity of shared terms times their saturated number of places (n and df within the session); 4
    if the window's sheet is named; 8 for each period or identifier of the question that it holds; for a whole question the window's
    weight, or 8 for the first index window of a document and -1000 for its other ones; -0.25 for an index window otherwise. A
    pseudo-table counts a quarter. The reserved index windows come first, then by score and order. Null texts are empty; a null session
    has no windows.
    """
    w = windows.select("window_id", "session", "document", "order", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ranking", "text", F.lit("")).alias("ranking"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("last", F.lit(False)).alias("last"))
    w = workspace.written(w.where("session is not null"), "windows")
    q = workspace.written(questions.select("query_id", "session", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("whole", F.lit(False)).alias("whole")), "questions")
    ids = T.found(F.col("text"), IDENTIFIER)
    asked = q.select("query_id", "session", F.explode(ids).alias("mark")).groupBy("query_id", "session", "mark").agg(F.count("*").alias("n"))
    marks = F.array_distinct(F.concat(*(T.found(F.col("ranking"), r"(?=([0-9]{4}[/\-][0-9]{%d}))" % n, 1) for n in (2, 3, 4))))
    held = w.select("window_id", "session", F.explode(marks).alias("mark"))
    by_mark = held.join(asked, ["session", "mark"]).select("query_id", "window_id", (8.0 * F.col("n")).alias("points"))
    leading = w.where("kind = 'document_index'").groupBy("session", "document").agg(F.min(F.struct("order", "window_id"))["window_id"].alias("window_id")).select("window_id", F.lit(True).alias("leads"))
    index = F.col("kind") == "document_index"
    weight = F.when(index, F.when(F.col("leads"), 8.0).otherwise(-1000.0)).otherwise(overview_weight(F.col("text"), F.col("kind"), F.col("first"), F.col("last")))
    traits = w.join(leading, "window_id", "left").select("window_id", "session", "order", index.alias("index"), F.coalesce("leads", F.lit(False)).alias("leads"), weight.alias("weight"), pseudo_table(F.col("text")).alias("pseudo"))
    traits = workspace.written(traits, "traits")
    by_whole = q.where("whole").select("query_id", "session").join(traits, "session").select("query_id", "window_id", F.col("weight").alias("points"))
    parts = workspace.written(_by_terms(q, w).unionByName(by_mark).unionByName(_by_sheet(q, w)).unionByName(by_whole), "points")
    sums = parts.groupBy("query_id", "window_id").agg(F.sum("points").alias("points"))
    rows = sums.join(traits.drop("session", "weight"), "window_id").join(sized_broadcast(q.select("query_id", "whole")), "query_id")
    score = (F.col("points") - F.when(F.col("index") & ~F.col("whole"), 0.25).otherwise(0.0)) * F.when(F.col("pseudo"), 0.25).otherwise(1.0)
    rows = rows.withColumn("score", F.round(score, 6)).where("score > 0").withColumn("reserved", F.col("whole") & F.col("leads"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reserved"), F.desc("score"), "order", "window_id"))
    rows = rows.withColumn("position", place)
    return (rows.where(F.col("position") <= most) if most else rows).select("query_id", "window_id", "score", "reserved", "position")


def _by_terms(q: DataFrame, w: DataFrame) -> DataFrame:
    """(query_id, window_id, points) of shared terms; counts of places are taken of each window once, for the session's wanted terms."""
    asked = q.select("query_id", "session", F.explode(T.session_terms(F.col("text"))).alias("term"))
    known = workspace.written(asked.select("session", "term").distinct(), "terms")
    own = w.select("window_id", "session", F.explode(T.session_terms(F.col("ranking"))).alias("term")).join(sized_broadcast(known), ["session", "term"], "left_semi")
    held = own.groupBy("window_id").agg(F.collect_list("term").alias("terms"))
    low = F.lower("ranking")
    c = w.join(held, "window_id").select("window_id", "session", "ranking", F.explode("terms").alias("term"))
    places = (F.length(low) - F.length(F.replace(low, F.lower("term"), F.lit("")))) / F.length("term")
    c = workspace.written(c.select("window_id", "session", "term", places.alias("c")), "counts")
    df = c.groupBy("session", "term").agg(F.count("*").alias("df"))
    rarity = df.join(w.groupBy("session").agg(F.count("*").alias("n")), "session").select("session", "term", F.log1p((F.col("n") + 1) / (F.col("df") + 1)).alias("rarity"))
    wanted = asked.join(rarity, ["session", "term"])
    return c.join(wanted, ["session", "term"]).select("query_id", "window_id", (F.col("rarity") * (1 + F.col("c") / (F.col("c") + 1.5))).alias("points"))


def _by_sheet(q: DataFrame, w: DataFrame) -> DataFrame:
    """4 where the question names the window's sheet."""
    sheet = F.regexp_extract("text", SHEET, 1)
    at = w.select("window_id", "session", sheet.alias("sheet")).where("sheet <> ''").withColumn("name", F.lower("sheet"))
    low = q.select("query_id", F.lower("text").alias("low"))
    met = contained(low, "query_id", "low", at.select("name").distinct(), "name")
    pairs = met.join(q.select("query_id", "session", F.col("text").alias("asked")), "query_id").join(at, ["session", "name"])
    return pairs.where(_named(F.col("sheet"), F.col("asked"))).select("query_id", "window_id", F.lit(4.0).alias("points"))


def _anchor(x: Column) -> Column:
    """Lower case without blanks, full-width signs as plain ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.lower(F.regexp_replace(F.translate(x, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)), r"[\s\x{3000}]+", ""))


def _anchored(target: Column, anchored: Column, terms: Column) -> Column:
    """Whether a target stands in a text: as it is, or, if it is plain ASCII, by two thirds of its terms."""
    own = T.context_terms(target)
    hits = F.size(F.array_intersect(own, terms))
    return F.contains(anchored, _anchor(target)) | (target.rlike(r"^[\x00-\x7f]+$") & (F.size(own) > 0) & (hits >= F.greatest(F.lit(1), F.ceil(F.size(own) * 2 / 3))))


def relations(text: Column, terms: Column, asked: Column, located: Column, visual: Column) -> Column:
    """Kinds of relations that a text holds: a quantity beside a term of the question, a row of a table with its place, a condition, an image."""
    row = located & _has(text, TABLES)
    kinds = F.array(F.when(text.rlike(QUANTITY) & F.arrays_overlap(asked, terms), "entity_value"), F.when(row, "table_row"), F.when(_has(T.folded(text), CONDITIONS), "condition"), F.when(visual, "visual_binding"))
    return F.filter(kinds, lambda k: k.isNotNull())


def table_binding(text: Column, asked: Column) -> Column:
    """0.4 for each term of the question among the row's words, 1.2 at most, if the headers below hold a term and the row a number."""
    at = F.instr(text, "[TABLE_CONTEXT")
    body, headers = F.substr(text, F.lit(1), at - 1), F.substr(text, at + 14)
    lines = F.filter(T.lines(body), lambda x: x.startswith("[ROW"))
    values = T.found(F.array_join(lines, "\n"), "='([^']*)'", 1)
    number = F.exists(values, lambda v: F.trim(v).rlike(r"^-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?$"))
    words = T.context_terms(F.array_join(F.filter(values, lambda v: ~v.rlike("^[0-9., -]+$")), " "))
    bound = F.least(F.lit(1.2), 0.4 * F.size(F.array_intersect(asked, words)))
    return F.when((at > 0) & number & F.arrays_overlap(asked, T.context_terms(headers)), bound).otherwise(0.0)


def ordered_context(evidence: DataFrame) -> DataFrame:
    """R23. The evidence of every question with ``local_rank``, ``score`` and ``position``.

    evidence: query_id, question, id, ordinal, source_type, text, ranking (null: the text), targets array, aspect, goals map of scores,
    reranked, source_group, chunk (id of the original chunk, or null), authority, navigation. Navigation and indexes go. The score adds,
    beside the rank within the source: matched terms (0.9 at most), table binding (1.2), 4 times the best goal score, targets (0.3 each,
    0.55 for the aspect, 0.9 at most), relations (0.08 each, 0.35), periods of the question (0.5 each, 1), the group named (0.7), the
    source's kind and its authority. If any of a question's evidence was reranked, it is 6 times the best goal score and 0.15 of that sum.
    Nulls count as empty. Ranks are taken in ranges, so a question may have any number of rows.
    """
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind) if "array" in kind else F.lit("").cast(kind))
    rows = evidence.where(~F.coalesce("navigation", F.lit(False)))
    rows = ranked_within(rows, ["query_id", "source_type"], ["ordinal", "id"], "local_rank")
    text, asked_text = F.coalesce("text", F.lit("")), F.coalesce("question", F.lit(""))
    rows = rows.withColumn("_asked", T.context_terms(asked_text)).withColumn("_terms", T.context_terms(F.coalesce("ranking", text))).withColumn("_all", T.context_terms(text)).withColumn("_anchor", _anchor(text))
    asked = F.col("_asked")
    hits = F.array_intersect(asked, F.col("_terms"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    matched = F.least(F.lit(0.9), add(F.transform(hits, lambda t: 0.08 + 0.04 * F.log1p(F.length(t)))))
    targets = none(F.col("targets"), "array<string>")
    present = F.size(F.filter(F.array_distinct(targets), lambda x: (x != "") & _anchored(x, F.col("_anchor"), F.col("_all"))))
    aspect = F.trim(F.coalesce("aspect", F.lit("")))
    target = F.least(F.lit(0.9), 0.3 * present + F.when((aspect != "") & F.array_contains(targets, aspect), 0.55).otherwise(0.0))
    located = (F.coalesce("source_group", F.lit("")) != "") | F.col("chunk").isNotNull()
    related = F.least(F.lit(0.35), 0.08 * F.size(relations(text, F.col("_all"), asked, located, F.coalesce(F.col("source_type") == "visual", F.lit(False)))))
    periods = F.least(F.lit(1.0), 0.5 * F.size(F.filter(T.found(asked_text, IDENTIFIER), lambda p: F.contains(text, p))))
    group = F.when(_named(F.coalesce("source_group", F.lit("")), asked_text), 0.7).otherwise(0.0)
    kind = reduce(lambda rest, k: F.when(F.col("source_type") == k, KINDS[k]).otherwise(rest), KINDS, F.lit(0.0))
    authority = F.when(F.col("authority").startswith("T1_"), 0.16).when(F.col("authority").isin(*REVIEWED), 0.08).otherwise(0.0)
    best = F.coalesce(F.array_max(F.map_values("goals")), F.lit(0.0))
    plain = F.round(60.0 / (60 + F.col("local_rank")) + matched + table_binding(text, asked) + 4 * best + target + related + periods + group + kind + authority, 6)
    rows = rows.withColumn("score", plain).withColumn("_best", best).drop("_asked", "_terms", "_all", "_anchor")
    shared = rows.groupBy("query_id").agg(F.bool_or(F.coalesce("reranked", F.lit(False))).alias("_shared"))
    rows = rows.join(sized_broadcast(shared), "query_id")
    rows = rows.withColumn("score", F.when(F.col("_shared"), F.round(6 * F.col("_best") + 0.15 * F.col("score"), 6)).otherwise(F.col("score"))).drop("_best", "_shared")
    return ranked_within(rows, ["query_id"], ["-score", "ordinal", "id"], "position")
