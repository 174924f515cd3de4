"""The relational catalogue: entities, links, collections and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import workspace
from .containment import contained

#: The group of rows whose key is missing (a fixed value).
MISSING = "未登记"


def first_role(text: Column, rules: list[tuple[str, list[str]]], otherwise: str = "unclassified") -> Column:
    """F15, F23, J07. The first rule one of whose marks occurs in the text."""
    out = F.lit(otherwise)
    for name, marks in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks)), name).otherwise(out)
    return out


def without_suffix(text: Column, suffixes: list[str]) -> Column:
    """F19. The text without the first suffix that it ends with."""
    out = text
    for s in reversed(suffixes):
        out = F.when(text.endswith(s), F.substr(text, F.lit(1), F.length(text) - len(s))).otherwise(out)
    return out


def best_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """J01, W05. The first row of each key in the order given; null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consolidated(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A05. One row per entity; a field on which its rows disagree is null and named in ``conflicts``. ``disagreeing`` has the values."""
    out = rows.groupBy(key).agg(*[F.min(f).alias(f) for f in fields], *[F.max(f).alias("_max_" + f) for f in fields])
    apart = {f: F.coalesce(F.col(f) != F.col("_max_" + f), F.lit(False)) for f in fields}
    names = F.filter(F.array(*[F.when(apart[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return out.select(key, *[F.when(~apart[f], F.col(f)).alias(f) for f in fields], F.array_join(names, ";").alias("conflicts"))


def disagreeing(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A05. (key, field, value, n): the values of each field on which an entity's rows disagree, a row each, with the number of rows."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*").where("value is not null")
    counts = each.groupBy(key, "field", "value").agg(F.count("*").alias("n"))
    several = counts.groupBy(key, "field").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return counts.join(several, [key, "field"], "left_semi")


def grouped(rows: DataFrame, fields: list[str], id: str) -> DataFrame:
    """A06. Counts by fields, a missing or blank one as ``MISSING``: n, total over all groups. ``grouped_members`` has the members."""
    out = _keyed(rows, fields, id).groupBy(*fields).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("total"))))


def grouped_members(rows: DataFrame, fields: list[str], id: str) -> DataFrame:
    """A06. (fields, id, position): the members of each group, a row each, numbered by id."""
    from .ranks import ranked_within

    return ranked_within(_keyed(rows, fields, id), fields, [id], "position")


def _keyed(rows: DataFrame, fields: list[str], id: str) -> DataFrame:
    return rows.select(*[F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit(MISSING)).alias(f) for f in fields], F.col(id))


def rolled_up(rows: DataFrame, family: str, levels: list[str]) -> DataFrame:
    """A07. Per family the sorted distinct values of each level."""
    return rows.groupBy(family).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in levels])


def fuzzy_matched(left: DataFrame, right: DataFrame, least: int = 6) -> DataFrame:
    """J06. (id, match, how): names equal when normalised, else the only one that contains or is contained, both of ``least``
    characters or more. left: id, name; right: match, label. Names are searched once each, whoever bears them."""
    from ..functions.text import bare

    a = left.where("name is not null").select("id", bare(F.col("name")).alias("a"))
    b = right.where("label is not null").select("match", bare(F.col("label")).alias("b")).groupBy("b").agg(F.min("match").alias("match"), F.count("*").alias("n"))
    a, b = workspace.written(a, "names"), workspace.written(b, "labels")
    met = a.join(b.select("b", "match"), F.col("a") == F.col("b"), "left").select("id", "a", "match", F.col("b").isNotNull().alias("same"))
    equal = met.where("same").groupBy("id").agg(F.min("match").alias("match"))
    rest = met.where(~F.col("same") & (F.length("a") >= least)).join(equal.select("id"), "id", "left_anti").select("id", "a")
    rest = workspace.written(rest, "rest")
    long = b.where(F.length("b") >= least)
    own, other = rest.select("a").distinct(), long.select("b")
    pairs = contained(own, "a", "a", other, "b").union(contained(other, "b", "b", own, "a").select("a", "b")).distinct()
    found = pairs.join(long, "b").groupBy("a").agg(F.sum("n").alias("n"), F.min("match").alias("match"))
    only = rest.join(found, "a").groupBy("id").agg(F.sum("n").alias("n"), F.min("match").alias("match")).where("n = 1")
    return equal.withColumn("how", F.lit("equal")).union(only.select("id", "match", F.lit("contained").alias("how")))


#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000


def sized_broadcast(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if its rows, counted up to one over the bound, allow it; else as it is."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def located(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """J07. Adds ``location``: that of the first rule (ordinal, marker, location) whose marker the name contains; an empty marker is in every
    name. Equal rows stay apart; names are searched once each."""
    names = rows.select(F.col(name).alias("_name")).distinct()
    met = contained(names, "_name", "_name", rules, "marker").join(rules, "marker").select("_name", "ordinal", "location")
    every = rules.where("marker = ''").select("ordinal", "location")
    met = met.union(names.where("_name is not null").join(sized_broadcast(every)).select("_name", "ordinal", "location")) if not every.isEmpty() else met
    first = met.groupBy("_name").agg(F.min_by("location", "ordinal").alias("location"))
    return rows.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


def mentions(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """J08, J17. (doc_id, name_id) where a name of ``least`` characters or more occurs in a text. texts: doc_id, text; names: name_id, name."""
    held = names.where(F.length("name") >= least).select("name_id", "name")
    return contained(texts, "doc_id", "text", held, "name").join(sized_broadcast(held), "name").select("doc_id", "name_id")


def scope_closure(seeds: DataFrame, product_case: DataFrame, product_evidence: DataFrame, case_evidence: DataFrame, evidence: DataFrame, scopes: list[str]) -> DataFrame:
    """J15. Evidence reachable from seed products: their own, that of their cases one hop away; the access filter comes last.

    seeds: product; product_case: product, case; *_evidence: product or case, evidence; evidence: evidence, access_scope.
    """
    from .corpus import eligible

    own = seeds.select("product").distinct()
    cases = product_case.join(own, "product", "left_semi").select("case").distinct()
    found = product_evidence.join(own, "product", "left_semi").select("evidence").union(case_evidence.join(cases, "case", "left_semi").select("evidence")).distinct()
    return eligible(found.join(evidence, "evidence"), scopes).select("evidence")


def rekeyed(edges: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """U11, U12. Edges moved to canonical ids (alias, canonical), without repeats. Same scope is required of both, if the edges have one."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    moved = edges.join(a, F.col(key) == F.col("_a"), "left").withColumn(key, F.coalesce("_c", key)).drop("_a", "_c")
    return moved.dropDuplicates()
