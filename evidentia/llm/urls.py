"""URL filtering by rules and by a path-template tree.

Each host has a tree of path segments. Numbers and long hexadecimal runs in a
segment become wildcards; so do a node's children if they are many and rarely
repeat. Then, level by level from the host down, sibling branches whose share of
bad labels doesn't differ from that of all of them together become one branch,
whose children are siblings at the next level. A template's share is smoothed
towards the share of all labels, and one above the cutoff is rejected.

The tree is made from counts by host and template, level by level, so no task
holds a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Children of a node from which they may be a wildcard, and their mean pages below which they are.
CHILDREN, REPEATS = 20, 5
#: Levels of the tree by default. Pseudo-labels of the prior, cutoff, and z of a differing sibling.
LEVELS, PRIOR, CUTOFF, Z = 8, 5.0, 0.5, 1.96
#: The segment of merged branches, which no path has.
MERGED = "/"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for a null."""
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for a null."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does. A rule is ``host/path``; it fits its host and
    all subdomains where the path starts with its own. Of equally long rules the first counts."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def segments(path: Column, depth: int = LEVELS) -> Column:
    """The path's segments with numbers and hexadecimal runs as wildcards; those from the ``depth``-th on joined to one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)(?=[0-9a-f-]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*", "*"), r"[0-9]+", "*"))
    deep = F.concat(F.slice(shaped, 1, depth - 1), F.array(F.array_join(F.slice(shaped, depth, 1 << 30), "/")))
    return F.when(F.size(shaped) > depth, deep).otherwise(shaped)


def templates(pages: DataFrame) -> DataFrame:
    """(host, key, template, bad_share, rejected) of every host and shaped path (key) of ``pages`` (host, key, bad).

    ``bad``: 1, 0 or null where a page has no label. In a template ``*`` is a
    variable segment and ``+`` a branch merged of several.
    """
    counts = pages.groupBy("host", "key").agg(F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    tree = scratch.written(counts.withColumn("t", F.split("key", "/")), "templates")
    head = tree.agg(F.max(F.size("t")), F.sum("m"), F.sum("b")).first()
    prior = (head[2] or 0) / head[1] if head[1] else 0.0
    for level in range(head[0] or 0):
        at = F.get("t", F.lit(level))
        above = F.slice("t", 1, level)
        children = tree.where(at.isNotNull()).groupBy("host", above.alias("above"), at.alias("child")).agg(F.sum("n").alias("n"))
        wild = children.groupBy("host", "above").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        wild = wild.where((F.col("kinds") > CHILDREN) & (F.col("n") < REPEATS * F.col("kinds"))).select(F.col("host").alias("h"), F.col("above").alias("a"), F.lit(True).alias("wild"))
        tree = tree.join(wild, (F.col("host") == F.col("h")) & (above == F.col("a")), "left")
        star = F.concat(F.slice("t", 1, level), F.array(F.lit("*")), F.slice("t", level + 2, 1 << 30))
        tree = scratch.written(tree.withColumn("t", F.when(F.col("wild") & at.isNotNull(), star).otherwise(F.col("t"))).drop("h", "a", "wild"), "templates")
        branches = tree.where(at.isNotNull()).groupBy("host", above.alias("above"), at.alias("child")).agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
        pools = branches.groupBy("host", "above").agg(F.sum("m").alias("pm"), F.sum("b").alias("pb"))
        share = F.try_divide("pb", "pm")
        near = F.abs(F.try_divide("b", "m") - share) <= Z * F.sqrt(share * (1 - share) / F.col("m")) + 1e-12
        alike = branches.join(pools, ["host", "above"]).where((F.col("m") == 0) | near)
        several = alike.groupBy("host", "above").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        alike = alike.join(several, ["host", "above"]).select(F.col("host").alias("h"), F.col("above").alias("a"), F.col("child").alias("c"), F.lit(True).alias("alike"))
        merged = F.concat(F.slice("t", 1, level), F.array(F.lit(MERGED)), F.slice("t", level + 2, 1 << 30))
        before, tree = tree, tree.join(alike, (F.col("host") == F.col("h")) & (above == F.col("a")) & (at == F.col("c")), "left")
        tree = scratch.written(tree.withColumn("t", F.when(F.col("alike"), merged).otherwise(F.col("t"))).drop("h", "a", "c", "alike"), "templates")
        scratch.forget(before)
    leaves = tree.groupBy("host", "t").agg(((F.sum("b") + PRIOR * prior) / (F.sum("m") + PRIOR)).alias("bad_share"))
    out = tree.select("host", "key", "t").join(leaves, ["host", "t"])
    named = F.transform("t", lambda x: F.when(x == MERGED, "+").otherwise(x))
    return out.select("host", "key", F.concat(F.lit("/"), F.array_join(named, "/")).alias("template"), "bad_share", (F.col("bad_share") > CUTOFF).alias("rejected"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], depth: int = LEVELS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, ...): page_id, host, path, rule, verdict, template, bad_share.

    verdict (allow or block): that of the longest rule that fits, else the template's.
    ``labels`` (page_id, bad: 0 or 1): of several for a page the largest counts, others
    than 0 and 1 are ignored; a null page_id has no label. A null url, or one without
    ``://``, has an empty host and path. Repeated ids are judged row by row. Further
    columns are not read. No rows give no rows; without labels nothing is rejected.
    ``depth``: levels of the tree, a round each; what a path has below the last but one is one segment of it.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("key", F.array_join(segments(F.col("path"), depth), "/"))
    marks = labels.where("bad in (0, 1) and page_id is not null").groupBy(F.col("page_id").alias("id")).agg(F.max("bad").alias("bad"))
    tree = templates(rows.join(marks, F.col("page_id") == F.col("id"), "left"))
    tree = tree.withColumnRenamed("host", "h").withColumnRenamed("key", "k")
    out = rows.join(tree, (F.col("host") == F.col("h")) & (F.col("key") == F.col("k")), "left").withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share"))
