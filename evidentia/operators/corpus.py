"""Corpus cleaning, exact deduplication, compaction, tagging and image-text links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

#: Artefacts of extraction: name, pattern, replacement.
REPAIRS = [("blanks_squeezed", r"[ \t]+", " "), ("space_before_sign", r" ([,.;:])", "$1"), ("marks_removed", r"[*]{3,}|#{3,}|%{3,}|&{3,}|[$]{3,}", "")]


def repaired(docs: DataFrame, text: str = "text") -> DataFrame:
    """F08. Adds ``repaired`` and ``actions``, the names of the rules that changed something (runs of blanks: two or more)."""
    out, actions = F.col(text), []
    for name, pattern, to in REPAIRS:
        seen = r"[ \t]{2,}" if name == "blanks_squeezed" else pattern
        actions.append(F.when(F.col(text).rlike(seen), F.lit(name)))
        out = F.regexp_replace(out, pattern, to)
    return docs.withColumn("repaired", out).withColumn("actions", F.filter(F.array(*actions), lambda x: x.isNotNull()))


def labelled(docs: DataFrame, categories: dict[str, list[str]], labels: dict[str, list[str]], source: str = "source", text: str = "text") -> DataFrame:
    """F12. Adds ``category`` by source (else ``general``) and ``labels`` whose key words occur in the text."""
    category = F.lit("general")
    for name, sources in categories.items():
        category = F.when(F.col(source).isin(sources), name).otherwise(category)
    low = F.lower(text)
    some = [F.when(_any(low, words), F.lit(name)) for name, words in labels.items()]
    return docs.withColumn("category", category).withColumn("labels", F.filter(F.array(*some), lambda x: x.isNotNull()))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def eligible(docs: DataFrame, scopes: list[str] | None) -> DataFrame:
    """P01. Rows of the access scopes (``access_scope``, null: public). No scope gives nothing; None restricts nothing."""
    if scopes is None:
        return docs
    return docs.where(F.coalesce("access_scope", F.lit("public")).isin(scopes) if scopes else F.lit(False))


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", flag: str | None = None) -> DataFrame:
    """A03. One row per distinct cleaned text: first id, number of members and variants, and whether ``flag`` holds for all.

    Digests are aggregated in part before the shuffle, so a text that very many rows share is a row a task; its members are
    rows of ``members``, never one list. Null texts are one group, with empty ones.
    """
    aggregates = [F.min(id).alias("first_id"), F.count("*").alias("n_members"), F.count_distinct(F.md5(F.coalesce(text, F.lit("")))).alias("n_variants")]
    if flag:
        aggregates.append(F.bool_and(flag).alias("all_" + flag))
    return docs.groupBy(F.sha2(T.squeezed(F.col(text)), 256).alias("text_key")).agg(*aggregates)


def members(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A03. (text_key, id): each row's cleaned text by its key."""
    return docs.select(F.sha2(T.squeezed(F.col(text)), 256).alias("text_key"), F.col(id))


def compacted(docs: DataFrame, policy: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """A04. Lossless compaction: per policy key and text, the first row stays; adds ``canonical_id`` and ``is_alias``."""
    key = F.sha2(T.squeezed(F.col(text)), 256)
    first = docs.groupBy(*policy, key.alias("_key")).agg(F.min(id).alias("canonical_id"))
    rows = docs.withColumn("_key", key)
    same = rows["_key"] == first["_key"]
    for c in policy:
        same = same & rows[c].eqNullSafe(first[c])
    joined = rows.join(first, same).select(*[rows[c] for c in docs.columns], "canonical_id")
    return joined.withColumn("is_alias", F.col(id) != F.col("canonical_id"))


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A17. One row, the same for the same rows in any order: their number, and sums of two halves of each row's digest.

    No row order and no list: the sums are partial aggregates.
    """
    digest = F.sha2(F.concat_ws("\u0000", F.col(id).cast("string"), F.col(text)), 256)
    part = lambda i: F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("n"), F.sum(part(1)).cast("string").alias("a"), F.sum(part(13)).cast("string").alias("b"))


def ingested(files: DataFrame, domains: list[tuple[str, list[str]]], labels: dict[str, list[str]]) -> DataFrame:
    """S31. (document_id, first, domain, records, labels, state) of files (id, name, text): each content once for a domain, which its name
    proposes (classify), with its lines (extract) and the labels whose key words it has (annotate). state (package): ``empty`` without
    text, ``needs_review`` without a domain, else ``packaged``."""
    from .catalog import first_role

    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(T.lines(text), lambda x: F.trim(x) != ""))
    rows = labelled(files.withColumn("_source", F.lit("")), {}, labels, "_source").select("id", F.concat(F.lit("doc-"), F.substring(F.sha2(text, 256), 1, 16)).alias("document_id"), first_role(F.col("name"), domains).alias("domain"), lines.alias("records"), "labels", (F.trim(text) != "").alias("_ok"))
    one = rows.groupBy("document_id", "domain", "records", "labels", "_ok").agg(F.min("id").alias("first"))
    state = F.when(~F.col("_ok"), "empty").when(F.col("domain") == "unclassified", "needs_review").otherwise("packaged")
    return one.select("document_id", "first", "domain", "records", "labels", state.alias("state"))


def linked_text(assets: DataFrame, texts: DataFrame, most: int = 4) -> DataFrame:
    """J04. The ``most`` best texts of each asset on its page by ``F41``; ties by position.

    assets: asset_id, doc, page, heading, nearby, caption, bbox; texts: chunk_id, doc, page, heading, text, bbox, ordinal.
    """
    t = texts.select("doc", "page", "chunk_id", "ordinal", F.col("text").alias("_t"), F.col("heading").alias("_h"), F.col("bbox").alias("_b"))
    rows = assets.join(t, ["doc", "page"])
    same = (T.compact(F.col("heading")) != "") & (T.compact(F.col("heading")) == T.compact(F.col("_h")))
    score = V.link_score(same, T.compact(F.col("nearby")), T.compact(F.col("caption")), T.compact(F.col("_t")), V.box_distance(F.col("bbox"), F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("score"), "ordinal"))
    return rows.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= most).select("asset_id", "chunk_id", "score", "rank")


def neighbours(items: DataFrame, keys: list[str], position: str, text: str, reach: int = 3) -> DataFrame:
    """W07. Adds ``context``: texts up to ``reach`` positions before and reach - 1 after, the row's own left out."""
    w = Window.partitionBy(*keys).orderBy(position)
    before = F.collect_list(text).over(w.rowsBetween(-reach, -1))
    after = F.collect_list(text).over(w.rowsBetween(1, reach - 1))
    return items.withColumn("context", F.concat(before, after))


def running_heading(items: DataFrame, keys: list[str], position: str, heading: str) -> DataFrame:
    """W06. Adds ``active_heading``: the last heading so far, the row's own included."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("active_heading", F.last(heading, True).over(w))
