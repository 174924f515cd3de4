"""Passages of equal text become one, which keeps what each of them was found for (inventory U04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import workspace

#: Characters from which equal texts are the same passage (a fixed value).
LEAST = 32


def fingerprint(text: Column) -> Column:
    """Letters, digits and ideographs of a text without case; empty for null."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), r"[^0-9a-z\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+", "")


def merged_passages(rows: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """U04. (kept, members).

    kept: query_id, id, n (passages that it stands for, itself included), goals (map<string, double>, the best score of each goal), aspects (each
    once, by the first passage that has it and its place there). members: query_id, id, kept_id of every passage, its own id if it stays.

    rows: query_id, id, place (order of the passages; ids decide equals), text, document, required (its document was asked for: it merges only
    with passages of that document), goals map<string, double>, aspects array<string>. Passages whose fingerprint has fewer than
    ``least`` characters stay. Null goals and aspects are none, a null score is none, a null flag is false.

    A text of any number of copies is added up before the shuffle, by its digest: members travel as rows, scores as maxima of (text, goal).
    """
    print_ = fingerprint(F.col("text"))
    own = F.concat(F.lit("i"), F.col("id").cast("string"))
    file = F.when(F.coalesce("required", F.lit(False)), F.concat(F.lit("d"), F.coalesce("document", F.lit("")))).otherwise("")
    key = F.when(F.length(print_) + F.when(file == "", 0).otherwise(F.length(file)) >= least, F.sha2(F.concat_ws("\u0001", F.lit("t"), file, print_), 256)).otherwise(F.sha2(own, 256))
    keyed = rows.select("query_id", "id", "place", key.alias("key"), "goals", "aspects").withColumn("query_id", F.struct("query_id"))
    keyed = workspace.written(keyed, "passages")
    at = F.struct("place", "id")
    firsts = keyed.groupBy("query_id", "key").agg(F.min(at)["id"].alias("kept_id"), F.count("*").alias("n"))
    scores = keyed.select("query_id", "key", F.explode("goals").alias("goal", "score")).where("score is not null")
    scores = scores.groupBy("query_id", "key", "goal").agg(F.max("score").alias("score"))
    goals = scores.groupBy("query_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("goal", "score")))).alias("goals"))
    named = keyed.select("query_id", "key", "place", "id", F.posexplode("aspects").alias("i", "aspect")).where("aspect is not null")
    named = named.groupBy("query_id", "key", "aspect").agg(F.min(F.struct("place", "id", "i")).alias("first"))
    aspects = named.groupBy("query_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "aspect"))), lambda x: x["aspect"]).alias("aspects"))
    kept = firsts.join(goals, ["query_id", "key"], "left").join(aspects, ["query_id", "key"], "left")
    none = F.create_map().cast("map<string,double>")
    kept = kept.select("query_id.query_id", F.col("kept_id").alias("id"), "n", F.coalesce("goals", none).alias("goals"), F.coalesce("aspects", F.array().cast("array<string>")).alias("aspects"))
    members = keyed.select("query_id", "key", "id").join(firsts.select("query_id", "key", "kept_id"), ["query_id", "key"])
    return kept, members.select("query_id.query_id", "id", "kept_id")
