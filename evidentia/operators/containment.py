"""Which texts contain which names, without a join of all with all.

Names up to a bound of bytes become an Aho-Corasick automaton, which each task compiles once and runs over its texts in
Arrow batches: a text is read once, however many names there are. Beyond the bound each name is anchored on the rarest of
its grams (runs of characters), texts meet names in an equi join on grams, and only such pairs are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: UTF-8 bytes of names that one automaton holds, about a hundred times as many in memory; characters of the longest gram.
NAME_BYTES, MOST = 2_000_000, 32
_compiled: dict[int, ahocorasick.Automaton] = {}


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name): the distinct names that stand in a text of a key. Empty and null names and texts are in nothing, nor hold anything.

    A key may be of any type that can be grouped; names are compared as they are, character by character.
    """
    wanted = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    size = wanted.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    out = _by_automaton(rows, wanted) if size <= NAME_BYTES else _by_grams(rows, wanted)
    return out.select(F.col("key").alias(key), F.col("name").alias(name))


def _by_automaton(rows: DataFrame, names: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(sorted(r[0] for r in names.collect()))
    mark = id(sent)

    def automaton() -> ahocorasick.Automaton:
        if mark not in _compiled:
            _compiled.clear()
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, n in enumerate(sent.value):
                made.add_word(n, i)
            made.make_automaton()
            _compiled[mark] = made
        return _compiled[mark]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = {n for _, n in automaton().iter(t)}
                at += [i] * len(own)
                found += [sent.value[n] for n in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "name"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, name string").distinct()


def _grams(text: str, length: int) -> F.Column:
    """All runs of ``length`` characters, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(.{%d}))" % length), F.lit(1)))


def _by_grams(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Equi joins only: names by the rarest of their grams as long as the largest power of two that fits (``MOST`` at most), texts by those
    of their grams that are anchors. Long grams leave few false pairs where names are alike."""
    level = F.least(F.lit(MOST), F.pow(F.lit(2), F.floor(F.log2(F.length("name")))).cast("int"))
    names = names.withColumn("level", level)
    levels = sorted(r[0] for r in names.select("level").distinct().collect())
    own = reduce(lambda rest, n: F.when(F.col("level") == n, _grams("name", n)).otherwise(rest), levels, F.array().cast("array<string>"))
    grams = names.select("name", F.explode(own).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    first = Window.partitionBy("name").orderBy("n", "gram")
    anchors = grams.join(often, "gram").withColumn("k", F.row_number().over(first)).where("k = 1").select("name", "gram")
    seen = F.concat(*(_grams("text", n) for n in levels))
    met = rows.select("key", F.explode(seen).alias("gram")).join(anchors, "gram").select("key", "name").distinct()
    return met.join(rows, "key").where(F.contains("text", F.col("name"))).select("key", "name").distinct()
