"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values, the smallest and the largest
hash of a document's shingles, so half as many hash evaluations make a
signature as long; both match with the probability of the sets' similarity.
Values of different functions are banded; documents that share a band are
candidates, confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .components import components

#: Signature values in a band, and the chance at most that a pair at the threshold shares none.
ROWS, MISS = 4, 1e-5
#: Pairs of one set that a task may get: a set with more of them is sent to several tasks.
HUB = 4096
_U = np.uint64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands (an even number) so that a pair at the threshold is missed with a chance of ``miss`` at most."""
    n = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    return n + n % 2


def shingle_sets(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, end to end, and their offsets."""
    n = np.diff(offsets)
    g = words.grams(h, k)
    start = np.arange(len(g))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + k <= offsets[doc + 1] if len(g) else np.empty(0, bool)
    doc, g = doc[inside], g[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            run = h[offsets[d] : offsets[d + 1]]
            extra[i] = words.grams(run, len(run))[0] ^ _U(len(run))
        doc, g = np.concatenate((doc, short)), np.concatenate((g, extra))
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[first], g[first]
    return g, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(g: np.ndarray, offsets: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes (documents x bands); rows without shingles are 0."""
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[:-1][full]
    half = bands // 2 * rows
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 1 << 63, half, dtype=np.uint64) * _U(2) + _U(1)
    add = rng.integers(0, 1 << 63, half, dtype=np.uint64)
    values = np.empty((2, half, len(full)), np.uint64)
    for i in range(half if len(full) else 0):
        x = g * mult[i]
        x += add[i]
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        values[0, i], values[1, i] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for side in range(2):
        for b in range(bands // 2):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                key = key * _U(0x9FB21C651E98DF25) + values[side, b * rows + r]
            out[full, side * (bands // 2) + b] = words._mix(key)
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(words.signed(rows).reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int64()))


def signed_documents(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (the set's fingerprint), bands."""
    bands = bands_for(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, h, o in words.hashed(batch.column(1), words.SPACE, words.LOWER):
                g, at = shingle_sets(h, o, k)
                total = np.concatenate(([0], np.cumsum(g, dtype=np.uint64)))
                other = np.concatenate(([0], np.cumsum(words._mix(g ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)))
                keys = signatures(g, at, bands)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(at)), pa.array(words.signed(total[at[1:]] - total[at[:-1]])), pa.array(words.signed(other[at[1:]] - other[at[:-1]])), _lists(keys)],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.lean(sign), "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, flat: bool = False) -> DataFrame:
    """(id, shingles as bytes) of the documents whose id is in ``wanted``, and of few others; ``flat``: (id, t), a row a shingle
    of those in ``wanted`` alone. A written table."""
    bitmap = docs.sparkSession.sparkContext.broadcast(scratch.id_bitmap(wanted, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(scratch.in_bitmap(bitmap.value, slots)))
            for i, j, h, o in words.hashed(batch.column(1), words.SPACE, words.LOWER):
                g, at = shingle_sets(h, o, k)
                ids = batch.column(0).slice(i, j - i)
                if flat:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(j - i), np.diff(at)))), pa.array(words.signed(g))], names=["id", "t"])
                    continue
                at32 = pa.array(at * 8, pa.int64())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, at32.buffers()[1], pa.py_buffer(g.tobytes())])
                yield pa.RecordBatch.from_arrays([ids, data.cast(pa.binary())], names=["id", "shingles"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "id long, t long" if flat else "id long, shingles binary"
    out = rows.select("doc_id", "text", scratch.id_slot("doc_id").alias("slot")).mapInArrow(words.lean(sets), schema)
    out = scratch.written(out.join(wanted, "id", "left_semi") if flat else out, "sets")
    bitmap.destroy()
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (a, b), those whose full shingle sets are similar enough; and the table of sets that this reads."""
    sets = _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            last, key = None, None
            for i in range(batch.num_rows):
                bits = a[i].as_buffer()
                if key is None or not bits.equals(key):
                    last, key = np.frombuffer(bits, np.uint64), bits
                y = np.frombuffer(b[i].as_buffer(), np.uint64)
                small, large = (last, y) if len(last) < len(y) else (y, last)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                ok[i] = 100 * both >= percent * (len(small) + len(large) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    # only hubs are sent to several tasks; at most a row for each HUB pairs
    hubs = scratch.sized(pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / HUB).alias("salts")).where("salts > 1"))
    dealt = pairs.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"))
    left = sets.join(hubs, F.col("id") == F.col("hub"), "left").select("id", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("part"))
    right = dealt.join(sets.withColumnRenamed("shingles", "y"), F.col("b") == F.col("id")).select("a", "b", "salt", "y")
    full = right.join(left, (F.col("a") == F.col("id")) & (F.col("salt") == F.col("part"))).select("a", "b", "x", "y")
    return full.mapInArrow(words.lean(check), "a long, b long"), sets


def _rare_pairs(rows: DataFrame, docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), and the table that they are read from: pairs of ``rows`` (rep, n, comp) of different components that may reach the threshold.

    Lossless: in the order of rarest shingles first, a pair at the threshold shares
    one among the first n - ceil(2tn / (1 + t)) + 1 of its smaller set and the first
    n - ceil(tn) + 1 of its larger, with enough shingles behind it in both. So a
    family of variants of one text meets only where its members' own changes allow
    it, not in all its pairs.
    """
    wanted = rows.select(F.col("rep").alias("id"))
    t = _sets(docs, wanted, k, flat=True)
    often = t.groupBy("t").agg(F.count("*").alias("f"))
    rank = t.join(often, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    q = percent / 100
    rank = rank.join(rows, F.col("id") == F.col("rep")).withColumn("probe", F.col("n") - F.ceil(F.col("n") * q - 1e-9) + 1)
    index = F.col("n") - F.ceil(F.col("n") * (2 * q / (1 + q)) - 1e-9) + 1
    few = rank.select("id", "n", "comp", index.alias("index"), F.posexplode(F.slice("s", F.lit(1), F.col("probe").cast("int"))).alias("i", "e")).select("id", "n", "comp", "index", "i", F.col("e.t").alias("t"))
    few = scratch.written(few, "rare")
    scratch.forget(t)
    x, y = few.where("i < index").alias("x"), few.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    behind = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = behind >= (F.col("x.n") + F.col("y.n")) * (q / (1 + q)) - 1e-9
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & smaller & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") * 100 >= F.col("y.n") * percent) & enough)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), few


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A & B| >= percent * |A | B| over their sets of
    distinct ``k``-word shingles (A-Z lower-cased; fewer words: all of them as one).
    Shingles are compared by 64-bit hashes, whole sets against whole sets. Sets with
    equal sizes and equal 128-bit fingerprints (two sums of hashes) count as one: a
    class of copies, however large, is one node. In each
    bucket of a band all are held against the bucket's smallest id; then the documents
    of buckets that still have several components meet by their rarest shingles, so
    no link of a bucket is lost and a group of copies never becomes all its pairs.

    A null or empty text has 0 shingles and its own component. A null doc_id links
    with nothing (component_id null, kept). A repeated doc_id is judged row by row.
    Further columns, whatever their names, are not read. No rows give no rows.
    """
    sig = scratch.written(signed_documents(docs, percent, k), "signatures")
    known = sig.where("doc_id is not null and n > 0")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.written(classes, "classes")

    rows = classes.select("rep", "n", F.posexplode("bands").alias("j", "h"))
    hubs = rows.groupBy("j", "h").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("j", "h", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    stars = rows.select("j", "h", "rep", "n").join(hubs, ["j", "h"]).where((F.col("rep") != F.col("hub")) & near(F.col("n"), F.col("hub_n")))
    stars = scratch.written(stars.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links, sets = confirmed(stars, docs, percent, k)
    labels = components(links)
    scratch.forget(sets)

    # what is still apart within a bucket
    left = rows.select("rep", "n", "j", "h").join(labels, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep"))
    mixed = left.groupBy("j", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("j", "h")
    left = scratch.written(left.join(mixed, ["j", "h"], "left_semi").select("rep", "n", "comp").distinct(), "apart")
    met, few = _rare_pairs(left, docs, percent, k)
    rest = scratch.written(met.join(stars, ["a", "b"], "left_anti"), "rest")
    for done in (left, few, stars):
        scratch.forget(done)
    more, sets = confirmed(rest, docs, percent, k)
    labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    scratch.forget(sets)

    of = classes.join(labels, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("component", "rep").alias("c"))
    out = sig.select("doc_id", "n", "f1", "f2").alias("s").join(of.alias("o"), (F.col("s.f1") == F.col("o.f1")) & (F.col("s.f2") == F.col("o.f2")) & (F.col("s.n") == F.col("o.m")), "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
