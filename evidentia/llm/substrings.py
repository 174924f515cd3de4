"""Removal of word passages that occur more than once, by suffix automata of reference shards.

Against a stated reference (``without_reference``) the automata of its shards are
broadcast and documents stream past them. Within one corpus (``without_repeats``)
every document is reference too, and streaming all documents past all shards is
quadratic. So reference and documents are cut alike: each window of ``least`` words
is routed by its smallest n-gram hash, which equal windows share; neighbouring
windows with the same n-gram form a segment. Segments whose n-gram occurs once
repeat nothing and are left out of both. What is left is the reference: its routes
are dealt out in shards bounded by words, each shard has its automaton, and the
segments of its routes stream past it; whether a window repeats is read from the
matching statistics alone, word by word. A route with more different words than an
even share of a shard first loses the windows that stand once, by a count of windows'
hashes, and is routed again if need be, by longer n-grams and at last by whole windows.

Words are compared by 64-bit hashes. Equal segments are one with a weight; equal
means the same n-gram hash, the same hash of all words, and the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .automaton import Automaton

#: Words of the n-gram that routes a window at first; windows of a segment at most; words of a shard (about 0.5 KB each in an automaton),
#: and of a route at most, so that shards come out even.
GRAM, RUN, SHARD, ROUTE = 8, 4096, 20_000, 2_500
#: N-grams of the second routing are so many words shorter than a window.
SHORTER = 7
#: Words hashed at once, and words of a stated reference at most.
CHUNK, REFERENCE = 1 << 20, 20_000_000
_U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def segments(h: np.ndarray, offsets: np.ndarray, least: int, gram: int = GRAM):
    """(document, first window, windows, route, content, alone) of every segment; ``alone``: False where a window may
    repeat within the segment itself."""
    gram = min(gram, least)
    width = least - gram + 1
    g = words.grams(h, gram)
    empty = np.empty(0, np.int64)
    if len(g) < width:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    low = _sliding_min(g, width)
    at = np.arange(len(low))
    doc = np.searchsorted(offsets, at, "right") - 1
    good = at + least <= offsets[doc + 1]
    at, low, doc = at[good], low[good], doc[good]
    first = np.ones(len(at), bool)
    first[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(first)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first |= nth % RUN == 0
    run = np.flatnonzero(first)
    count = np.diff(np.append(run, len(at)))
    begin, doc, route = at[run], doc[run], low[run]
    again = np.zeros(len(g) + 1, np.int64)
    for d in range(1, min(width, len(g) - 1) + 1):
        again[1 : len(g) - d + 1] |= g[:-d] == g[d:]
    again = np.cumsum(again)
    alone = again[np.minimum(begin + count - 1 + width, len(g))] == again[begin]
    return doc, begin - offsets[doc], count, route, _content(h, begin, count, least), alone


def _content(h: np.ndarray, begin: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """A hash of the words of ``count`` windows from each ``begin``."""
    up, down = words._power(len(h))
    total = np.concatenate(([_U(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return words._mix((total[begin + count + least - 1] - total[begin]) * down[begin] + count.astype(np.uint64))


def _chunks(h: np.ndarray, least: int, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of one long document's words, so that every window is in just one."""
    for i in range(0, max(len(h) - least + 1, 1), size):
        yield i, h[i : i + size + least - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, k, text, slot): a row is known by its id and its content, so repeated and null ids need no care."""
    k = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    k = k.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("k"), "text")
    return k.withColumn("slot", scratch.id_slot("k"))


def _segments(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for i, j, h, o in words.hashed(batch.column(2)):
                for shift, part in _chunks(h, least) if j == i + 1 else [(0, h)]:
                    doc, begin, count, route, content, alone = segments(part, np.array([0, len(part)]) if j == i + 1 else o, least)
                    rows = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), keys.take(rows), pa.array((begin + shift).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(words.signed(route)), pa.array(words.signed(content)), pa.array(alone)],
                        names=["id", "k", "a", "m", "v", "c", "alone"],
                    )

    return docs.select("id", "k", "text").mapInArrow(words.lean(run), "id long, k long, a int, m int, v long, c long, alone boolean")


def _let_through(df: DataFrame, bitmap) -> DataFrame:
    """Rows whose ``slot`` (the last column) is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = scratch.in_bitmap(bitmap.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit))

    return df.mapInArrow(words.lean(run), df.schema)


def _contents(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(v, c, w, size in words, words) of the segments in ``wanted`` (id, k, a, m, v, c, w). A written table."""
    spark = docs.sparkSession
    per = wanted.groupBy("id", "k").agg(F.collect_list(F.struct("a", "m", "v", "c", "w")).alias("s"))
    bitmap = spark.sparkContext.broadcast(scratch.id_bitmap(wanted.select("k").distinct(), "k"))
    rows = _let_through(docs.select("id", "k", "text", "slot"), bitmap).drop("slot").join(per, ["id", "k"]).dropDuplicates(["id", "k"]).select("text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for i, j, h, o in words.hashed(batch.column(0)):
                part = lists.slice(i, j - i)
                flat = part.flatten()
                if not len(flat):
                    continue
                row = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
                a, m = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                begin = o[row] + a
                data = [h[x : x + y + least - 1].tobytes() for x, y in zip(begin.tolist(), m.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), flat.field(4), pa.array(m.astype(np.int64) + least - 1), pa.array(data, pa.binary())], names=["v", "c", "w", "size", "words"])

    out = scratch.written(rows.mapInArrow(words.lean(run), "v long, c long, w long, size long, words binary"), "contents")
    bitmap.destroy()
    return out


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(starts):
        edge = np.flatnonzero(np.diff(starts) != 1) + 1
        for part in np.split(starts, edge):
            yield int(part[0]), len(part)


_SPANS = "array<struct<s:int,n:int>>"


def _by_automaton(rows: DataFrame, least: int) -> DataFrame:
    """(v, c, runs): where each segment's windows repeat, as runs (first window, windows); rows: (shard, v, c, w, words), whole shards in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[int]]] = []
        shard = None

        def settle() -> pa.RecordBatch:
            auto = Automaton()
            for _, _, w, seq in held:
                auto.add(seq, w)
            auto.close()
            out = []
            for v, c, _, seq in held:
                again = [i + n - least for i, n, places in auto.matches(seq, least) if places > 1]
                if again:
                    out.append((v, c, [{"s": s, "n": n} for s, n in _runs(np.array(again, np.int64))]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["v", "c", "runs"])

        for batch in batches:
            for k, v, c, w, data in zip(*(batch.column(x).to_pylist() for x in range(4)), batch.column(4), strict=True):
                if k != shard and held:
                    yield settle()
                    held = []
                shard = k
                held.append((v, c, w, np.frombuffer(data.as_buffer(), np.uint64).tolist()))
        if held:
            yield settle()

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(words.lean(run), f"v long, c long, runs {_SPANS}")


def _moved(by: str):
    """Runs counted from an earlier word."""
    return F.transform("runs", lambda x: F.struct((x["s"] + F.col(by)).alias("s"), x["n"].alias("n")))


def _slot(r: np.ndarray) -> np.ndarray:
    return (words._mix(r.view(np.uint64)) % _U(scratch.BITS)).astype(np.int64)


def _recut(rows: DataFrame, least: int, gram: int, bitmap) -> DataFrame:
    """The segments by ``gram`` words within segments (v, c, w, words) whose routes are in the bitmap: (v, c, w, s, m, r, c2, alone,
    words), r and c2 being route and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(x).to_numpy() for x in range(3)]
            held: list[tuple] = []
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                _, s, m, r, c, alone = segments(h, np.array([0, len(h)]), least, gram)
                on = scratch.in_bitmap(bitmap.value, _slot(r))
                s, m = s[on], m[on]
                held.append((np.full(len(s), i), s, m, r[on], c[on], alone[on], [h[x : x + y + least - 1].tobytes() for x, y in zip(s.tolist(), m.tolist(), strict=True)]))
            if not held:
                continue
            row, s, m, r, c, alone = (np.concatenate([x[k] for x in held]) for k in range(6))
            cols = [pa.array(k[row]) for k in keys] + [pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(words.signed(r)), pa.array(words.signed(c)), pa.array(alone)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([d for x in held for d in x[6]], pa.binary())], names=["v", "c", "w", "s", "m", "r", "c2", "alone", "words"])

    return rows.mapInArrow(words.lean(run), "v long, c long, w long, s int, m int, r long, c2 long, alone boolean, words binary")


#: Bits of the bitmap in a slice.
_SLICE = 1 << 20


def _shared_slots(rows: DataFrame, least: int, gram: int) -> np.ndarray:
    """A bitmap of the slots of routes by ``gram`` words that stand in several places of the segments (v, c, w, words), and of few others.

    Most such routes stand once, at the edges of a common passage, so they don't travel as rows: a batch's slots go as one packed
    list a slice, and each slice is counted in one task. The driver gets the bitmap, whose size is fixed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, found = batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                _, _, _, r, _, alone = segments(h, np.array([0, len(h)]), least, gram)
                found.append(_slot(r) << 1 | (~alone | (w[i] > 1)))
            if not found:
                continue
            every = np.concatenate(found)
            slots, first, n = np.unique(every >> 1, return_index=True, return_counts=True)
            several = (n > 1) | np.isin(slots, every[every & 1 == 1] >> 1)
            part = slots // _SLICE
            edge = np.searchsorted(part, np.unique(part))
            parts = [(int(part[a]), slots[a:b] % _SLICE, several[a:b]) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(slots)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1].astype(np.int32).tobytes() for p in parts], pa.binary()), pa.array([p[2].tobytes() for p in parts], pa.binary())], names=["slice", "slots", "several"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, slots, several in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if k != at:
                    if at is not None:
                        yield out()
                    at, once, twice = k, np.zeros(_SLICE, bool), np.zeros(_SLICE, bool)
                slots, several = np.frombuffer(slots.as_buffer(), np.int32), np.frombuffer(several.as_buffer(), bool)
                twice[slots[several | once[slots]]] = True
                once[slots] = True
        if at is not None:
            yield out()

    packed = rows.select("w", "words").mapInArrow(words.lean(cut), "slice int, slots binary, several binary")
    bits = np.zeros(scratch.BITS // 64, np.int64)
    for r in packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(words.lean(count), "slice int, bits binary").collect():
        bits[r["slice"] * _SLICE // 64 : (r["slice"] + 1) * _SLICE // 64] = np.frombuffer(r["bits"], np.int64)
    return bits


def _trimmed(rows: DataFrame, least: int, bitmap) -> DataFrame:
    """What is left of segments (v, c, w, words) without the windows that stand once, which a bitmap of windows leaves out: as ``_recut``, by
    runs of windows, under their old routes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = [batch.column(x).to_numpy() for x in range(3)], []
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                g = words.grams(h, least)
                runs = list(_runs(np.flatnonzero(scratch.in_bitmap(bitmap.value, _slot(g)))))
                s, m = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ((), ())))
                alone = np.array([len(np.unique(g[x : x + y])) == y for x, y in runs], bool)
                held.append((np.full(len(s), i), s, m, _content(h, s, m, least), alone, [h[x : x + y + least - 1].tobytes() for x, y in runs]))
            if not held:
                continue
            row, s, m, c, alone = (np.concatenate([x[k] for x in held]) for k in range(5))
            cols = [pa.array(k[row]) for k in keys] + [pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(keys[0][row]), pa.array(words.signed(c)), pa.array(alone)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([d for x in held for d in x[5]], pa.binary())], names=["v", "c", "w", "s", "m", "r", "c2", "alone", "words"])

    return rows.mapInArrow(words.lean(run), "v long, c long, w long, s int, m int, r long, c2 long, alone boolean, words binary")


def _found(rows: DataFrame, least: int, grams: list[int], whole: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(v, c, runs): where the windows of the segment known by (v, c) also start elsewhere; and the tables that this reads. A
    segment may come in several rows.

    rows: a table of distinct segments (v, c, w: how often it stands, size, words) of routes v
    that occur more than once. A route that is over ``ROUTE`` first loses the windows that
    stand once (``whole``: it hasn't yet), which makes the many edges of a common passage
    equal; one that still is gets routed again, by n-grams of ``grams`` words, the last being ``least``.
    """
    spark, read = rows.sparkSession, [rows]
    routes = rows.groupBy("v").agg(F.sum("size").alias("all"))
    cold = F.lit(True) if not whole and not grams else F.col("all") <= ROUTE
    total, hot = routes.agg(F.sum(F.when(cold, F.col("all"))), F.count_if(~cold)).first()
    shards = max(-(-int(total or 0) // SHARD), 1)
    dealt = routes.where(cold).select("v", F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"))
    out = _by_automaton(rows.join(dealt, "v").select("shard", "v", "c", "w", "words"), least)
    if hot:
        large = rows.join(routes.where(~cold).select("v"), "v", "left_semi").select("v", "c", "w", "words").repartition("v", "c")
        bits = spark.sparkContext.broadcast(_shared_slots(large, least, least if whole else grams[0]))
        every = scratch.written(_trimmed(large, least, bits) if whole else _recut(large, least, grams[0], bits), "segments")
        bits.destroy()
        kinds = every.groupBy("r", "c2").agg(F.sum("w").alias("w"), F.min("alone").alias("alone"), F.first("words").alias("words"))
        kinds = scratch.written(kinds.select(F.col("r").alias("v"), F.col("c2").alias("c"), "w", "alone", (F.length("words") / 8).cast("long").alias("size"), "words"), "kinds")
        shared = kinds.groupBy("v").agg(F.sum("w").alias("n"), F.min("alone").alias("alone")).where("n > 1 or not alone").select("v")
        inner, more = _found(kinds.join(shared, "v", "left_semi").select("v", "c", "w", "size", "words"), least, grams if whole else grams[1:], False)
        inner = inner.select(F.col("v").alias("r"), F.col("c").alias("c2"), "runs")
        parts = every.select("v", "c", "s", "r", "c2").join(inner, ["r", "c2"]).select("v", "c", _moved("s").alias("runs"))
        out = out.union(parts.groupBy("v", "c").agg(F.flatten(F.collect_list("runs")).alias("runs")))
        read += [every, kinds, *more[1:]]
    return out, read


def repeated_windows(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, k, spans): where the windows of ``least`` words of the row known by (id, k) also start elsewhere; and the tables that this reads.

    ``docs``: of ``_keyed``.
    """
    spark = docs.sparkSession
    whole = _segments(docs, least)  # cut twice, as writing all segments costs more than cutting them again
    shared = whole.groupBy("v").agg(F.count("*").alias("n"), F.min("alone").alias("alone")).where("n > 1 or not alone").select("v")
    bitmap = spark.sparkContext.broadcast(scratch.id_bitmap(shared, "v"))
    every = scratch.written(_let_through(whole.withColumn("slot", scratch.id_slot("v")), bitmap).drop("slot"), "segments")
    bitmap.destroy()
    kinds = every.groupBy("v", "c").agg(F.count("*").alias("w"), F.min("alone").alias("alone"), F.min(F.struct("id", "k", "a")).alias("rep"), F.first("m").alias("m"))
    kinds = scratch.written(kinds, "kinds")
    routes = kinds.groupBy(F.col("v").alias("r")).agg(F.sum("w").alias("n"), F.min("alone").alias("alone")).where("n > 1 or not alone").select("r")
    wanted = kinds.join(routes, F.col("v") == F.col("r"), "left_semi").select("rep.id", "rep.k", "rep.a", "m", "v", "c", "w")
    text = _contents(docs, wanted, least)
    scratch.forget(kinds)
    first = min(GRAM, least)
    found, read = _found(text, least, sorted({g for g in (least - SHORTER, least) if g > first}))
    rows = every.join(found, ["v", "c"]).select("id", "k", _moved("a").alias("runs"))
    return rows.groupBy("id", "k").agg(F.flatten(F.collect_list("runs")).alias("spans")), [every, *read]


def _cut(text: bytes, spans: list[tuple[int, int]], least: int) -> tuple[bytes, int, int]:
    """The words outside of all windows, joined by a space; their number before, and the number removed."""
    parts = text.split()
    n = len(parts)
    if not spans:
        return b" ".join(parts), n, 0
    step = np.zeros(n + 1, np.int64)
    for s, k in spans:
        step[s] += 1
        step[min(s + k + least - 1, n)] -= 1
    stay = np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()
    return b" ".join([parts[i] for i in stay]), n, n - len(stay)


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_removed, text.

    Words are ``[^\\x20\\x09-\\x0D]+``. Each word covered by a window of ``least``
    words whose sequence also starts anywhere else, in the same document or another,
    is removed; all copies go, judged on the input. What stays is joined by single
    spaces. A null or empty text has no words and gives an empty text. Null and
    repeated ids are judged row by row; equal rows repeat each other. Further
    columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = _keyed(docs)
    found, read = repeated_windows(docs, least)
    spans = scratch.written(found, "spans")
    for table in read:
        scratch.forget(table)
    bitmap = spark.sparkContext.broadcast(scratch.id_bitmap(spans.select("k"), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 500
        for batch in batches:
            if batch.schema.names[-1] == "slot":  # the clean ones of all rows
                batch = batch.filter(pa.array(~scratch.in_bitmap(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False)))).select([0, 1])
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts = part.column(1).cast(pa.binary())
                spans = part.column(2) if part.num_columns > 2 else None
                rows = []
                for k in range(part.num_rows):
                    held = spans[k].as_py() if spans is not None and spans[k].is_valid else []
                    rows.append(_cut(texts[k].as_py() or b"", [(x["s"], x["n"]) for x in held], least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )

    schema = "doc_id long, n_words long, n_removed long, text string"
    rows = docs.select("doc_id", "id", "k", "text", "slot")
    hit = _let_through(rows, bitmap).drop("slot").join(spans, ["id", "k"], "left").select("doc_id", "text", "spans")
    clean = rows.select("doc_id", "text", "slot")
    return clean.mapInArrow(words.lean(run), schema).union(hit.mapInArrow(words.lean(run), schema))


def without_reference(docs: DataFrame, reference: DataFrame, least: int = 50, shard: int = 200_000) -> DataFrame:
    """As ``without_repeats``, but removing maximal spans of ``least`` words or more that occur in ``reference`` (text).

    The reference is broadcast shard by shard, so its words are counted first:
    over ``REFERENCE`` words this raises, and ``without_repeats`` over the union
    is the way. A null or empty reference text holds nothing.
    """
    n = reference.agg(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if n > REFERENCE:
        raise ValueError(f"a reference of {n} words is over the broadcast bound of {REFERENCE}")
    shards: list[list[bytes]] = [[]]
    size = 0
    for (text,) in reference.select("text").where("text is not null").toLocalIterator():
        h = words.words_of(np.frombuffer(text.encode(), np.uint8))
        if size and size + len(h) > shard:
            shards.append([])
            size = 0
        shards[-1].append(h.tobytes())
        size += len(h)
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = []
        for part in sent.value:
            autos.append(Automaton())
            for data in part:
                autos[-1].add(np.frombuffer(data, np.uint64).tolist())
            autos[-1].close()
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.binary())
            rows = []
            for x in texts:
                raw = x.as_py()
                seq = words.words_of(np.frombuffer(raw, np.uint8)).tolist()
                rows.append(_cut(raw, [(s, k - least + 1) for a in autos for s, k, _ in a.matches(seq, least)], least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.lean(run), "doc_id long, n_words long, n_removed long, text string")
