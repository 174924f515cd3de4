"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document, as long as a benchmark item, is a near copy of the item
if their weighted shingle sets are similar enough. Every window is tried that
holds enough of the shingles of items of its length to pass, wherever they stand
in it; no other window can. Its fingerprint of 128 bits (rolling votes, so that a
window costs what enters and leaves it) is looked up in a multi-index of the items'
fingerprints: those within ``RADIUS`` bits differ in one of ``BLOCKS`` blocks of
16 bits by that block's reach at most, so looking each block up with that many
changes finds every item within the radius. The similarity of what is found is
then computed exactly.

Two sets at the threshold differ in 19 bits of 128 on average, with a deviation of
4; unrelated ones in 64. The radius is 4.5 deviations off (tests measure recall).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Words of a shingle, least similarity, radius in bits, blocks of 16 bits.
K, SIMILAR, RADIUS, BLOCKS = 5, 0.8, 38, 8
#: Characters of a benchmark that is one shard: its index, broadcast, takes about 10 bytes a character. Windows fingerprinted at once.
CHARS, WINDOWS = 20_000_000, 4096
_U = np.uint64
#: Changed bits that each block's lookup allows: fewer in every block make RADIUS or less together.
_REACH = [(RADIUS - BLOCKS + 1 + b) // BLOCKS for b in range(BLOCKS)]
_WEIGHT = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
_MASKS = {r: np.flatnonzero(_WEIGHT <= r).astype(np.int64) for r in set(_REACH)}


def shingles(h: np.ndarray) -> np.ndarray:
    """Shingles of one word sequence; a shorter one than ``K`` words is a single shingle."""
    if len(h) >= K:
        return words.grams(h, K)
    return words.grams(h, len(h)) ^ _U(len(h)) if len(h) else np.empty(0, np.uint64)


def _bits(g: np.ndarray) -> np.ndarray:
    """The votes (-1 or 1) of each shingle for each of the 128 bits."""
    both = np.stack((g, words._mix(g ^ _U(0xC2B2AE3D27D4EB4F))), axis=1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(-1, 16), axis=1).astype(np.int32) * 2 - 1


def simhash(g: np.ndarray) -> np.ndarray:
    """The fingerprint of a shingle multiset, eight blocks: each bit is the sign of the sum of its shingles' votes."""
    return np.packbits(_bits(g).sum(axis=0) > 0).view(np.uint16)


def rolling(g: np.ndarray, starts: np.ndarray, held: int) -> np.ndarray:
    """The fingerprints of the windows of ``held`` shingles at ``starts`` (ascending)."""
    low = int(starts[0])
    total = np.zeros((int(starts[-1]) - low + held + 1, 16 * BLOCKS), np.int32)
    np.cumsum(_bits(g[low : int(starts[-1]) + held]), axis=0, out=total[1:])
    at = starts - low
    return np.packbits(total[at + held] - total[at] > 0, axis=1).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of shingle multisets: the sum of smaller counts by that of larger ones."""
    keys, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(inverse[: len(a)], minlength=len(keys)), np.bincount(inverse[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def _starts(pos: np.ndarray, held: int, least: int, last: int) -> np.ndarray:
    """Starts, up to ``last``, of all windows of ``held`` shingles with ``least`` or more of the places ``pos`` (ascending)."""
    if len(pos) < least:
        return np.empty(0, np.int64)
    i = np.flatnonzero(pos[least - 1 :] - pos[: len(pos) - least + 1] < held)
    first, end = np.maximum(pos[i + least - 1] - held + 1, 0), np.minimum(pos[i], last) + 1
    first = np.maximum(first, np.concatenate(([0], end[:-1])))  # ends ascend, so the ranges don't overlap
    n = np.maximum(end - first, 0)
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())


class Index:
    """Items by shingle, and by fingerprint blocks. items: (id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        items = [(i, h) for i, h in items if len(h)]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(h) for _, h in items], np.int64)
        self.sets = [shingles(h) for _, h in items]
        self.prints = np.array([simhash(g) for g in self.sets], np.uint16).reshape(-1, BLOCKS)
        every = np.concatenate(self.sets) if items else np.empty(0, np.uint64)
        size = np.repeat(self.sizes, [len(g) for g in self.sets]) if items else np.empty(0, np.int64)
        # each shingle with the sizes of the items that have it
        order = np.lexsort((size, every))
        every, size = every[order], size[order]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:] != every[:-1]) | (size[1:] != size[:-1])
        self.keys, self.size_of = every[first], size[first]
        self.short = sorted({int(n) for n in self.sizes if n < K})
        self.order = [np.argsort(self.prints[:, b], kind="stable") for b in range(BLOCKS)]
        self.begin = [np.searchsorted(self.prints[o, b], np.arange((1 << 16) + 1)).astype(np.int32) for b, o in enumerate(self.order)]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys >> _U(48)).astype(np.int64)] = True

    def _spots(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, size) of every shingle that an item has, with the sizes of such items."""
        at = np.flatnonzero(self.filter[(g >> _U(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, g[at], "left"), np.searchsorted(self.keys, g[at], "right")
        n = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        return np.repeat(at, n), self.size_of[rows]

    def candidates(self, fingerprint: np.ndarray) -> np.ndarray:
        """Items that one of the blocks finds: all within the radius, and some others."""
        out = []
        for b in range(BLOCKS):
            values = int(fingerprint[b]) ^ _MASKS[_REACH[b]]
            lo = self.begin[b][values]
            n = self.begin[b][values + 1] - lo
            some = np.flatnonzero(n)
            lo, n = lo[some], n[some]
            out.append(self.order[b][np.repeat(lo - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())])
        return np.unique(np.concatenate(out))

    def within(self, fingerprint: np.ndarray) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        near = self.candidates(fingerprint)
        return near[np.bitwise_count(self.prints[near] ^ fingerprint).sum(axis=1, dtype=np.int64) <= RADIUS]

    def _aligned(self, n: int, g: np.ndarray) -> bool:
        """Whether a shingle of the window ``g`` stands where the item has it."""
        size = min(len(g), len(self.sets[n]))
        return bool((g[:size] == self.sets[n][:size]).any())

    def hits(self, h: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of a document's windows that are near copies, the best of each item."""
        if not len(self.ids) or not len(h):
            return []
        grams = {K: words.grams(h, K), **{n: words.grams(h, n) ^ _U(n) for n in self.short}}
        found = [self._spots(g) for g in grams.values()]
        pos, size_of = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        best: dict[int, tuple] = {}
        for size in np.unique(size_of).tolist():
            g = grams[min(size, K)]
            held = min(size, len(h)) - min(size, K) + 1
            whole = size - min(size, K) + 1
            if held < 1:
                continue
            least = max(math.ceil(similar * (held + whole) / (1 + similar) - 1e-9), 1)
            starts = _starts(np.unique(pos[size_of == size]), held, least, max(len(h) - size, 0))
            for k in range(0, len(starts), WINDOWS):
                run = starts[k : k + WINDOWS]
                prints, which = np.unique(rolling(g, run, held), axis=0, return_inverse=True)
                near = [self.within(p) for p in prints]
                for s, w in zip(run.tolist(), which.reshape(-1).tolist(), strict=True):
                    for n in near[w].tolist():
                        if self.sizes[n] != size:
                            continue
                        alike = similarity(g[s : s + held], self.sets[n])
                        if alike >= similar - 1e-12:
                            rank = (-alike, not self._aligned(n, g[s : s + held]), s)
                            best[n] = min(best.get(n, rank), rank)
        return [(int(self.ids[n]), best[n][2], min(int(self.sizes[n]), len(h) - best[n][2]), -best[n][0]) for n in sorted(best)]


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items with an id and a text, and the shards they are dealt to by hash, so that each has half of ``CHARS`` on average."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return rows, 1 if n <= CHARS else -(-2 * n // CHARS)


def index_of(items: DataFrame) -> Index:
    """The index of a shard of items (item_id, text)."""
    rows = items.orderBy("item_id", "text").collect()
    return Index([(r[0], words.words_of(np.frombuffer(r[1].encode(), np.uint8), words.BARE, words.LOWER)) for r in rows])


_HITS = "array<struct<item_id:long,start:int,words:int,similarity:double>>"


def _held_against(docs: DataFrame, items: DataFrame, columns: list[str], similar: float) -> DataFrame:
    """``columns`` of ``docs`` and ``hits`` with the items of one shard, whose index is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(index_of(items))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns) + f"hits {_HITS}"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for i, j, h, o in words.hashed(batch.column(batch.num_columns - 1), words.BARE, words.LOWER):
                for k in range(j - i):
                    hits.append([dict(zip(("item_id", "start", "words", "similarity"), x, strict=True)) for x in sent.value.hits(h[o[k] : o[k + 1]], similar)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], names=[*columns, "hits"])

    return docs.select(*columns, F.col("text").alias("its_text")).mapInArrow(words.lean(run), schema)


def _found(docs: DataFrame, benchmark: DataFrame, columns: list[str], similar: float) -> DataFrame:
    """``columns`` of ``docs``, which are named apart from ``hits``, and the hits of each row.

    A benchmark over ``CHARS`` characters is searched shard by shard: the documents pass by each, and what they hit is put together.
    """
    items, shards = _items(benchmark)
    if shards == 1:
        return _held_against(docs, items, columns, similar)
    rows = scratch.written(docs.select(*dict.fromkeys([*columns, "text"])).withColumn("its_row", F.monotonically_increasing_id()), "documents")
    items = scratch.written(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    hits = None
    for k in range(shards):
        own = _held_against(rows, items.where(F.col("shard") == k), ["its_row"], similar).where(F.size("hits") > 0)
        own = scratch.written(own, "hits")
        hits = own if hits is None else hits.union(own)
    hits = hits.groupBy(F.col("its_row").alias("hit_row")).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    out = rows.join(hits, F.col("its_row") == F.col("hit_row"), "left")
    return out.select(*columns, F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_items, contaminated, items, best.

    Words are runs of letters and digits (all of Unicode beyond ASCII counts as
    letters), A-Z lower-cased; a window has as many as its item (a shorter document
    is one window). items: ``item:start:words`` of the best window of each item
    found, by item, joined by commas; best: the highest similarity, 0 without any.
    Of equally similar windows the first with a shingle at its place in the item counts, else the first. A null or empty text has no hits,
    nor has a null or wordless item. Null and repeated ids are judged row by row.
    Further columns are not read. No rows give no rows; an empty benchmark finds nothing.
    """
    rows = _found(docs, benchmark, ["doc_id"], similar)
    names = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["words"].cast("string"))), ",")
    best = F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0))
    return rows.select("doc_id", F.size("hits").cast("long").alias("n_items"), (F.size("hits") > 0).alias("contaminated"), names.alias("items"), F.round(best, 6).alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near copies of items, all columns as they are."""
    rows, back = scratch.plain(docs, "text")
    return back(_found(rows, benchmark, rows.columns, similar).where(F.size("hits") == 0))
