"""Byte-pair encoding and decoding with the vocabulary file of a word-end tokenizer.

The text is split in white-space chunks. Nothing in the file's rules (NFC, white
space, lower case, split pattern) reaches across white space, so chunks are
encoded one by one. Chunks of ASCII and Latin-1 letters are cut into words by
byte classes, a block of texts at a time; others go through the rules as written.
Distinct words are then looked up in a lexicon of the corpus's frequent words
(``lexicon``); the rest are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .lexicon import Lexicon

#: Frequent words that the lexicon holds at most; words that a worker remembers, and counts, at once: none changes a result.
LEXICON, CACHE, COUNTED = 1 << 17, 100_000, 200_000
#: Bytes of a word from which its merges wait in a heap: the same merges, in n log n. Bits of an id in packed numbers, and no merge.
HEAP, BITS, NONE = 256, 32, 1 << 62
#: The rank of pairs that don't merge, and words that are merged together.
NO_RANK, ROWS = np.iinfo(np.int32).max, 1 << 13
END = "</w>"
_SLOW, _TAG = 4, np.uint64(0xA5A5_5A5A_1234_4321)


def _byte_chars() -> list[str]:
    """The printable character of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class _Ranks:
    """Ranks of pairs of ids, many looked up at once: pairs stand in a table by a hash, each at most a few places behind it."""

    def __init__(self, merges: dict[int, int]):
        keys, values = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int64)
        ranks = (values >> BITS).astype(np.int32)
        self.made = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        self.made[ranks] = values & 0xFFFFFFFF
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        at, left, self.steps = self._slots(keys), np.arange(len(keys)), 0
        while len(left):  # a round puts one pair in each free place, the others go one further
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = keys[left[first]], ranks[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            at, left, self.steps = (at[rest] + 1) & ((1 << self.bits) - 1), left[rest], self.steps + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``NO_RANK``."""
        keys = (a << BITS) | b
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NO_RANK).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(1, self.steps):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Codec:
    """The vocabulary, its merges and its rules."""

    def __init__(self, spec: dict, lexicon: Lexicon | None = None):
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = text
        self.token_bytes = [t.encode() for t in self.tokens]
        self.digits = [b"%d" % i for i in range(len(self.tokens))]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges: dict[int, int] = {}  # by both ids, packed: the rank and the new id, packed
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(vocab[a] << BITS | vocab[b], rank << BITS | vocab[a + b])
        self.ranks = _Ranks(self.merges)
        chars = _byte_chars()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + END] for c in chars]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"))
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        """Empties the cache: hashes of words, where their ids begin, how many they are, and the ids."""
        self.cache = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word by its merges: the lowest rank first, the leftmost of equals."""
        inner, get = self.inner, self.merges.get
        ids = [inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) >= HEAP:
            return self._merged_long(ids)
        ranks = [get(a << BITS | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            new = ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << BITS | ids[i + 1], NONE)
        return ids

    def merged_all(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words by their merges, all words a merge at a time, and how many each has; as ``merged`` of each."""
        size = ends - starts
        count, done = np.zeros(len(size), np.int64), []
        for low, high in ((0, 12), (12, 32)):
            these = np.flatnonzero((size > low) & (size <= high))
            for i in range(0, len(these), ROWS):
                part = these[i : i + ROWS]
                flat, count[part] = self._merged_rows(raw, starts[part], size[part])
                done.append((part, flat))
        for k in np.flatnonzero(size > 32).tolist():
            flat = np.array(self.merged(raw[starts[k] : ends[k]].tobytes()), np.int32)
            count[k] = len(flat)
            done.append((np.array([k]), flat))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for part, flat in done:
            own = count[part]
            out[np.repeat(begin[part] - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        return out, count

    def _merged_rows(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row a word: the pair of the lowest rank, the leftmost of equals, is merged in every row at once, until no row has one."""
        n, width = len(size), int(size.max())
        place = np.arange(width)
        used = place < size[:, None]
        data = raw[np.minimum(starts[:, None] + place, len(raw) - 1)]
        ids = self.inner_ids[data]
        rows = np.arange(n)
        ids[rows, size - 1] = self.last_ids[data[rows, size - 1]]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), NO_RANK, np.int32)
        pairs = used[:, 1:]
        a, b = np.nonzero(pairs)
        rank[a, b] = self.ranks.of(ids[a, b], ids[a, b + 1])
        while len(rows):
            i = rank[rows].argmin(axis=1)
            best = rank[rows, i]
            some = best < NO_RANK
            rows, i, best = rows[some], i[some], best[some]
            if not len(rows):
                break
            j = after[rows, i]
            new = self.ranks.made[best]
            ids[rows, i], used[rows, j], rank[rows, j] = new, False, NO_RANK
            k, h = after[rows, j], before[rows, i]
            after[rows, i] = k
            more = k < size[rows]
            rank[rows, i] = NO_RANK
            r, x = rows[more], k[more]
            before[r, x] = i[more]
            rank[r, i[more]] = self.ranks.of(new[more], ids[r, x])
            less = h >= 0
            r, x = rows[less], h[less]
            rank[r, x] = self.ranks.of(ids[r, x], new[less])
        return ids[used].astype(np.int32), used.sum(axis=1)

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list, with the pairs that can merge in a heap by rank and place; a pair that has changed since is passed over."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << BITS | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or get(ids[i] << BITS | ids[j], NONE) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := get(ids[i] << BITS | ids[k], NONE)) != NONE:
                    heapq.heappush(heap, (m, i))
            h = before[i]
            if h >= 0 and (m := get(ids[h] << BITS | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def words(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk by the file's own rules; a special token's string gives its id."""
        out: list[bytes | int] = []
        at = 0
        for m in chain(self.specials.finditer(chunk), [None]):
            part = unicodedata.normalize("NFC", chunk[at : m.start() if m else len(chunk)])
            part = "".join(map(str.lower, part))
            out += [w.encode() for w in self.split.findall(part)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        return [i for w in self.words(chunk) for i in ([w] if isinstance(w, int) else self.merged(w))]

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, slow): words, lower-cased; a chunk that needs the rules as written is one slow unit."""
        kind, low = _CLASS[raw], words.LOWER[raw]
        n = len(raw)
        lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.empty(0, np.int64)
        follow = raw[lead + 1]
        letter = (follow != 0x97) & (follow != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = 1
        upper = lead[letter & (follow <= 0x9E)] + 1
        low[upper] += 0x20
        tick = np.flatnonzero(raw[:-1] == 0x27) if n else lead
        kind[tick[_CONTRACTS[raw[tick + 1]]]] = _SLOW
        mark = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if n else lead
        kind[mark] = _SLOW
        s, e = words.split_rows(*words.bounds(raw), offsets)
        count = np.concatenate(([0], np.cumsum(kind == _SLOW)))
        slow = count[e] > count[s]
        step = np.zeros(n + 1, np.int8)
        step[s[slow]] += 1
        step[e[slow]] -= 1
        inside = np.cumsum(step[:n], dtype=np.int8) > 0
        kind[inside], low[inside] = 5, raw[inside]
        edge = np.ones(n + 1, bool)
        edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge[offsets] = True
        starts = np.flatnonzero((kind != 0) & edge[:n])
        ends = np.flatnonzero((kind != 0) & edge[1:]) + 1
        return low, starts, ends, kind[starts] == 5

    def distinct(self, raw: np.ndarray, offsets: np.ndarray):
        """The units of a block: bytes, starts and ends of each distinct one, slow ones, hashes, which unit is which, starts of all."""
        low, s, e, slow = self.units(raw, offsets)
        h = words.hashes(low, s, e)
        h[slow] ^= _TAG
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        return low, s[first], e[first], slow[first], keys, which, s

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and their offsets by text."""
        low, s, e, slow, keys, which, starts = self.distinct(raw, offsets)
        known, begin_of, size_of, flat = self.cache
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[hit], size[hit] = begin_of[at[hit]], size_of[at[hit]]
        if len(new):
            numbers = np.full(len(new), -1, np.int64)
            if self.lexicon is not None:
                plain = ~slow[new]
                numbers[plain] = self.lexicon.numbers(low, s[new[plain]], e[new[plain]])
            plain = (numbers < 0) & ~slow[new]
            merged, count = self.merged_all(low, s[new[plain]], e[new[plain]])
            lists = [self.lexicon.word_ids(number) if number >= 0 else self.chunk_ids(low[s[i] : e[i]].tobytes().decode("utf-8", "replace")) for i, number in zip(new[~plain].tolist(), numbers[~plain].tolist(), strict=True)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            new = np.concatenate((new[plain], new[~plain]))
            size[new] = np.concatenate((count, counts))
            begin[new] = len(flat) + np.cumsum(size[new]) - size[new]
            flat = np.concatenate((flat, merged, np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))))
            if len(known) + len(new) > CACHE:
                self.forget()
            else:
                order = np.argsort(keep := np.concatenate((known, keys[new])), kind="stable")
                self.cache = keep[order], np.concatenate((begin_of, begin[new]))[order], np.concatenate((size_of, size[new]))[order], flat
        per = size[which]
        total = np.concatenate(([0], np.cumsum(per)))
        ids = flat[np.repeat(begin[which] - total[:-1], per) + np.arange(total[-1])] if total[-1] else np.empty(0, np.int32)
        return ids, total[np.searchsorted(starts, offsets)]

    def encode(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per run of rows: first row, last row + 1, ids, offsets by row."""
        raw, offsets = words.column_bytes(col)
        for i, j in words.parts(offsets):
            piece = raw[offsets[i] : offsets[j]]
            if j == i + 1 and len(piece) > words.BLOCK:
                ids = [self.block(piece[a:b], np.array([0, b - a]))[0] for a, b in words.cuts(piece)]
                ids = np.concatenate(ids)
                yield i, j, ids, np.array([0, len(ids)])
            else:
                yield i, j, *self.block(piece, offsets[i : j + 1] - offsets[i])

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, special ones included, joined by a space: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


_CLASS = np.full(256, _SLOW, np.uint8)
for _c in range(128):
    _CLASS[_c] = 0 if _c == 32 or 9 <= _c <= 13 else 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 3
_CONTRACTS = np.zeros(256, bool)
_CONTRACTS[list(b"strvmldSTRVMLD")] = True
_held: dict[int, tuple[Codec, str | None]] = {}


def _codec(spec: str, name: str | None) -> Codec:
    """The worker process's codec: one vocabulary, and the lexicon asked for last."""
    key = hash(spec)
    if key not in _held:
        _held.clear()
        _held[key] = (Codec(json.loads(spec)), None)
    codec, last = _held[key]
    if name != last:
        codec.lexicon = Lexicon.load(SparkFiles.get(name)) if name else None
        codec.forget()
        _held[key] = (codec, name)
    return codec


def _forget() -> None:
    for codec, _ in _held.values():
        codec.forget()


def tidy(f):
    """A function for mapInArrow after which the worker forgets the words it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _forget()

    return words.lean(run)


class Encoder:
    """Encodes and decodes whole columns with the vocabulary file at ``path`` (a parameter: no vocabulary is kept here)."""

    def __init__(self, spark, path: str, corpus: DataFrame | None = None, text: str = "text", size: int = LEXICON):
        """``corpus``: where the frequent words are counted, over all its rows; without it every word is merged."""
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        self.spark, self.name = spark, None
        self.shared = spark.sparkContext.broadcast(self.spec)
        if corpus is not None:
            self.name = self._compile(corpus, text, size)

    def _compile(self, corpus: DataFrame, text: str, size: int) -> str:
        """Counts words over the corpus and sends the lexicon of the most frequent, ``size`` at most, to every machine, now or later."""
        shared = self.shared

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, seen = _codec(shared.value, None), {}

            def out():
                return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

            for batch in batches:
                raw, offsets = words.column_bytes(batch.column(0))
                for i, j in words.parts(offsets):
                    piece = raw[offsets[i] : offsets[j]]
                    rows = [(piece[a:b], np.array([0, b - a])) for a, b in words.cuts(piece)] if j == i + 1 else [(piece, offsets[i : j + 1] - offsets[i])]
                    for part, at in rows:
                        low, s, e, slow, keys, which, _ = codec.distinct(part, at)
                        data, n = low.tobytes(), np.bincount(which, minlength=len(keys))
                        for a, b, c in zip(s[~slow].tolist(), e[~slow].tolist(), n[~slow].tolist(), strict=True):
                            w = data[a:b]
                            seen[w] = seen.get(w, 0) + c
                        if len(seen) > COUNTED:
                            yield out()
                            seen.clear()
            if seen:
                yield out()

        counts = corpus.select(text).mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = scratch.written(counts.withColumn("bin", F.floor(F.log2("n") * 64)), "words")
        # the least count that leaves up to ``size`` words: from a histogram, so the driver never sees more than these
        least, total = 0, 0
        for r in counts.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():
            total += r["words"]
            if total > size:
                least = r["bin"] + 1
                break

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, None)
            built = Lexicon.build({w: codec.merged(w) for batch in batches for w in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array([built.data()], pa.large_binary())], names=["data"])

        # built in one task, as the words are at most ``size``; the driver only passes the file on
        frequent = counts.where(F.col("bin") >= least).select("word").coalesce(1)
        data = frequent.mapInArrow(tidy(build), "data binary").toArrow()["data"]
        data = data[0].as_py() if len(data) else Lexicon.build({}).data()
        scratch.forget(counts)
        path = scratch.stored(self.spark, f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin", data)
        self.spark.sparkContext.addFile(path)
        return path.rpartition("/")[2]

    def opener(self):
        """A function for tasks that gives them the codec."""
        shared, name = self.shared, self.name
        return lambda: _codec(shared.value, name)

    def encode(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, n_tokens, ids) of every row; a null or empty text has no ids. Nulls and repeats of ids are kept as they are."""
        shared, name = self.shared, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, name)
            for batch in batches:
                for i, j, ids, at in codec.encode(batch.column(1)):
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), lists], names=[id, "n_tokens", "ids"])

        kind = docs.schema[id].dataType.simpleString()
        return docs.select(id, text).mapInArrow(tidy(run), f"`{id}` {kind}, n_tokens long, ids array<int>")

    def decode(self, rows: DataFrame, id: str = "doc_id", ids: str = "ids") -> DataFrame:
        """(id, text) of every row; null ids give an empty text."""
        shared, name = self.shared, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, name)
            for batch in batches:
                texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "text"])

        kind = rows.schema[id].dataType.simpleString()
        return rows.select(id, ids).mapInArrow(tidy(run), f"`{id}` {kind}, text string")

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, and digests of the ids and of the text decoded from them; the ids don't leave the worker.

        One row per row of ``docs`` (doc_id, text, ...). A null or empty text has 0 tokens and the digests of the
        empty string; null and repeated ids are kept as they are. A very long text is read block by block, a very long
        word merged in n log n. Further columns are not read; no rows give no rows.
        """
        shared, name = self.shared, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, name)
            number, token = codec.digits.__getitem__, codec.token_bytes.__getitem__
            sha = lambda x: hashlib.sha256(x).hexdigest()
            for batch in batches:
                for i, j, ids, at in codec.encode(batch.column(1)):
                    ids, at = ids.tolist(), at.tolist()
                    rows = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(list(map(len, rows)), pa.int64()), pa.array([sha(b" ".join(map(number, r))) for r in rows]), pa.array([sha(b" ".join(map(token, r))) for r in rows])],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def lengths(self, docs: DataFrame) -> DataFrame:
        """(n_tokens, n_docs) counted batch by batch; add up by n_tokens."""
        shared, name = self.shared, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, name)
            for batch in batches:
                n, count = np.unique(np.concatenate([np.diff(at) for *_, at in codec.encode(batch.column(0))] or [np.empty(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(count, pa.int64())], names=["n_tokens", "n_docs"])

        return docs.select("text").mapInArrow(tidy(run), "n_tokens long, n_docs long")
