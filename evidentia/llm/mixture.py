"""Documents packed into windows of tokens, mixed from their sources in target proportions.

Deficit round-robin: each source is a queue of tokens. In every round a queue is credited its share of a window and
serves whole quanta of its credit; what is left of it, less than a quantum, stays its deficit for the next round,
whichever window, task or partition that falls into. An empty queue serves nothing, so others fill its room. As
credits are whole numbers, what a queue has served by a round is a formula, and so is the place of every token in
the stream of all rounds: any task places its documents by itself, however many windows came before. The
stream is cut into windows, documents freely with it.

What is left at the end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words
from .bpe import Encoder, tidy

#: Tokens of a window and of a quantum; parts that shares are counted in; queues of their own (the sources with fewest tokens share the last).
WINDOW, QUANTUM, PARTS, QUEUES = 4096, 64, 1 << 16, 256
#: Slices that are placed at once.
_AT_ONCE = 1 << 12


class Rounds:
    """The schedule: what each queue has served by a round, from the queues' tokens and shares (in ``PARTS``, one at least)."""

    def __init__(self, tokens: list[int], shares: list[int], window: int = WINDOW, quantum: int = QUANTUM):
        self.tokens, self.shares = np.array(tokens, np.int64), np.array(shares, np.int64)
        self.window, self.quantum = window, quantum
        self.unit = PARTS * quantum  # of credit, for one quantum
        self.total = int(self.tokens.sum())

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """By round (rows) and queue (columns): tokens served up to it."""
        credit = rounds[:, None] * (self.shares * self.window)
        whole = credit // self.unit * self.quantum
        return np.where(credit >= self.tokens * PARTS, self.tokens, np.minimum(whole, self.tokens))

    def round_of(self, queue: int, x: np.ndarray) -> np.ndarray:
        """The round that serves token ``x`` of a queue: the first with credit for its quantum, or for all of the queue."""
        share = int(self.shares[queue]) * self.window
        quantum = -(-(x // self.quantum + 1) * self.unit // share)
        every = -(-int(self.tokens[queue]) * PARTS // share)
        return np.minimum(quantum, every)

    def slices(self, queue: int, start: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of the tokens ``start`` to ``start + length`` of a queue: places in the stream, and lengths."""
        first, last = (int(r[0]) for r in (self.round_of(queue, np.array([start])), self.round_of(queue, np.array([start + length - 1]))))
        while first <= last:
            if length <= self.quantum:
                rounds = np.arange(first, min(last, first + _AT_ONCE - 1) + 1)
            else:  # only rounds in which this queue serves: those of its quanta
                marks = np.arange(start // self.quantum, (start + length - 1) // self.quantum + 1)
                rounds = np.unique(self.round_of(queue, marks * self.quantum))
                rounds = rounds[(rounds >= first)][:_AT_ONCE]
            before, by = self.served(rounds - 1), self.served(rounds)
            own, till = before[:, queue], by[:, queue]
            base = before.sum(axis=1) + (by[:, :queue] - before[:, :queue]).sum(axis=1)
            a, z = np.maximum(own, start), np.minimum(till, start + length)
            some = z > a
            if some.any():
                yield (base + a - own)[some], (z - a)[some]
            first = int(rounds[-1]) + 1

    def sequences(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of the stream cut at the ends of sequences: sequence, offset in it, length; runs that touch are joined first."""
        joint = np.concatenate(([True], at[1:] != at[:-1] + length[:-1]))
        begin = np.flatnonzero(joint)
        at, length = at[begin], np.add.reduceat(length, begin)
        full, rest = divmod(self.total, self.window)
        bits = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        tail = full * self.window + np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        out = []
        for a, n in zip(at.tolist(), length.tolist(), strict=True):
            while n:
                if a < tail[0]:
                    seq, off = divmod(a, self.window)
                    room = self.window - off
                else:
                    k = int(np.searchsorted(tail, a, "right")) - 1
                    seq, off, room = full + k, a - int(tail[k]), int(tail[k + 1]) - a
                take = min(room, n)
                out.append((seq, off, take))
                a, n = a + take, n - take
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


def _queue_key(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))


def _encoded(docs: DataFrame, encoder: Encoder, end: int, id: str, text: str, source: str) -> DataFrame:
    """(id, source, part, start, tokens, ids): each document with the tokens that precede it in its source and partition; ids are bytes of unsigned 32-bit numbers, ``end`` last."""
    opened = encoder.opener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seen = opened(), TaskContext.get().partitionId(), {}
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for i, j, ids, at in codec.encode(batch.column(1)):
                n = np.diff(at) + 1
                out = np.full(len(ids) + j - i, end, "<u4")  # each document's ids, then the end
                out[np.arange(len(ids)) + np.repeat(np.arange(j - i), n - 1)] = ids
                starts = np.empty(j - i, np.int64)
                for k, (s, m) in enumerate(zip(sources[i:j], n.tolist(), strict=True)):
                    starts[k] = seen.get(s, 0)
                    seen[s] = int(starts[k]) + m
                ends = np.concatenate(([0], np.cumsum(n))) * 4
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sources[i:j], pa.string()), pa.array([part] * (j - i), pa.int32()), pa.array(starts), pa.array(n, pa.int64()), data], names=["id", "source", "part", "start", "tokens", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), _queue_key(source).alias("source")).mapInArrow(tidy(run), f"id {kind}, source string, part int, start long, tokens long, ids binary")


def _queues(parts: DataFrame, mixture: Mapping[str | None, float] | None) -> tuple[list[str], list[int], list[int]]:
    """Sources with a queue of their own, the queues' tokens, and their shares; the last queue is all other sources'."""
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    rows = parts.groupBy("source").agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "source").limit(QUEUES).collect()
    own, rest = [(r["source"], r["n"]) for r in rows], 0
    if len(own) == QUEUES:
        own = own[:-1]
        rest = total - sum(n for _, n in own)
    tokens = [n for _, n in own] + [rest]
    if mixture is None:
        weights = [float(n) for n in tokens]
    else:
        named = {("0" if s is None else "1" + s): w for s, w in mixture.items()}
        weights = [max(0.0, named.get(s, 0.0)) for s, _ in own] + [0.0]
    all_of = sum(weights) or 1.0
    return [s for s, _ in own], tokens, [max(1, round(PARTS * w / all_of)) for w in weights]


def packed(docs: DataFrame, encoder: Encoder, mixture: Mapping[str | None, float] | None = None, end: int = 2, window: int = WINDOW, with_ids: bool = True, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of the documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and ids (array<int>) if asked for.

    A document is the ids of its whole text, then ``end``; a null or empty text is the end alone, so each row of ``docs`` has a piece.
    ``mixture``: target shares by source (others get what is left over, one part in ``PARTS`` at least); by default the shares that the
    sources have. By any point of the stream a queue that still has tokens is within a quantum and a window's share of its target.
    Sources with a null name are one source. Null and repeated ids are packed row by row. Sequences are full windows, then one for each
    power of two that the rest is made of. No rows give no pieces. Further columns are not read.
    """
    rows = scratch.written(_encoded(docs, encoder, end, id, text, source), "encoded")
    parts = rows.groupBy("source", "part").agg(F.sum("tokens").alias("tokens"))
    own, tokens, shares = _queues(parts, mixture)
    rounds, rest = Rounds(tokens, shares, window), len(own)
    queue = F.coalesce(F.array_position(F.array(*map(F.lit, own)).cast("array<string>"), F.col("source")).cast("int") - 1, F.lit(-1))
    queue = F.when(queue < 0, F.lit(rest)).otherwise(queue)
    earlier = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("queue", queue).select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("begin"))
    placed = rows.join(scratch.sized(begins), (F.col("source") == F.col("s")) & (F.col("part") == F.col("p"))).select("id", "source", "queue", (F.col("begin") + F.col("start")).alias("at"), "tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        for batch in batches:
            which, out, lists = [], [[] for _ in range(6)], []
            for k, (q, at, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                data = batch.column(5)[k].as_buffer()
                view = memoryview(data)
                runs = list(rounds.slices(q, at, n))
                seq, off, size = rounds.sequences(np.concatenate([a for a, _ in runs]), np.concatenate([b for _, b in runs]))
                ends = np.cumsum(size)
                begin = (ends - size).tolist()
                which.append(np.full(len(size), k))
                for column, values in zip(out, (begin, size.tolist(), [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(begin, ends.tolist(), strict=True)], [n] * len(size), seq.tolist(), off.tolist()), strict=True):
                    column += values
                if with_ids:
                    lists += [np.frombuffer(data, "<u4")[a:z].astype(np.int32) for a, z in zip(begin, ends.tolist(), strict=True)]
            if which:
                take = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in out), *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    pieces = placed.mapInArrow(words.lean(run), f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    name = F.when(F.col("source") != "0", F.substr("source", F.lit(2)))
    return pieces.select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", name.alias("source"), *(["ids"] if with_ids else []))
