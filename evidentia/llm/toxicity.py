"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is three short vectors side by side, picked from three tables
by hashes of the word and of its first four and five bytes, so that inflected forms
share most of it and words which collide in one table differ in the others. Filters of several widths slide over the words; each filter's largest
value over the whole text, through a rectifier, feeds a logistic layer. The score
is moved so that 0.5 is the best threshold of the text's language, which is
inferred from its most common words: labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Rows of a table, tables, numbers a table gives, filter widths, filters a width; bytes of a word that each table sees.
TABLE, TABLES, DIM, WIDTHS, FILTERS = 1 << 16, 3, 8, (1, 2, 3), 8
PREFIX = (None, 4, 5)
#: Slope of the rectifier below zero: with none, words that no filter answers to yet would never be learnt.
LEAK = np.float32(0.2)
#: The bounded sample of labelled rows: rows at most, characters a row at most (longer ones are left out), and the share used to calibrate.
SAMPLE, SAMPLE_CHARS, CALIBRATION = 8000, 50_000, 0.2
EPOCHS, STEPS, BATCH, RATE, SEED = 5, 800, 64, 0.02, 7
#: Common words by language (fixed values); a text is in the language with the most of them.
COMMON = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "was", "for", "on", "with"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein", "auf"),
    "fr": ("le", "les", "des", "et", "du", "une", "est", "que", "pour", "dans", "qui"),
    "es": ("el", "los", "las", "del", "y", "por", "con", "una", "para", "como", "se"),
}
_U = np.uint64


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word, and of its beginnings (TABLES, n)."""
    return np.stack([words.hashes(raw, starts, ends if k is None else np.minimum(ends, starts + k), words.LOWER) for k in PREFIX])


def of_text(raw: np.ndarray) -> np.ndarray:
    """The same of one text of any length."""
    parts = [hashed(raw[a:b], *words.bounds(raw[a:b], words.BARE)) for a, b in words.cuts(raw, words.BARE)]
    return np.concatenate(parts, axis=1) if parts else np.empty((TABLES, 0), np.uint64)


def _one_hash(word: str) -> int:
    return int(of_text(np.frombuffer(word.encode(), np.uint8))[0, 0])


def _rectified(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, LEAK * x)


class Model:
    """Tables (TABLES, TABLE, DIM), filters by width (w * TABLES * DIM, FILTERS), their biases, the last layer, shifts by language."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = TABLES * DIM
        self.tables = rng.normal(0, 0.3, (TABLES, TABLE, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * d), (w, d, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.last = rng.uniform(0.1, 0.4, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.languages = list(COMMON)
        self.marks = np.array([_one_hash(w) for lang in COMMON for w in COMMON[lang]], np.uint64)
        self.mark_of = np.array([i for i, lang in enumerate(COMMON) for _ in COMMON[lang]])
        order = np.argsort(self.marks)
        self.marks, self.mark_of = self.marks[order], self.mark_of[order]
        self.shift = np.zeros(len(COMMON) + 1)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """The row of each word in each table (``TABLE`` rows at most, so two bytes each)."""
        return ((h >> _U(17)) % _U(TABLE)).astype(np.uint16)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[t][rows[t]] for t in range(TABLES)], axis=1)

    def language(self, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Index of each text's language; one more for none."""
        at = np.minimum(np.searchsorted(self.marks, h), len(self.marks) - 1)
        hit = np.flatnonzero(self.marks[at] == h)
        doc = np.searchsorted(offsets, hit, "right") - 1
        n = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        np.add.at(n, (doc, self.mark_of[at[hit]]), 1)
        return np.where(n.max(axis=1) > 0, n.argmax(axis=1), len(self.languages))

    def responses(self, x: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per width: each filter at each word; a filter that would reach into the next text sees zeros there."""
        n = len(x)
        every = x @ np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        out, at = [], 0
        for w in WIDTHS:
            z = every[:, at : at + FILTERS].copy()
            for k in range(1, w):
                ahead = every[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
                z[: n - k] += ahead
                for back in range(k):  # the last k words of a text have no word k ahead
                    rows = ends - back
                    rows = rows[(rows >= 0) & (rows + k < n)]
                    z[rows] -= every[rows + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(z)
            at += w * FILTERS
        return out

    def pooled(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each filter's largest value in each text (of ``rows``), before the rectifier; a text without words gives zeros."""
        out = np.zeros((len(offsets) - 1, FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            z = self.responses(self.embed(rows), offsets)
            out[full] = np.concatenate([np.maximum.reduceat(v, offsets[:-1][full], axis=0) for v in z], axis=1)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return _rectified(pooled + self.bias) @ self.last + self.base

    def score(self, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.logits(self.pooled(self.rows(h), offsets)).astype(np.float64) - self.shift[self.language(h[0], offsets)]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def score_long(self, raw: np.ndarray) -> float:
        """One text of any length, block by block: maxima and counts are joined. A block's last words wait for the next one, as
        filters reach ahead."""
        best, n = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(len(self.languages) + 1, np.int64)
        tail, ahead = np.empty((TABLES, 0), np.uint64), max(WIDTHS) - 1
        parts = list(words.cuts(raw, words.BARE))
        for k, (a, b) in enumerate(parts):
            own = hashed(raw[a:b], *words.bounds(raw[a:b], words.BARE))
            at = np.minimum(np.searchsorted(self.marks, own[0]), len(self.marks) - 1)
            n[: len(self.languages)] += np.bincount(self.mark_of[at[self.marks[at] == own[0]]], minlength=len(self.languages))
            h = np.concatenate((tail, own), axis=1)
            whole = h.shape[1] if k == len(parts) - 1 else h.shape[1] - ahead
            if whole > 0:
                z = self.responses(self.embed(self.rows(h)), np.array([0, h.shape[1]]))
                best = np.maximum(best, np.concatenate([v[:whole].max(axis=0) for v in z]))
            tail = h[:, max(whole, 0) :]
        if np.isinf(best[0]):
            best[:] = 0
        x = float(self.logits(best[None, :])[0]) - self.shift[int(n.argmax()) if n.any() else len(self.languages)]
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the dense weights, Adagrad on the tables; the classes weigh the same. ``STEPS`` steps at least. texts: of ``rows``."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        weight = np.minimum(weight, 10.0)
        dense = [*self.filters, self.bias, self.last]
        m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        mb = vb = 0.0
        seen = np.full((TABLES, TABLE), 1e-3, np.float32)
        step = 0
        d = TABLES * DIM
        batches = -(-len(texts) // BATCH)
        for _ in range(max(epochs, -(-STEPS // max(batches, 1)))):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                pick = [i for i in order[b : b + BATCH] if texts[i].shape[1]]
                if not pick:
                    continue
                h = np.concatenate([texts[i] for i in pick], axis=1)
                offsets = np.concatenate(([0], np.cumsum([texts[i].shape[1] for i in pick])))
                words_in = h.shape[1]
                rows = h
                x = self.embed(rows)
                z = self.responses(x, offsets)
                seg = np.repeat(np.arange(len(pick)), np.diff(offsets))
                tops, spots = [], []
                for value in z:
                    top = np.maximum.reduceat(value, offsets[:-1], axis=0)
                    r, c = np.nonzero(value == top[seg])
                    at = np.full((len(pick), FILTERS), words_in, np.int64)
                    np.minimum.at(at, (seg[r], c), r)
                    tops.append(top)
                    spots.append(at)
                pooled = np.concatenate(tops, axis=1)
                act = _rectified(pooled + self.bias)
                p = 1 / (1 + np.exp(-np.clip(act @ self.last + self.base, -30, 30)))
                g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                da = (g[:, None] * self.last) * np.where(pooled + self.bias > 0, 1, LEAK).astype(np.float32)
                grads = [np.zeros_like(f) for f in self.filters] + [da.sum(axis=0), act.T @ g]
                dx: dict = {"at": [], "g": []}
                for k, w in enumerate(WIDTHS):
                    dz = da[:, k * FILTERS : (k + 1) * FILTERS]
                    for shift in range(w):
                        at = spots[k] + shift
                        inside = at < offsets[1:][:, None]
                        gone = dz * inside
                        place = np.minimum(at, words_in - 1)
                        grads[k][shift] = np.einsum("if,ifd->df", gone, x[place])
                        dx["at"].append(place.ravel())
                        dx["g"].append((gone[:, :, None] * self.filters[k][shift].T[None]).reshape(-1, d))
                step += 1
                for i, (par, grad) in enumerate(zip(dense, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    par -= RATE * 0.5 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
                gb = float(g.sum())
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                self.base -= np.float32(RATE * 0.5 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8))
                at, gx = np.concatenate(dx["at"]), np.concatenate(dx["g"])
                live = np.flatnonzero(np.abs(gx).sum(axis=1) > 0)
                at, gx = at[live], gx[live]
                for t in range(TABLES):
                    row, part = rows[t][at], gx[:, t * DIM : (t + 1) * DIM]
                    uniq, inv = np.unique(row, return_inverse=True)
                    total = np.zeros((len(uniq), DIM), np.float32)
                    np.add.at(total, inv, part)
                    seen[t][uniq] += (total * total).mean(axis=1)
                    self.tables[t][uniq] -= RATE * 3 * total / np.sqrt(seen[t][uniq])[:, None]

    def calibrate(self, texts: list[tuple[np.ndarray, int]], y: list[int]) -> None:
        """Moves each language's logits so that its best threshold (by F1; the middle of the widest gap among equals) is 0.

        texts: (``rows``, language). A language with fewer than 10 labels of either class takes the threshold of all.
        """
        if not len(texts):
            return
        x, lang, y = [], np.array([g for _, g in texts]), np.array(y, np.int64)
        for i in range(0, len(texts), BATCH):
            part = [r for r, _ in texts[i : i + BATCH]]
            x.append(self.logits(self.pooled(np.concatenate(part, axis=1), np.concatenate(([0], np.cumsum([r.shape[1] for r in part]))))))
        x = np.concatenate(x).astype(np.float64)

        def best(x, y):
            order = np.argsort(-x, kind="stable")
            xs, hits = x[order], np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(xs) + 1) + max(y.sum(), 1))
            gap = np.append(xs[:-1] - xs[1:], 1.0)
            f1 = np.where(gap > 0, f1, -1)
            k = max(np.flatnonzero(f1 >= f1.max() - 1e-9), key=lambda i: gap[i])
            return xs[k] - gap[k] / 2

        if y.min() != y.max():
            self.shift[:] = best(x, y)
            for g in range(len(self.shift)):
                own = lang == g
                if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 10:
                    self.shift[g] = best(x[own], y[own])


def fold(id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model learnt from all rows (doc_id, text, toxic); texts are held as table rows, six bytes a word."""
    model, fit, calibrate = Model(), ([], []), ([], [])
    for batch in batches:
        for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = of_text(np.frombuffer(t.encode(), np.uint8))
            if zlib.crc32(b"calibrate%d" % i) % 1000 < 1000 * CALIBRATION:
                calibrate[0].append((model.rows(h), int(model.language(h[0], np.array([0, h.shape[1]]))[0])))
                calibrate[1].append(y)
            else:
                fit[0].append(model.rows(h))
                fit[1].append(y)
    y = np.array(fit[1] + calibrate[1], np.int64)
    if not len(y) or y.min() == y.max():
        model.last[:] = 0
        model.base = np.float32(-4)
    else:
        if fit[0]:
            model.fit(fit[0], np.array(fit[1], np.int64))
        model.calibrate(*calibrate)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled rows outside of fold 0: the ``sample`` first by a hash of the id, of those
    with up to ``SAMPLE_CHARS`` characters. Without labels of both classes it stays untrained and scores near 0.

    One executor task learns; the driver gets the weights only.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where((fold() != 0) & (F.length("text") <= SAMPLE_CHARS))
    picked = marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    got = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    data = got.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")).coalesce(1).mapInArrow(words.lean(_learnt), "model binary").toArrow()["model"]
    return pickle.loads(data[0].as_py()) if len(data) else pickle.loads(next(_learnt(iter(())))["model"][0].as_py())


def scored(docs: DataFrame, model: Model, columns: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and, as ``name``, the score of each row's whole ``text`` (null: empty), 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*columns, F.col("text").alias(scratch.fresh([*columns, name], "its_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            raw, offsets = words.column_bytes(col)
            score = np.empty(batch.num_rows)
            for i, j in words.parts(offsets, words.BLOCK // 4):
                piece = raw[offsets[i] : offsets[j]]
                if j == i + 1:
                    score[i] = model.score_long(piece)
                else:
                    at = offsets[i : j + 1] - offsets[i]
                    s, e = words.split_rows(*words.bounds(piece, words.BARE), at)
                    score[i:j] = model.score(hashed(piece, s, e), np.searchsorted(s, at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return chosen.mapInArrow(words.lean(run), f"{schema}, `{name}` double" if schema else f"`{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, held_out, score, predicted.

    held_out: the row's fold is 0, its label was not learnt from (false for a null
    id, which has no label). predicted: 1 where score >= 0.5. A null or empty text
    is scored as one without words. ``labels``: doc_id, toxic (0 or 1; others are
    ignored; of several for one id the largest counts). No rows give no rows.
    """
    out = scored(docs, train(docs, labels), ("doc_id",))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
