"""Word hashing over Arrow batches, whole batches at a time in numpy.

Texts are UTF-8 bytes. Separators are ASCII, so a byte-level scan never cuts a
code point. Memory is bounded by ``BLOCK`` bytes of text however long a
document is: a text over the limit is hashed block by block, cut at
separators, and only its word hashes (8 bytes a word) are held together.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15) | _U(1)
_MASK = (1 << 64) - 1
_P_INV = _U(pow(int(_P), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def trim() -> None:
    """Gives freed memory back to the system: a worker process that idles after a task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def lean(f: Callable) -> Callable:
    """A function for mapInArrow that trims memory when its partition ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def space_classes() -> np.ndarray:
    """Per byte: True where it belongs to a word ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return word


def bare_classes() -> np.ndarray:
    """As above, with ASCII punctuation and control bytes as separators too."""
    word = np.zeros(256, bool)
    for c in range(256):
        word[c] = c >= 128 or chr(c).isalnum()
    return word


def lower_table() -> np.ndarray:
    """Per byte: itself, A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACE, BARE, LOWER, SAME = space_classes(), bare_classes(), lower_table(), np.arange(256, dtype=np.uint8)


def bounds(raw: np.ndarray, classes: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = classes[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    return edge[::2], edge[1::2]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each word's bytes (after ``table``), length included."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power(len(raw))
    terms = _BYTE[table][raw]
    terms *= up[: len(raw)]
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * _U(0xE7037ED1A0B428DB))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def parts(offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``block`` bytes together (a longer row alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cuts(raw: np.ndarray, classes: np.ndarray = SPACE, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Parts of one text, of about ``block`` bytes, cut behind separators only."""
    at = 0
    while at < len(raw):
        to = min(at + block, len(raw))
        while to < len(raw) and classes[raw[to - 1]] and classes[raw[to]]:
            gap = np.flatnonzero(~classes[raw[at:to]])
            to = at + int(gap[-1]) + 1 if len(gap) else min(to + block, len(raw))
        yield at, to
        at = to


def words_of(raw: np.ndarray, classes: np.ndarray = SPACE, table: np.ndarray = SAME, block: int = BLOCK) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    out = [hashes(raw[i:j], *bounds(raw[i:j], classes), table) for i, j in cuts(raw, classes, block)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hashed(col: pa.Array, classes: np.ndarray = SPACE, table: np.ndarray = SAME) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, last row + 1, word hashes, word offsets by row."""
    raw, offsets = column_bytes(col)
    for i, j in parts(offsets):
        piece = raw[offsets[i] : offsets[j]]
        if j == i + 1:
            h = words_of(piece, classes, table)
            yield i, j, h, np.array([0, len(h)], np.int64)
            continue
        at = offsets[i : j + 1] - offsets[i]
        s, e = split_rows(*bounds(piece, classes), at)
        yield i, j, hashes(piece, s, e, table), np.searchsorted(s, at)


def split_rows(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut where a row ends, as neighbouring rows have no separator between them."""
    if not len(starts):
        return starts, ends
    inner = np.unique(at[1:-1])
    k = np.searchsorted(starts, inner, "right") - 1
    hit = (k >= 0) & (starts[k] < inner) & (ends[k] > inner)
    if not hit.any():
        return starts, ends
    inner = inner[hit]
    return np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k hashes (positions without k to the end are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mult = _U(0x9FB21C651E98DF25)
    for i in range(k):
        out *= mult
        out += h[i : i + n]
    return _mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
