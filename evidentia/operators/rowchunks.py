"""Chunks of table rows: cells are counted, grouped and joined for a whole Arrow batch of rows at a time, not row by row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import text as T

#: Kinds of signs in the token estimate.
SIGN, WORD, BLANK, HAN, JOIN = range(5)
#: Bytes of texts that are handed on at once; a cell that is only a number (fixed values).
HELD, NUMBER = 1 << 25, r"\A[\p{Nd}.,/ -]+\z"


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point, as ``greedy.estimate`` reads it."""
    out = np.full(0x110000, SIGN, np.uint8)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = BLANK
    out[[c for c in range(128) if re.fullmatch("[A-Za-z0-9_]", chr(c))]] = WORD
    out[[ord(c) for c in "./%-"]] = JOIN
    for a, b in re.findall("(.)-(.)", T.IDEOGRAPHS):
        out[ord(a) : ord(b) + 1] = HAN
    return out


def numbers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Han signs and quarters of words, and signs, of each string. The first and half of the second, rounded up, are its estimate; both add up
    over strings that blanks keep apart."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not data.size:
        return np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    if data.max() >= 128:
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
        data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = _kinds()[data]
    begins = np.zeros(len(kind) + 1, bool)
    begins[at] = True
    held = kind == WORD
    held[1:-1] |= (kind[1:-1] == JOIN) & held[:-2] & held[2:] & ~begins[1:-2] & ~begins[2:-1]
    first = np.flatnonzero(held & (begins[:-1] | ~np.concatenate(([False], held[:-1]))))
    last = np.flatnonzero(held & (begins[1:] | ~np.concatenate((held[1:], [False]))))
    whole = (kind == HAN).astype(np.int64)
    whole[first] += (last - first + 4) // 4
    add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    return add(whole), add((kind == SIGN) | (kind == JOIN))


class Above(NamedTuple):
    """The last text cell of each column of a table so far, with its numbers."""

    table: object
    columns: pa.Array
    cells: pa.Array
    whole: np.ndarray
    signs: np.ndarray


def chunked(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the rows (doc, header, row, cells), which are in order; a table may go on in the next batch."""
    above = None
    for rows in batches:
        if rows.num_rows:
            above = yield from _chunked(rows, budget, above)


def _lists(strings: pa.Array, counts: np.ndarray, sep: str) -> pa.Array:
    """The strings joined, ``counts`` of them at a time."""
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), strings), sep)


def _plain(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _chunked(rows: pa.RecordBatch, budget: int, above: Above | None):
    doc, row = rows.column("doc"), rows.column("row")
    header = pc.fill_null(rows.column("header"), "")
    n, none = len(doc), pc.is_null(doc)
    same = _plain(pc.or_(pc.fill_null(pc.equal(doc[1:], doc[:-1]), False), pc.and_(none[1:], none[:-1]))).astype(bool)
    table = np.concatenate(([0], np.cumsum(~same)))
    if above is None or above.table != doc[0].as_py():
        empty = pa.array([], pa.string())
        above = Above(doc[0].as_py(), empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64))

    # cells with a value; before them the last text cells of the first row's table, as of a row -1
    at, flat = _plain(pc.list_parent_indices(rows.column("cells"))).astype(np.int64), pc.list_flatten(rows.column("cells"))
    value = pc.struct_field(flat, "value")
    filled = pc.is_valid(value)
    at, value = at[_plain(filled).astype(bool)], value.filter(filled)
    column = pc.fill_null(pc.struct_field(flat, "col"), "").filter(filled)
    shown = pc.binary_join_element_wise(column, pc.fill_null(pc.cast(row, pa.string()), "").take(pa.array(at)), "='", value, "'", "")
    size = pc.utf8_length(value)
    text = pc.and_(pc.and_(pc.greater(size, 0), pc.less_equal(size, 100)), pc.invert(pc.match_substring_regex(value, NUMBER)))
    k, (whole, signs) = len(above.cells), numbers(shown)
    pool, whole, signs = pa.concat_arrays([above.cells, shown]), np.concatenate((above.whole, whole)), np.concatenate((above.signs, signs))
    names = pa.concat_arrays([above.columns, column]).dictionary_encode()
    code, n_codes = _plain(names.indices).astype(np.int64), max(len(names.dictionary), 1)
    of = np.concatenate((np.zeros(k, np.int64), table[at]))
    at, text = np.concatenate((np.full(k, -1), at)), np.concatenate((np.ones(k, bool), _plain(text).astype(bool)))

    # a column that a row names again stands where it stood first, with its last value
    source, key = np.arange(len(at)), at * n_codes + code
    unique, first, which = np.unique(key, return_index=True, return_inverse=True)
    if len(unique) < len(key):
        last, some = np.zeros(len(unique), np.int64), np.zeros(len(unique), bool)
        np.maximum.at(last, which, source)
        some[which[text]] = True
        order = np.argsort(first)
        source, text, first = last[order], some[order], first[order]
        at, code, of = at[first], code[first], of[first]
    whole, signs, m = whole[source], signs[source], len(source)

    # the nearest earlier text cell of each cell's table and column (-1: none)
    group = of * n_codes + code
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    latest = np.maximum.accumulate(np.where(text[order], np.arange(m), -1)) if m else np.zeros(0, np.int64)
    before = np.concatenate(([-1], latest[:-1])).astype(np.int64)[:m]
    near = np.full(m, -1)
    near[order] = np.where((before >= 0) & (ordered[before] == ordered), order[before], -1)
    ends = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True]))[:m])
    ends = ends[(ordered[ends] // n_codes == table[-1]) & (latest[ends] >= 0)]
    held = order[latest[ends][ordered[latest[ends]] == ordered[ends]]]
    kept = pa.array(source[held])
    after = Above(doc[n - 1].as_py(), names.dictionary.take(pa.array(code[held])), pool.take(kept), whole[held], signs[held])

    # groups of cells: a row's k-th cell is judged for all rows at once
    count = np.bincount(at[k:], minlength=n)
    begin = k + np.concatenate(([0], np.cumsum(count)[:-1]))
    many = count > 2
    words = header.dictionary_encode()
    base, base_signs = (x[_plain(words.indices)] for x in numbers(words.dictionary))
    base, base_signs = base + 1, base_signs + 2  # [ROW]
    lead = np.flatnonzero(many)
    top, top_signs = base.copy(), base_signs.copy()
    top[lead] += whole[begin[lead]] + whole[begin[lead] + 1]
    top_signs[lead] += signs[begin[lead]] + signs[begin[lead] + 1] + 1
    used, used_signs, inside, number = top.copy(), top_signs.copy(), np.zeros(n, bool), np.zeros(n, np.int64)
    part, r, i = np.zeros(m, np.int64), np.flatnonzero(count), 0
    while len(r):
        c, own = begin[r] + i, ~many[r] | (i >= 2)
        more, more_signs = np.where(own, whole[c], 0), np.where(own, signs[c], 0)
        new, new_signs = used[r] + more, used_signs[r] + more_signs + (own & (many[r] | inside[r]))
        over = inside[r] & (new + (new_signs + 1) // 2 > budget)
        used[r], used_signs[r] = np.where(over, top[r] + more, new), np.where(over, top_signs[r] + more_signs + (own & many[r]), new_signs)
        number[r] += over
        inside[r] = True
        part[c] = number[r]
        i += 1
        r = r[count[r] > i]

    # chunks and their cells: the first two of a row of many, then the group's others
    chunks = np.where(count > 0, number + 1, 0)
    start = np.cumsum(chunks) - chunks
    own = np.repeat(np.arange(n), chunks)
    cell = np.arange(k, m)
    cell = cell[~many[at[k:]] | (cell - begin[at[k:]] >= 2)]
    wide = np.flatnonzero(many[own])
    chunk = np.concatenate((wide, wide, start[at[cell]] + part[cell]))
    cell = np.concatenate((begin[own[wide]], begin[own[wide]] + 1, cell))
    order = np.argsort(chunk, kind="stable")
    chunk, cell = chunk[order], cell[order]
    total = lambda x, where: np.bincount(where, x, len(own)).astype(np.int64)
    cells = np.bincount(chunk, minlength=len(own))
    body, body_signs = base[own] + total(whole[cell], chunk), base_signs[own] + total(signs[cell], chunk) + cells - 1
    above_of = near[cell]
    chunk_near, above_of = chunk[above_of >= 0], above_of[above_of >= 0]
    nears = np.bincount(chunk_near, minlength=len(own))
    full, full_signs = body + 2 + total(whole[above_of], chunk_near), body_signs + 2 + total(signs[above_of], chunk_near) + nears - 1  # [ABOVE]
    fits = (nears > 0) & (full + (full_signs + 1) // 2 <= budget)
    tokens = np.where(fits, full + (full_signs + 1) // 2, body + (body_signs + 1) // 2)
    chosen = fits[chunk_near]
    chunk_near, above_of = chunk_near[chosen], above_of[chosen]
    nears = np.where(fits, nears, 0)

    # texts are handed on by ``HELD`` bytes, as headers may be long
    if not len(own):
        return after
    bytes_ = _plain(pc.binary_length(header))[own] + total(_plain(pc.binary_length(pool))[source][cell], chunk)
    cuts = np.searchsorted(np.cumsum(bytes_) // HELD, np.arange(int(bytes_.sum()) // HELD + 1))
    for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
        if a == b:
            continue
        mine = slice(*np.searchsorted(chunk, (a, b)))
        over = slice(*np.searchsorted(chunk_near, (a, b)))
        line = _lists(pool.take(pa.array(source[cell[mine]])), cells[a:b], " | ")
        tail = pc.binary_join_element_wise("\n[ABOVE] ", _lists(pool.take(pa.array(source[above_of[over]])), nears[a:b], " | "), "")
        to = pa.array(own[a:b])
        whole_text = pc.binary_join_element_wise(header.take(to), "\n[ROW] ", line, pc.if_else(pa.array(fits[a:b]), tail, ""), "")
        out = [doc.take(to), row.take(to), pa.array(np.arange(a, b) - start[own[a:b]] + 1, pa.int32()), whole_text, pa.array(tokens[a:b], pa.int32()), pa.array(tokens[a:b] > budget)]
        yield pa.RecordBatch.from_arrays(out, ["doc", "row", "part", "text", "tokens", "oversized"])
    return after
