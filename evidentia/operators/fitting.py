"""R14 for many whole questions at once, as arrays: what ``budget`` does by joins for questions of any size.

Rows stand by question and, in it, from best to last, so that a row's number is its place; units likewise. Rounds (representatives,
last holders) go over all questions of a block together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task holds at once, and one question's more at most.
BLOCK = 1 << 16


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole questions. Rows come question by question; the first column is 1 where one begins."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        begins = np.flatnonzero(batch.column(0).to_numpy() == 1)
        if n + len(batch) > BLOCK and len(begins) and n + begins[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks()
            held, n, batch = [], 0, batch.slice(begins[-1])
        held.append(batch)
        n += len(batch)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 1 for values, 0 for null."""
    codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1)
    return codes.to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _before(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of what stands earlier in the same question; equal q stand together."""
    sums, at = np.cumsum(x) - x, _firsts(q)
    return sums - np.repeat(sums[at], np.diff(np.append(at, len(x))))


def evicted(t: pa.Table, audit: int, final: int) -> tuple[np.ndarray, np.ndarray]:
    """The step (from 0; -1: stays) in which each row leaves, and whether it takes its reduced text."""
    col = lambda c: t.column(c).to_numpy()
    step, reduced = np.full(len(t), -1), np.zeros(len(t), bool)
    begins, q = np.flatnonzero(col("n") == 1), np.cumsum(col("n") == 1) - 1
    long_ = (np.add.reduceat(col("tokens"), begins) > audit) | (np.add.reduceat(col("final_tokens"), begins) > final)
    at = np.flatnonzero(long_[q])
    if not len(at):
        return step, reduced
    score = col("score")
    at = at[np.lexsort((-score[at], ~np.isnan(score[at]), q[at]))]  # stable: equal scores stay by id
    rows = {c: col(c)[at] for c in ("score", "tokens", "final_tokens", "factual", "listed", "mandatory", "conflict")}
    rows |= {c: _codes(t.column(c))[at] for c in ("group", "source", "document")}
    lists = t.column("requirements").combine_chunks()
    owner = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy())
    place = np.full(len(t), -1)
    place[at] = np.arange(len(at))
    name, owner = _codes(pa.chunked_array([lists.flatten()])), place[owner]
    name, owner = name[owner >= 0], owner[owner >= 0]
    q = np.unique(q[at], return_inverse=True)[1]
    key = np.unique(q[owner] * (name.max(initial=0) + 1) + name, return_inverse=True)[1]
    gone = _leaving(rows, q, owner, key, audit, final)
    step[at] = gone
    # shorter texts, the longest first; of equal ones the smaller id, which is where the row stood
    saved = rows["tokens"] - t.column("reduced_tokens").fill_null(1 << 62).to_numpy()[at]
    kept = gone < 0
    sums = [np.bincount(q[kept], rows[c][kept], minlength=q[-1] + 1).astype(np.int64) for c in ("tokens", "final_tokens")]
    excess = np.maximum(sums[0] - audit, sums[1] - final)
    some = np.flatnonzero(kept & (saved > 0) & ~rows["conflict"] & (excess[q] > 0))
    some = some[np.lexsort((at[some], -rows["tokens"][some], q[some]))]
    reduced[at[some[_before(saved[some], q[some]) < excess[q[some]]]]] = True
    return step, reduced


def _picked(owner: np.ndarray, key: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each row's position among its question's representatives (greedy: most open requirements, then the first); -1 for others."""
    position, k = np.full(len(q), -1), 0
    done = np.zeros(key.max(initial=-1) + 1, bool)
    while len(owner):
        gain = np.bincount(owner, minlength=len(q))
        some = np.flatnonzero(gain)
        some = some[np.lexsort((-gain[some], q[some]))]
        best = some[_firsts(q[some])]
        position[best], k = k, k + 1
        done[key[position[owner] == k - 1]] = True
        left = ~done[key]
        owner, key = owner[left], key[left]
    return position


def _holders(unit: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Which units stay as last holders of open requirements (see ``budget.last_holders``); a unit's number is its place."""
    stay, keys = np.zeros(n, bool), key.max(initial=-1) + 1
    while len(unit):
        first = np.full(keys, n)
        np.minimum.at(first, key, unit)
        early = np.zeros(n + 1, bool)
        early[first] = True
        unit, key = unit[early[unit]], key[early[unit]]
        last = np.full(keys, -1)
        np.maximum.at(last, key, unit)
        stay[first[first == last]] = True
        met = np.zeros(keys, bool)
        met[key[stay[unit]]] = True
        unit, key = unit[~met[key]], key[~met[key]]
    return stay


def _leaving(rows: dict[str, np.ndarray], q: np.ndarray, owner: np.ndarray, key: np.ndarray, audit: int, final: int) -> np.ndarray:
    """The step in which each row leaves with its unit, or -1."""
    n = len(q)
    fact = rows["factual"][owner]
    position = _picked(owner[fact], key[fact], q)
    place = np.where(position >= 0, position, n + np.arange(n))
    # reserved: the best factual row of each source, or of each of its files if that is mandatory
    some = np.flatnonzero(rows["factual"] & ~rows["listed"])
    file = np.where(rows["mandatory"], rows["document"] + 1, 0)[some]
    whose = (q[some] * (rows["source"].max() + 1) + rows["source"][some]) * (file.max(initial=0) + 1) + file
    order = np.lexsort((place[some], -rows["score"][some], whose))
    reserved = np.zeros(n, bool)
    reserved[some[order[_firsts(whose[order])]]] = True
    # units, numbered by question and place
    group, groups = rows["group"], rows["group"].max() + 1
    unit = np.unique(np.where(group > 0, q * groups + group, (q[-1] + 1) * groups + np.arange(n)), return_inverse=True)[1]
    by = np.argsort(unit, kind="stable")
    begins = _firsts(unit[by])
    of = lambda f, x: f.reduceat(x[by], begins)
    own, latest = q[by][begins], of(np.maximum, place)
    order = np.lexsort((latest, own))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    unit = number[unit]
    uq, latest, first, count = own[order], latest[order], of(np.minimum, place)[order], np.diff(np.append(begins, n))[order]
    tokens, final_tokens = (of(np.add, rows[c])[order] for c in ("tokens", "final_tokens"))
    held, listed, mandatory, conflict, factual = (of(np.logical_or, x)[order] for x in (reserved, rows["listed"], rows["mandatory"], rows["conflict"], rows["factual"]))
    bound, alone, questions = listed | mandatory, count == 1, q[-1] + 1
    fixed = held | bound | conflict
    covered = np.zeros(key.max(initial=-1) + 1, bool)
    covered[key[fixed[unit[owner]]]] = True
    open_ = ~covered[key]
    holder = _holders(unit[owner][open_], key[open_], len(uq))
    any_ = lambda x: np.bincount(uq[x], minlength=questions) > 0
    stuck = any_(conflict & bound)
    step = np.select([bound, conflict, held, holder], [-1, 2, np.where(alone & ~stuck[uq], 3, -1), np.where(alone, 1, -1)], 0)
    some, fact = any_(step < 0), any_((step < 0) & factual)
    order = np.flatnonzero(step >= 0)
    order = order[np.lexsort((-np.where(conflict, first, latest)[order], step[order], uq[order]))]
    # the last factual unit is spared if no other stays, else the last of all
    ends, fact_ends = np.full(questions, -1), np.full(questions, -1)
    ends[uq[order]] = order
    own = order[factual[order]]
    fact_ends[uq[own]] = own
    anchor = np.where(~fact & (fact_ends >= 0), fact_ends, np.where(~some, ends, -1))
    stays = order == anchor[uq[order]]
    over = np.zeros(len(order), bool)
    for x, most in ((tokens, audit), (final_tokens, final)):
        over |= np.bincount(uq, x, minlength=questions).astype(np.int64)[uq[order]] - _before(np.where(stays, 0, x[order]), uq[order]) > most
    gone = np.full(len(uq), -1)
    leave = order[over & ~stays]
    gone[leave] = step[leave]
    return gone[unit]
