"""A minimal acyclic transducer from words to id lists, in flat arrays that can be memory-mapped.

States are shared between equal suffixes. Each arc carries the number of words
that sort before it in its state, so the outputs along a word's path add up to
the word's number; the number finds the word's ids. Built from sorted words in
one pass, with a register of the states that are final for good.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np

_MAGIC = np.int64(0x31584C)


class Lexicon:
    """``arcs`` (state << 8 | byte, ascending), ``to``, ``skip`` per arc; ``final`` per state; ``at``, ``ids`` per word."""

    def __init__(self, arcs, to, skip, final, at, ids):
        self.arcs, self.to, self.skip, self.final, self.at, self.ids = arcs, to, skip, final, at, ids

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple]] = []  # by state: final, ((byte, state), ...)

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        words = sorted(entries)
        path: list[list] = [[False, []]]  # the states of the word before, not yet shared
        last = b""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1][1].append((last[i - 1], close(path.pop())))
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], close(path.pop())))
        root = close(path[0])
        below = [0] * len(done)  # words through a state; targets are closed before their sources
        keys, to, skip = [], [], []
        for s, (final, arcs) in enumerate(done):
            n = int(final)
            for byte, t in arcs:
                keys.append(s << 8 | byte)
                to.append(t)
                skip.append(n)
                n += below[t]
            below[s] = n
        order = np.argsort(np.array(keys, np.int64)) if keys else np.empty(0, np.int64)
        at = np.concatenate(([0], np.cumsum([len(entries[w]) for w in words]))).astype(np.int64)
        ids = np.array([i for w in words for i in entries[w]], np.int32)
        assert root == len(done) - 1
        return cls(np.array(keys, np.int64)[order], np.array(to, np.int32)[order], np.array(skip, np.int32)[order], np.array([f for f, _ in done], np.int8), at, ids)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it isn't in the lexicon; all words take each step together."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.arcs):
            return out
        live, state, total = np.arange(len(starts)), np.full(len(starts), len(self.final) - 1, np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            over = starts[live] + step >= ends[live]
            good = over & (self.final[state] == 1)
            out[live[good]] = total[good]
            live, state, total = live[~over], state[~over], total[~over]
            key = state << 8 | raw[starts[live] + step]
            i = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[i] == key
            i, live = i[hit], live[hit]
            state, total = self.to[i].astype(np.int64), total[hit] + self.skip[i]
            step += 1
        return out

    def word_ids(self, number: int) -> list[int]:
        return self.ids[self.at[number] : self.at[number + 1]].tolist()

    def data(self) -> bytes:
        """The whole as one file's content; each array begins at a multiple of 8 bytes."""
        arrays = [np.ascontiguousarray(x) for x in (self.arcs, self.to, self.skip, self.final, self.at, self.ids)]
        head = np.array([_MAGIC, *(len(x) for x in arrays)], np.int64).tobytes()
        return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays)

    def save(self, folder: str) -> str:
        """Writes one file, named by its content."""
        data = self.data()
        path = Path(folder) / f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin"
        path.write_bytes(data)
        return str(path)

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-maps a file: the processes of a machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:56].view(np.int64)
        if head[0] != _MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        at, out = 56, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.int8, np.int64, np.int32), strict=True):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        return cls(*out)
