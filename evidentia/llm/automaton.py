"""Suffix automata over sequences of hashed words."""

from __future__ import annotations

import numpy as np


class Automaton:
    """The suffix automaton of several word sequences, each with a weight.

    ``weight(state)``: in how many places, counted with weights, the state's
    sequences end. Memory is a few hundred bytes a word: callers bound the words
    of a shard.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self._summed = False

    def add(self, sequence: list[int], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._clone(last, q, c)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            count[last] += weight

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> Automaton:
        """Adds each state's places to its suffixes'; after this no more sequences."""
        if not self._summed:
            for s in np.argsort(self.length)[::-1].tolist():
                if self.link[s] >= 0:
                    self.count[self.link[s]] += self.count[s]
            self._summed = True
        return self

    def matches(self, sequence: list[int], least: int) -> list[tuple[int, int, int]]:
        """Matching statistics: (start, length, places of its last ``least`` words) of the longest match that ends at each
        position, where that is ``least`` words or more."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out = []
        s = size = 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                size = length[s]
            t = nxt[s].get(c)
            if t is None:
                size = 0
                continue
            s, size = t, size + 1
            if size >= least:
                u = s
                while length[link[u]] >= least:
                    u = link[u]
                out.append((i - size + 1, size, count[u]))
        return out
