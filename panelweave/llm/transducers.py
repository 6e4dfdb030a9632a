"""Weighted acyclic automata from sequences of numbers to counts.

A ``Transducer`` is the least automaton for a set of sequences. Each edge weighs as many sequences as go by
smaller edges before it, so the weights along a path add up to the sequence's number in ascending order,
and ``counts`` has the count at that number. Automata share whatever ends alike; counts do not
keep them apart.

A shard's automaton comes from its sorted sequences as whole columns: one state per prefix, and one end. ``Builder``
makes the least automaton of a stream of sequences, state by state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

Key = tuple[int, ...]
#: Columns that hold a transducer in a table.
COLUMNS = "first array<int>, label array<long>, target array<int>, weight array<int>, final array<boolean>, counts array<long>"


@dataclass
class Transducer:
    first: Sequence[int]  #: edges of state s: first[s] to first[s + 1]
    label: Sequence[int]
    target: Sequence[int]
    weight: Sequence[int]
    final: Sequence[bool]
    counts: Sequence[int]

    def find(self, key: Sequence[int]) -> int:
        """The count of ``key``; 0 if it is not there."""
        state, number = len(self.final) - 1, 0
        for symbol in key:
            end = self.first[state + 1]
            j = bisect_left(self.label, symbol, self.first[state], end)
            if j == end or self.label[j] != symbol:
                return 0
            number += self.weight[j]
            state = self.target[j]
        return self.counts[number] if self.final[state] else 0

    def columns(self, length: int) -> list[np.ndarray]:
        """All sequences, which have ``length`` symbols each, in ascending order: an array per place."""
        first, label, target = (np.asarray(x, np.int64) for x in (self.first, self.label, self.target))
        state, out = np.array([len(self.final) - 1]), []
        for _ in range(length):
            n = first[state + 1] - first[state]
            edge = np.repeat(first[state] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out = [np.repeat(c, n) for c in out] + [label[edge]]
            state = target[edge]
        return out

    def items(self) -> Iterator[tuple[Key, int]]:
        """All sequences in ascending order, with their counts."""
        counts = iter(self.counts)
        stack: list[tuple[int, Key]] = [(len(self.final) - 1, ())]
        while stack:
            state, key = stack.pop()
            if self.final[state]:
                yield key, next(counts)
            stack += [(self.target[j], (*key, self.label[j])) for j in range(self.first[state + 1] - 1, self.first[state] - 1, -1)]

    def row(self) -> dict:
        return dict(vars(self))

    @staticmethod
    def of_row(row) -> Transducer:
        return Transducer(*([*row[c]] if isinstance(row[c], list) else row[c].tolist() for c in ("first", "label", "target", "weight", "final", "counts")))


class _Open:
    """A state that may still get edges."""

    __slots__ = ("final", "label", "target")

    def __init__(self) -> None:
        self.final = False
        self.label: list[int] = []
        self.target: list[int] = []


class Builder:
    """Builds the least automaton from ascending sequences, one at a time.

    Only the states on the way of the last sequence are open. A state is closed once a sequence leaves it
    behind, and is then the same as any closed one with the same edges.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.size: list[int] = []
        self.path = [_Open()]
        self.last: Key = ()
        self.first, self.label, self.target, self.weight, self.final, self.counts = [0], [], [], [], [], []

    def _closed(self, state: _Open) -> int:
        shape = (state.final, *state.label, *state.target)
        found = self.known.get(shape)
        if found is None:
            found = self.known[shape] = len(self.final)
            size = int(state.final)
            for t in state.target:
                self.weight.append(size)
                size += self.size[t]
            self.size.append(size)
            self.label += state.label
            self.target += state.target
            self.final.append(state.final)
            self.first.append(len(self.label))
        return found

    def _leave(self, depth: int) -> None:
        path = self.path
        while len(path) - 1 > depth:
            number = self._closed(path.pop())
            path[-1].label.append(self.last[len(path) - 1])
            path[-1].target.append(number)

    def add(self, key: Key, count: int) -> None:
        """``key`` must be greater than all before."""
        last, p = self.last, 0
        for a, b in zip(key, last):
            if a != b:
                break
            p += 1
        self._leave(p)
        self.last = key
        self.path += [_Open() for _ in range(len(key) - p)]
        self.path[-1].final = True
        self.counts.append(count)

    def done(self) -> Transducer:
        self._leave(0)
        root = self.path.pop()
        if root.label or root.final or not self.final:
            self.known.clear()  # the root comes last, whatever it is like
            self._closed(root)
        return Transducer(self.first, self.label, self.target, self.weight, self.final, self.counts)


def build(items: Iterable[tuple[Key, int]]) -> Transducer:
    """The transducer of ascending (sequence, count) pairs."""
    b = Builder()
    for key, count in items:
        b.add(key, count)
    return b.done()


def of_sorted(columns: Sequence[np.ndarray], counts: np.ndarray) -> Transducer:
    """The transducer of sequences of one length, given as ascending, distinct rows of ``columns``: a state per prefix, and one end."""
    rows, depth = len(counts), len(columns)
    starts, new = [], np.zeros(rows, bool)
    new[:1] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        starts.append(np.flatnonzero(new))  # where each prefix of one more symbol begins
    first, label, target, weight, states = [np.zeros(1, np.int64)], [], [], [], 1
    edges = 0
    for d in range(depth - 1, -1, -1):
        at, owner = starts[d], starts[d - 1] if d else np.zeros(min(rows, 1), np.int64)
        of = np.searchsorted(owner, at, "right") - 1
        label.append(columns[d][at])
        target.append(np.zeros(len(at), np.int64) if d == depth - 1 else states - len(at) + np.arange(len(at)))
        weight.append(at - owner[of])
        first.append(edges + np.searchsorted(at, owner))
        edges += len(at)
        states += len(owner)
    first.append(np.array([edges]))
    final = np.zeros(states, bool)
    final[0] = True
    return Transducer(*(np.concatenate(x) for x in (first, label, target, weight)), final, counts)


def tally(columns: Sequence[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in ascending order, and the sums of their ``n``."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n[order], at) if len(at) else n


def union(parts: Sequence[Transducer], length: int, least: int = 1) -> Transducer:
    """One least transducer of sequences of ``length`` symbols with the sums of their counts; sums below ``least`` are left out."""
    columns = [np.concatenate(c) for c in zip(*(p.columns(length) for p in parts), strict=True)]
    columns, n = tally(columns, np.concatenate([np.asarray(p.counts, np.int64) for p in parts]))
    keep = n >= least
    return build(zip(zip(*(c[keep].tolist() for c in columns), strict=True), n[keep].tolist(), strict=True))
