"""The keyed state of ``stream_states``: transition functions of runs of event numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelweave.operators.event_log import state_names

#: Numbers in a chunk; a whole chunk is one function.
CHUNK = 1024
#: Open chunks of a session that lie in one value, and events that are taken in at a time.
FEW_CHUNKS = 4
PIECE = 10_000


class Moves:
    """Functions from states to states, as rows of ``to`` and ``bad``.

    State 0 is the dead one of an illegal event; ``bad`` is that event's number, or -1.
    """

    def __init__(self, transitions, start: str):
        self.names = [None, *state_names(transitions)]
        at = {s: i for i, s in enumerate(self.names)}
        self.start, self.size = at[start], len(self.names)
        self.number: dict[str, int] = {}
        table: list[list[int]] = []
        for s, e, to in transitions:
            if e not in self.number:
                self.number[e] = len(table)
                table.append([0] * self.size)
            table[self.number[e]][at[s]] = at[to]
        self.table = np.array([*table, [0] * self.size])  # the last row is for unknown events

    def single(self, numbers: np.ndarray, events: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A function for each event."""
        to = self.table[[self.number.get(e, -1) for e in events]]
        bad = np.where(to == 0, numbers[:, None], -1)
        bad[:, 0] = -1
        return to, bad

    @staticmethod
    def then(to: np.ndarray, bad: np.ndarray, to2: np.ndarray, bad2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row by row, the first function and then the second."""
        row = np.arange(len(to))[:, None]
        return to2[row, to], np.where(to == 0, bad, bad2[row, to])

    def all_of(self, to: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One function for all rows in order: neighbours are joined, then neighbours of those."""
        while len(to) > 1:
            odd = to[-1:], bad[-1:]
            n = len(to) // 2 * 2
            a, b = self.then(to[0:n:2], bad[0:n:2], to[1:n:2], bad[1:n:2])
            to, bad = (a, b) if n == len(to) else (np.concatenate((a, odd[0])), np.concatenate((b, odd[1])))
        return to, bad


class Runs:
    """Runs of neighbouring numbers of a chunk, apart from each other, in order, with a function each."""

    def __init__(self, moves: Moves, first=(), last=(), to=(), bad=()):
        self.moves = moves
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.to, self.bad = np.array(to, np.int64).reshape(-1, moves.size), np.array(bad, np.int64).reshape(-1, moves.size)

    def add(self, numbers: np.ndarray, events: list[str]) -> None:
        """Take in events, in any order; numbers that were there before are skipped, and of equal new ones the first counts."""
        numbers, at = np.unique(numbers, return_index=True)
        k = np.searchsorted(self.first, numbers, "right") - 1
        there = (k >= 0) & (numbers <= self.last[k]) if len(self.first) else np.zeros(len(numbers), bool)
        numbers, at = numbers[~there], at[~there]
        if not len(numbers):
            return
        to, bad = self.moves.single(numbers, [events[i] for i in at])
        first, last = np.concatenate((self.first, numbers)), np.concatenate((self.last, numbers))
        to, bad = np.concatenate((self.to, to)), np.concatenate((self.bad, bad))
        order = np.argsort(first)
        first, last, to, bad = first[order], last[order], to[order], bad[order]
        head = np.flatnonzero(np.concatenate(([True], first[1:] != last[:-1] + 1)))  # a gap before each of these
        ends = [*head[1:], len(first)]
        joined = [self.moves.all_of(to[a:b], bad[a:b]) for a, b in zip(head, ends, strict=True)]
        self.first, self.last = first[head], last[np.array(ends) - 1]
        self.to, self.bad = (np.concatenate(x) for x in zip(*joined, strict=True))

    @property
    def count(self) -> int:
        return int((self.last - self.first + 1).sum())

    def row(self) -> tuple:
        return self.first.tolist(), self.last.tolist(), self.to.ravel().tolist(), self.bad.ravel().tolist()


class RunStates(StatefulProcessor):
    """Per session: one function for the chunks that are whole from number 1 on, and the runs of each other chunk.

    A few open chunks lie beside that function, so that a session is read and written once per batch; more of them are a map by chunk.
    """

    def __init__(self, session: str, transitions, start: str):
        self.session, self.moves = session, Moves(transitions, start)
        self.out = Row(session, "state", "version", "illegal_at", "missing")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", "upto long, to array<long>, bad array<long>, mapped boolean, chunks array<long>, sizes array<long>, first array<long>, last array<long>, open_to array<long>, open_bad array<long>")
        self.open = handle.getMapState("open", "chunk long", "first array<long>, last array<long>, to array<long>, bad array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        m = self.moves
        whole = self.whole.get()
        upto, to, bad, mapped = (whole[0], np.array([whole[1]]), np.array([whole[2]]), whole[3]) if whole else (0, np.arange(m.size)[None, :], np.full((1, m.size), -1), False)
        near = self._unpacked(*whole[4:]) if whole and not mapped else {}

        def opened(c: int) -> Runs | None:
            if c not in near and mapped and self.open.containsKey((c,)):
                return Runs(m, *self.open.getValue((c,)))
            return near.get(c)

        def closed(c: int) -> None:
            near.pop(c, None)
            if mapped:
                self.open.removeKey((c,))

        while part := [(r["sequence"], r["event_type"]) for r in islice(rows, PIECE)]:
            numbers = np.array([n for n, _ in part if n is not None], np.int64)
            events = [e for n, e in part if n is not None]
            chunk = (numbers - 1) // CHUNK
            for c in np.unique(chunk).tolist():
                if 0 <= c < upto:
                    continue  # every number of it has been seen
                at = np.flatnonzero(chunk == c)
                runs = opened(c) or Runs(m)
                runs.add(numbers[at], [events[i] for i in at.tolist()])
                if mapped:
                    self.open.updateValue((c,), runs.row())
                else:
                    near[c] = runs
            if not mapped and len(near) > FEW_CHUNKS:
                mapped = True
                for c, runs in near.items():
                    self.open.updateValue((c,), runs.row())
                near.clear()
        while (runs := opened(upto)) and runs.count == CHUNK:
            to, bad = m.then(to, bad, runs.to, runs.bad)
            closed(upto)
            upto += 1
        left = sorted(((k[0], Runs(m, *v)) for k, v in self.open.iterator()) if mapped else near.items(), key=itemgetter(0))
        if mapped and len(left) <= FEW_CHUNKS:
            mapped = False
            self.open.clear()
        self.whole.update((upto, to[0].tolist(), bad[0].tolist(), mapped, *self._packed([] if mapped else left)))
        before = [x for c, x in left if c < 0]
        after = [x for c, x in left if c >= 0]
        ends = np.concatenate([x.to for x in before] + [to] + [x.to for x in after]), np.concatenate([x.bad for x in before] + [bad] + [x.bad for x in after])
        last = max([upto * CHUNK] * (upto > 0) + [int(x.last[-1]) for x in before + after], default=None)
        seen = upto * CHUNK + sum(x.count for x in after)
        f, g = (int(x[0, m.start]) for x in m.all_of(*ends))
        yield self.out(key[0], m.names[f], last, g if g >= 0 else None, max(last or 0, 0) - seen)

    def _packed(self, left: list[tuple[int, Runs]]) -> tuple:
        rows = [x.row() for _, x in left]
        return [c for c, _ in left], [len(x.first) for _, x in left], *([v for row in rows for v in row[k]] for k in range(4))

    def _unpacked(self, chunks: list, sizes: list, *flat: list) -> dict[int, Runs]:
        out, a, wide = {}, 0, (1, 1, self.moves.size, self.moves.size)
        for c, n in zip(chunks, sizes, strict=True):
            out[c] = Runs(self.moves, *(x[a * w : (a + n) * w] for x, w in zip(flat, wide, strict=True)))
            a += n
        return out

    def close(self) -> None:
        pass
