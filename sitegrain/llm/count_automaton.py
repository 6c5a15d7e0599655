"""Weighted acyclic automata of counted symbol sequences: incremental building, union and lookups.

An arc carries the count of the sequence that ends with it (0: not counted itself). Sorted sequences are added run by run, where a
run is all sequences that differ in their last symbol only; a state is frozen once the sorted order has passed it, and shares the
arcs of an equal state that was frozen before. Symbols are strings in the order of their UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The state without arcs; a symbol id where a sequence has ended.
LAST, END = 0, -1


class Automaton:
    """``symbols``; arcs of state s from ``first[s]`` to ``first[s + 1]``, by label; the start is the highest state."""

    def __init__(self, symbols: pa.Array, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.symbols, self.first, self.label, self.weight, self.target = symbols, first, label, weight, target

    def to_bytes(self) -> bytes:
        _, offsets, data = self.symbols.buffers()
        off = np.frombuffer(offsets, np.int32)[: len(self.symbols) + 1] if len(self.symbols) else np.zeros(1, np.int32)
        head = np.array([len(self.symbols), off[-1], len(self.first), len(self.label)], np.int64)
        text = data.to_pybytes()[: off[-1]] if data is not None else b""
        arrays = self.weight.astype(np.int64), off, self.first.astype(np.int32), self.label.astype(np.int32), self.target.astype(np.int32)
        return b"".join([head.tobytes(), *(a.tobytes() for a in arrays), text])

    @staticmethod
    def from_bytes(raw: bytes) -> Automaton:
        n, size, states, arcs = np.frombuffer(raw, np.int64, 4).tolist()
        at, got = 32, []
        for kind, count in ((np.int64, arcs), (np.int32, n + 1), (np.int32, states), (np.int32, arcs), (np.int32, arcs)):
            got.append(np.frombuffer(raw, kind, count, at))
            at += got[-1].nbytes
        weight, off, first, label, target = got
        return Automaton(pa.StringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(raw[at : at + size])), first, label, weight, target)

    def sequences(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1, the counted sequences (rows of symbol ids) in order, and their counts."""
        out = []
        state, above = np.array([len(self.first) - 2], np.int64), np.empty((1, 0), np.int32)
        while len(state):
            n = self.first[state + 1] - self.first[state]
            arc = np.repeat(self.first[state] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            above = np.concatenate([np.repeat(above, n, 0), self.label[arc][:, None]], 1)
            counted = self.weight[arc] > 0
            out.append((above[counted], self.weight[arc][counted]))
            on = self.target[arc] != LAST
            state, above = self.target[arc][on].astype(np.int64), above[on]
        return out

    def counts(self, sequences: list[list[str]]) -> np.ndarray:
        """Counts of sequences of symbols, 0 for those that are not there: their composition with this automaton."""
        width = max(map(len, sequences), default=0)
        flat = pa.array([w for s in sequences for w in s], pa.string())
        ids = pc.fill_null(pc.index_in(flat, self.symbols), -2).to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.array([len(s) for s in sequences], np.int64)
        rows = np.full((len(sequences), width), -2, np.int64)
        rows[np.arange(width) < length[:, None]] = ids
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 32 | self.label
        state, out = np.full(len(sequences), len(self.first) - 2, np.int64), np.zeros(len(sequences), np.int64)
        live = np.arange(len(sequences))
        for d in range(width):
            live = live[(length[live] > d) & (rows[live, d] >= 0)]
            want = state[live] << 32 | rows[live, d]
            arc = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            there = keys[arc] == want if len(keys) else np.zeros(len(live), bool)
            live, arc = live[there], arc[there]
            ends = length[live] == d + 1
            out[live[ends]] = self.weight[arc[ends]]
            state[live] = self.target[arc]
        return out


class _Open:
    """A state that is not frozen yet: its arcs, and arcs to frozen states that await their place."""

    __slots__ = ("label", "weight", "below")

    def __init__(self):
        self.label, self.weight, self.below = np.empty(0, np.int32), np.empty(0, np.int64), {}


class Builder:
    def __init__(self):
        self.first, self.arcs, self.size = [0, 0], [], 0
        self.register: dict[bytes, int] = {b"": LAST}
        self.path: list[int] = []
        self.open = [_Open()]

    def _frozen(self, s: _Open) -> int:
        """The state with just these arcs, an earlier one if there is one."""
        label, weight, target = s.label, s.weight, np.zeros(len(s.label), np.int32)
        if s.below:
            new = np.array(sorted(set(s.below) - set(label.tolist())), np.int32)  # a prefix that is not counted itself
            label = np.concatenate([label, new])
            order = np.argsort(label, kind="stable")
            label, weight = label[order], np.concatenate([weight, np.zeros(len(new), np.int64)])[order]
            target = np.zeros(len(label), np.int32)
            to = np.array(sorted(s.below), np.int32)
            target[np.searchsorted(label, to)] = [s.below[x] for x in to.tolist()]
        key = label.tobytes() + weight.tobytes() + target.tobytes()
        if (known := self.register.get(key)) is not None:
            return known
        self.register[key] = state = len(self.first) - 1
        self.arcs.append((label, weight, target))
        self.size += len(label)
        self.first.append(self.size)
        return state

    def _close(self, depth: int) -> None:
        while len(self.path) > depth:
            state = self._frozen(self.open.pop())
            self.open[-1].below[self.path.pop()] = state

    def add(self, prefix: list[int], labels: np.ndarray, weights: np.ndarray) -> None:
        """The sequences ``prefix`` + [label], in order; prefixes come in order too, a shorter one before those that begin with it."""
        same = 0
        while same < min(len(prefix), len(self.path)) and prefix[same] == self.path[same]:
            same += 1
        self._close(same)
        for x in prefix[same:]:
            self.path.append(x)
            self.open.append(_Open())
        self.open[-1].label, self.open[-1].weight = labels.astype(np.int32), weights.astype(np.int64)

    def finish(self, symbols: pa.Array) -> Automaton:
        self._close(0)
        self.register = {}  # the start is the highest state, even if a state below has the same arcs
        self._frozen(self.open[0])
        return Automaton(symbols, np.array(self.first, np.int32), *(np.concatenate(p) for p in zip(*self.arcs)))


def build(symbols: pa.Array, rows: np.ndarray, weights: np.ndarray) -> Automaton:
    """The automaton of distinct sequences: rows of ids of the sorted ``symbols``, filled up with END."""
    out = Builder()
    if len(rows):
        length = (rows != END).sum(1)
        last = rows[np.arange(len(rows)), length - 1]
        prefix = rows.copy()
        prefix[np.arange(len(rows)), length - 1] = END
        order = np.lexsort((last, *prefix.T[::-1]))
        prefix, last, weights, length = prefix[order], last[order], weights[order], length[order]
        new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(1)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(rows)]):
            out.add(prefix[a, : length[a] - 1].tolist(), last[a:b], weights[a:b])
    return out.finish(symbols)


def used(symbols: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The symbols that occur in ``rows``, and the rows in terms of these."""
    ids, new = np.unique(rows, return_inverse=True)
    ended = int(len(ids) > 0 and ids[0] == END)
    return symbols.take(pa.array(ids[ended:])), (new.reshape(rows.shape) - ended).astype(np.int32)


def union(automata: list[Automaton]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The sorted symbols and, for each length, the distinct sequences of all automata with the sums of their counts."""
    every = pa.chunked_array([a.symbols for a in automata], pa.string()).combine_chunks()
    symbols = pc.unique(every)
    symbols = symbols.take(pc.array_sort_indices(symbols))
    new = pc.index_in(every, symbols).to_numpy(zero_copy_only=False).astype(np.int32)
    by_length: dict[int, list] = {}
    at = 0
    for a in automata:
        own = new[at : at + len(a.symbols)]
        at += len(a.symbols)
        for d, (rows, weights) in enumerate(a.sequences()):
            if len(rows):
                by_length.setdefault(d, []).append((own[rows], weights))
    out = []
    for d in range(max(by_length, default=-1) + 1):
        found = by_length.get(d)
        if not found:
            out.append((np.empty((0, d + 1), np.int32), np.empty(0, np.int64)))
            continue
        rows, weights = np.concatenate([r for r, _ in found]), np.concatenate([w for _, w in found])
        order = np.lexsort(rows.T[::-1])
        rows, weights = rows[order], weights[order]
        head = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
        out.append((rows[head], np.add.reduceat(weights, head)))
    return symbols, out
