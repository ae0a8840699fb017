"""Weighted acyclic automata of sequences of one length: each path spells a sequence, its last arc
has its count.

A minimal automaton is built from sorted sequences: what lies below a prefix is complete when the
next prefix begins, and is then looked up in a register, so that equal remainders are one state.
Layers are arrays: layer d has the arcs of all states that d labels lead to, state after state,
labels ascending within a state.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Layer(NamedTuple):
    first: np.ndarray  # where the arcs of each state begin, and the end
    labels: np.ndarray
    to: np.ndarray  # a state of the next layer; the count, in the last layer


class Transducer:
    def __init__(self, layers: list[Layer]):
        self.layers = layers

    @classmethod
    def build(cls, rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From different rows of labels in ascending order, and their counts."""
        size, length = rows.shape
        new = np.ones((length, size), bool)  # new[d]: the first d + 1 labels are not those before
        for d in range(length):
            new[d, 1:] = rows[1:, d] != rows[:-1, d]
            if d:
                new[d] |= new[d - 1]
        layers: list[Layer] = []
        arcs, to = np.arange(size), counts.astype(np.int64)
        for d in range(length - 1, -1, -1):
            labels = rows[arcs, d]
            begin = np.searchsorted(arcs, np.flatnonzero(new[d - 1])) if d else np.zeros(min(size, 1), np.int64)
            bounds = np.append(begin, len(arcs))
            raw, targets, register = labels.tobytes(), to.tobytes(), {}
            state, kept = np.empty(len(begin), np.int64), []
            edges = bounds.tolist()
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                known = register.setdefault((raw[4 * a : 4 * b], targets[8 * a : 8 * b]), len(kept))
                if known == len(kept):
                    kept.append(i)
                state[i] = known
            sizes = np.diff(bounds)[kept]
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            own = spread(bounds[kept], sizes)
            layers.append(Layer(first, labels[own], to[own]))
            arcs, to = arcs[begin], state
        return cls(layers[::-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order, and their counts."""
        states, paths = np.zeros(min(len(self.layers[0].labels), 1), np.int64), []
        for layer in self.layers:
            sizes = (layer.first[1:] - layer.first[:-1])[states]
            arcs = spread(layer.first[states], sizes)
            paths = [np.repeat(p, sizes) for p in paths] + [layer.labels[arcs]]
            states = layer.to[arcs]
        return np.stack(paths, 1), states

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """Counts of given rows, walked through the layers together; 0 where there is no path."""
        states = np.zeros(len(rows), np.int64)
        there = np.full(len(rows), len(self.layers[0].labels) > 0)
        for d, layer in enumerate(self.layers):
            owner = np.repeat(np.arange(len(layer.first) - 1, dtype=np.uint64), np.diff(layer.first))
            arcs = owner << np.uint64(32) | layer.labels
            wanted = states.astype(np.uint64) << np.uint64(32) | rows[:, d]
            at = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
            there &= arcs[at] == wanted if len(arcs) else False
            states = np.where(there, layer.to[at] if len(arcs) else 0, 0)
        return states

    def pack(self) -> bytes:
        """Numbers little-endian: how many layers, their states and arcs, then their arrays."""
        head = [len(self.layers), *(x for a in self.layers for x in (len(a.first) - 1, len(a.labels)))]
        parts = [np.array(head, np.int64).tobytes()]
        for a in self.layers:
            parts += [a.first.astype(np.int64).tobytes(), a.labels.astype(np.uint32).tobytes(), a.to.astype(np.int64).tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        (length,) = np.frombuffer(raw, np.int64, 1)
        sizes = np.frombuffer(raw, np.int64, 2 * length, 8).reshape(-1, 2).tolist()
        at, layers = 8 + 16 * int(length), []
        for states, arcs in sizes:
            first = np.frombuffer(raw, np.int64, states + 1, at)
            labels = np.frombuffer(raw, np.uint32, arcs, at + 8 * (states + 1))
            to = np.frombuffer(raw, np.int64, arcs, at + 8 * (states + 1) + 4 * arcs)
            at += 8 * (states + 1) + 12 * arcs
            layers.append(Layer(first, labels, to))
        return cls(layers)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Distinct:
    """The different rows of a matrix of labels in ascending order, and where each row went."""

    def __init__(self, rows: np.ndarray):
        size, length = rows.shape
        wide = np.zeros((size, length + length % 2), np.uint32)
        wide[:, :length] = rows
        pairs = [wide[:, d].astype(np.uint64) << np.uint64(32) | wide[:, d + 1] for d in range(0, length, 2)]
        order = np.lexsort(pairs[::-1]) if len(pairs) > 1 else np.argsort(pairs[0], kind="stable")
        new = np.ones(size, bool)
        if size:
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in pairs])
        self.group = np.cumsum(new) - 1
        self.back = np.empty(size, np.int64)
        self.back[order] = self.group
        self.order, self.begin = order, np.flatnonzero(new)
        self.rows = rows[order[new]]

    def __len__(self) -> int:
        return len(self.rows)

    def counts(self) -> np.ndarray:
        return np.bincount(self.group, minlength=len(self)).astype(np.int64)

    def reduced(self, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        """One value for each different row."""
        return how.reduceat(values[self.order], self.begin) if len(self.begin) else values[:0]


def union(parts: list[Transducer], length: int) -> tuple[Distinct, np.ndarray, list[int]]:
    """Different sequences of several automata, their summed counts, and the sizes of the parts."""
    listed = [p.rows() for p in parts]
    rows = np.concatenate([r for r, _ in listed]) if listed else np.zeros((0, length), np.uint32)
    both = Distinct(rows)
    return both, both.reduced(np.concatenate([c for _, c in listed]) if listed else np.zeros(0, np.int64)), [len(r) for r, _ in listed]
