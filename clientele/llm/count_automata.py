"""Weighted acyclic automata that count word sequences.

A ``CountAutomaton`` reads words and gives each accepted sequence its count. States are numbered by
depth; the arcs of a state are ordered by word, carry a weight (0: the sequence does not end here)
and lead to a state one deeper. It is built from sorted rows, level by level from the deepest, and a
state whose arcs equal those of a known one is that state. All work is on arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

NONE = -1  # the target of an arc after which nothing follows


def distinct_rows(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, inverse, count) of the different rows in order; the values are in [0, base)."""
    code = columns[0].astype(np.int64)
    for column in columns[1:]:
        _, code = np.unique(code, return_inverse=True)  # keeps the product below 64 bits
        code = code.astype(np.int64) * base + column
    _, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, count


def _same_states(start: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """The representative (its first index) of each state; a state's arcs are ``values[start[s]:start[s + 1]]``."""
    n = len(start) - 1
    if not n:
        return np.zeros(0, np.int64)
    width = np.diff(start)
    own = np.repeat(np.arange(n), width)
    inside = np.arange(start[-1]) - start[own]
    mark = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k, v in enumerate(values):
            arc = (v.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            arc = (arc ^ (arc >> np.uint64(29))) * (2 * inside.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
            mark = mark * np.uint64(0x94D049BB133111EB) + np.add.reduceat(arc, start[:-1])
    _, first, inverse = np.unique(mark, return_index=True, return_inverse=True)
    lead = first[inverse]
    # Equal marks only propose: a state joins the first one with its mark if every arc agrees.
    agree = width == width[lead]
    arcs = np.flatnonzero(agree[own])
    other = start[lead[own[arcs]]] + inside[arcs]
    differs = np.zeros(len(arcs), bool)
    for v in values:
        differs |= v[arcs] != v[other]
    agree[own[arcs[differs]]] = False
    return np.where(agree, lead, np.arange(n))


@dataclass
class CountAutomaton:
    symbols: list[bytes]           # ascending; an arc's label is an index
    start: list[np.ndarray]        # per depth: where the arcs of each state begin, and the end
    label: list[np.ndarray]
    weight: list[np.ndarray]
    target: list[np.ndarray]

    @classmethod
    def from_sorted(cls, symbols: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> CountAutomaton:
        """From different rows of equal length in ascending order."""
        depth, n = len(columns), len(weights)
        new = np.zeros(n, bool)
        new[:1] = True
        begins = []  # the rows at which a prefix of d + 1 words begins
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
            begins.append(np.flatnonzero(new))
        out = cls(symbols, [np.zeros(0)] * depth, [np.zeros(0)] * depth, [np.zeros(0)] * depth, [np.zeros(0)] * depth)
        target = np.full(n, NONE, np.int64)
        for d in range(depth - 1, -1, -1):
            rows = begins[d]
            label = columns[d][rows].astype(np.int64)
            weight = weights.astype(np.int64) if d == depth - 1 else np.zeros(len(rows), np.int64)
            states = begins[d - 1] if d else np.zeros(min(n, 1), np.int64)
            start = np.append(np.searchsorted(rows, states), len(rows)).astype(np.int64)
            lead = _same_states(start, label, weight, target)
            kept = np.flatnonzero(lead == np.arange(len(lead)))
            number = np.zeros(len(lead), np.int64)
            number[kept] = np.arange(len(kept))
            width = np.diff(start)[kept]
            arcs = np.repeat(start[:-1][kept] - np.cumsum(width) + width, width) + np.arange(width.sum())
            out.start[d] = np.append(0, np.cumsum(width)).astype(np.int64)
            out.label[d], out.weight[d], out.target[d] = label[arcs], weight[arcs], target[arcs]
            target = number[lead]
        return out

    def rows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The accepted sequences in order, a column for each place, and their weights."""
        state = np.zeros(min(len(self.label[0]), 1), np.int64)
        columns: list[np.ndarray] = []
        weight = np.zeros(0, np.int64)
        for start, label, weights, target in zip(self.start, self.label, self.weight, self.target):
            width = start[state + 1] - start[state]
            before = np.repeat(np.cumsum(width) - width, width)
            arcs = np.repeat(start[state], width) + np.arange(width.sum()) - before
            columns = [np.repeat(c, width) for c in columns] + [label[arcs]]
            weight, state = weights[arcs], target[arcs]
        return columns, weight

    def pack(self) -> bytes:
        head = np.array([len(self.label), len(self.symbols), *map(len, self.start), *map(len, self.label)], "<i8")
        sizes = np.array([len(s) for s in self.symbols], "<i8")
        parts = [np.diff(s) for s in self.start] + self.label + self.target
        raw = b"".join([head.tobytes(), sizes.tobytes(), *[w.astype("<i8").tobytes() for w in self.weight],
                        *[p.astype("<i4").tobytes() for p in parts], *self.symbols])
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, blob: bytes) -> CountAutomaton:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        depth, n = np.frombuffer(raw, "<i8", 2).tolist()
        lengths = np.frombuffer(raw, "<i8", 2 * depth, 16).tolist()
        at = 16 + 16 * depth

        def take(k: int, kind: str = "<i4") -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, k, at)
            at += found.nbytes
            return found.astype(np.int64)

        sizes = take(n, "<i8")
        weight = [take(k, "<i8") for k in lengths[depth:]]
        start = [np.append(0, np.cumsum(take(k - 1))) for k in lengths[:depth]]
        label, target = ([take(k) for k in lengths[depth:]] for _ in range(2))
        ends = at + np.cumsum(sizes)
        symbols = [raw[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]
        return cls(symbols, start, label, weight, target)


def from_ranked(ordered: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> CountAutomaton:
    """From different rows in ascending order of places in ``ordered``, of which only the used words are kept."""
    used = np.zeros(len(ordered), bool)
    for c in columns:
        used[c] = True
    kept = np.flatnonzero(used)
    label = np.cumsum(used) - 1
    return CountAutomaton.from_sorted([ordered[i] for i in kept.tolist()], [label[c] for c in columns], weights)


def from_rows(words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> CountAutomaton:
    """From different rows in any order; ``words`` may be in any order and hold unused words."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ranked = [rank[c] for c in columns]
    by = np.lexsort(ranked[::-1])
    return from_ranked([words[i] for i in order], [c[by] for c in ranked], weights[by])


def union(parts: list[CountAutomaton], least: int = 0) -> CountAutomaton:
    """One automaton whose weights are the sums of the parts'; sums below ``least`` are left out."""
    symbols = sorted(set().union(*[p.symbols for p in parts]))
    place = {w: k for k, w in enumerate(symbols)}
    rows = []
    for p in parts:
        rank = np.array([place[w] for w in p.symbols], np.int64)
        columns, weight = p.rows()
        rows.append(([rank[c] for c in columns], weight))
    columns = [np.concatenate(c) for c in zip(*[r[0] for r in rows])]
    weights = np.concatenate([r[1] for r in rows])
    if len(weights) == 0:
        return parts[0]
    first, inverse, _ = distinct_rows(columns, max(1, len(symbols)))
    total = np.zeros(len(first), np.int64)
    np.add.at(total, inverse, weights)
    keep = total >= least
    first, total = first[keep], total[keep]
    return CountAutomaton.from_sorted(symbols, [c[first] for c in columns], total)


def compose(asked: CountAutomaton, counts: CountAutomaton) -> CountAutomaton:
    """The sequences that both accept, with the weights of ``counts``; both are walked together."""
    place = {w: k for k, w in enumerate(counts.symbols)}
    to = np.array([place.get(w, -1) for w in asked.symbols], np.int64)
    base = len(counts.symbols) + 1
    states = [np.zeros(min(len(a.label[0]), 1), np.int64) for a in (asked, counts)]
    if len(asked.label) != len(counts.label) or not all(map(len, states)):
        none = np.zeros(0, np.int64)
        return CountAutomaton.from_sorted(asked.symbols, [none] * len(asked.label), none)
    columns: list[np.ndarray] = []
    for d in range(len(asked.label)):
        width = asked.start[d][states[0] + 1] - asked.start[d][states[0]]
        arcs = np.repeat(asked.start[d][states[0]] - np.cumsum(width) + width, width) + np.arange(width.sum())
        label = to[asked.label[d][arcs]]
        # States follow each other and their arcs go up by label: (state, label) is one sorted key.
        key = np.repeat(np.arange(len(counts.start[d]) - 1), np.diff(counts.start[d])) * base + counts.label[d]
        want = np.repeat(states[1], width) * base + label
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = (label >= 0) & (key[at] == want)
        columns = [np.repeat(c, width)[hit] for c in columns] + [asked.label[d][arcs][hit]]
        weight = counts.weight[d][at[hit]]
        states = [asked.target[d][arcs][hit], counts.target[d][at[hit]]]
        if not len(weight):
            none = np.zeros(0, np.int64)
            return CountAutomaton.from_sorted(asked.symbols, [none] * len(asked.label), none)
    return CountAutomaton.from_sorted(asked.symbols, columns, weight)
