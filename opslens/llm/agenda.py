"""Merging of adjacent symbols by rank: the agenda of merge-type vocabularies, over many units at once.

While some two neighbours of a unit form a pair of the table, the pair of the least rank is merged, the
leftmost of equals first.  Units of equal length share a matrix of pair ranks whose row minimum is
the next merge of its unit; units beyond ``LONG`` symbols have a heap each.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Most symbols of a unit that is merged in a matrix; longer ones have their own heap.
LONG = 48
#: Symbols of one matrix.
MATRIX = 1 << 20
_NEVER = np.int32(2**31 - 1)


class PairTable:
    """Merged symbol and rank of each pair of symbols, by open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left)).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.merged, self.rank = np.full(size, -1, np.int32), np.full(size, _NEVER, np.int32)
        code = left.astype(np.int64) << 32 | right
        spot = self._spot(code)
        todo = np.arange(len(code))
        while len(todo):
            free = todo[self.keys[spot[todo]] == -1]
            self.keys[spot[free]] = code[free]
            won = self.keys[spot[todo]] == code[todo]
            done = todo[won]
            self.merged[spot[done]], self.rank[spot[done]] = merged[done], rank[done]
            todo = todo[~won]
            spot[todo] = (spot[todo] + 1) & (size - 1)

    def _spot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (code ^ (code >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and ranks; ``_NEVER`` where the pair forms no piece."""
        code = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        spot = self._spot(code)
        held = self.keys[spot]
        on = np.flatnonzero((held != code) & (held != -1))
        while len(on):
            spot[on] = (spot[on] + 1) & (len(self.keys) - 1)
            held = self.keys[spot[on]]
            on = on[(held != code[on]) & (held != -1)]
        hit = self.keys[spot] == code
        return np.where(hit, self.merged[spot], -1), np.where(hit, self.rank[spot], _NEVER)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merge units of these sizes in place; true where a symbol is left."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        alive = np.ones(len(symbols), bool)
        for row in np.flatnonzero(sizes > LONG).tolist():
            self._heap(symbols, alive, int(starts[row]), int(starts[row + 1]))
        for width in np.unique(sizes[(sizes > 1) & (sizes <= LONG)]):
            rows = np.flatnonzero(sizes == width)
            step = max(1, MATRIX // int(width))
            for low in range(0, len(rows), step):
                self._matrix(symbols, alive, starts[rows[low : low + step]], int(width))
        return alive

    def _matrix(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, width: int) -> None:
        """Merge units of ``width`` characters: each round takes every unit's best pair."""
        base = starts[:, None] + np.arange(width)
        table = symbols[base]
        merged, rank = self.find(table[:, :-1].ravel(), table[:, 1:].ravel())
        # flat cells; the last cell of a row never has a pair
        rank = np.concatenate([rank.reshape(-1, width - 1), np.full((len(table), 1), _NEVER)], 1)
        merged = np.concatenate([merged.reshape(-1, width - 1), np.full((len(table), 1), -1, merged.dtype)], 1).ravel()
        table = table.ravel()
        after = np.tile(np.arange(1, width + 1), len(starts))  # next live column; width: none
        before = np.tile(np.arange(-1, width - 1), len(starts))
        live = np.ones(len(table), bool)
        rows = np.arange(len(starts))
        while len(rows):
            best = rank[rows].argmin(1)
            going = rank[rows, best] != _NEVER
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            line = rows * width
            here = line + best
            gone_column = after[here]
            gone = line + gone_column
            table[here] = merged[here]
            live[gone] = False
            flat = rank.reshape(-1)
            flat[gone] = _NEVER
            next_column = after[gone]
            after[here] = next_column
            inner = next_column < width
            before[(line + next_column)[inner]] = best[inner]
            flat[here] = _NEVER
            self._renew(table, merged, flat, here[inner], (line + next_column)[inner])
            last = before[here]
            inner = last >= 0
            self._renew(table, merged, flat, (line + last)[inner], here[inner])
        symbols[base.ravel()] = table
        alive[base.ravel()] = live

    def _renew(self, table, merged, rank, left: np.ndarray, right: np.ndarray) -> None:
        merged[left], rank[left] = self.find(table[left], table[right])

    def _heap(self, symbols: np.ndarray, alive: np.ndarray, low: int, high: int) -> None:
        """Merge one run with a heap of (rank, place, left, right, merged); stale entries are passed over."""
        line = symbols[low:high].tolist()
        n = len(line)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        merged, rank = self.find(symbols[low : high - 1], symbols[low + 1 : high])
        agenda = [
            (r, i, line[i], line[i + 1], m)
            for i, (m, r) in enumerate(zip(merged.tolist(), rank.tolist()))
            if r != _NEVER
        ]
        heapq.heapify(agenda)
        found: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int) -> None:
            j = after[i]
            if j >= n:
                return
            pair = (line[i], line[j])
            if pair not in found:
                m, r = self.find(np.array(pair[:1]), np.array(pair[1:]))
                found[pair] = int(m[0]), int(r[0])
            m, r = found[pair]
            if r != _NEVER:
                heapq.heappush(agenda, (r, i, *pair, m))

        while agenda:
            _, i, left, right, m = heapq.heappop(agenda)
            j = after[i]
            if not live[i] or j >= n or line[i] != left or line[j] != right:
                continue
            line[i], live[j], after[i] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        symbols[low:high] = line
        alive[low:high] = live
