"""A run-length index of a batch of strings: run-compressed Burrows-Wheeler transform with sampled run ends.

The transform is kept as runs of equal letters.  At the first and the last row
of each run the index samples the text position of the row and of its
neighbour outside the run, with the length of their common prefix.  Between
two samples nothing changes: if the rows of positions i - 1 and i lie next to
rows with equal letters, the neighbour of i is the successor of that of i - 1
and their common prefix is shorter by one.  So matching statistics stream over
the text from the samples alone.

Where only matches of some length and more are asked for, the transform has
rows only for positions at which one can begin.  A position before such a one
in its string is one as well, so the successors that the samples rely on are
there; a neighbour that has none ends right after that length, and what streams
on from it is shorter than what is asked for, as is the truth.
"""

from __future__ import annotations

import numpy as np


class RunLengthIndex:
    """Of strings: their bytes one after the other, the offsets of each, and how often each occurs (once by default).

    A string that occurs several times is one entry: its other places agree
    with it to its end.  ``least``: the length from which on matches count.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, count: np.ndarray | None = None, least: int = 1):
        self.n = n = len(data)
        self.count = np.ones(len(offsets) - 1, np.int64) if count is None else count
        lengths = np.diff(offsets)
        self.string = np.repeat(np.arange(len(lengths)), lengths)
        #: bytes from each position to the end of its string
        self.rest = np.repeat(offsets[1:], lengths) - np.arange(n)
        #: positions that have a row
        self.open = self.rest >= least
        self.packed = self._pack(data)
        order = self._sorted(np.arange(n) - np.repeat(offsets[:-1], lengths), np.repeat(lengths - least + 1, lengths))
        before = np.empty(n, np.int32)
        before[1:] = data[:-1]
        first = offsets[:-1][lengths > 0]
        before[first] = 256 + np.arange(len(first))  # a string's first position follows nothing that others share
        letters = before[order]
        change = np.flatnonzero(letters[1:] != letters[:-1]) + 1 if len(order) else np.zeros(0, np.int64)
        self.heads = np.concatenate([[0], change]) if len(order) else change
        self.letters = letters[self.heads]
        tails = np.concatenate([change - 1, [len(order) - 1]]) if len(order) else change
        self.up = self._sampled(order, self.heads, -1)
        self.down = self._sampled(order, tails, 1)

    @staticmethod
    def _pack(data: np.ndarray) -> np.ndarray:
        """Eight bytes from each position as one number, the first byte highest."""
        wide = np.zeros(len(data) + 8, np.uint64)
        wide[: len(data)] = data
        out = np.zeros(len(data), np.uint64)
        for k in range(8):
            out <<= np.uint64(8)
            out |= wide[k : k + len(data)]
        return out

    def _sorted(self, off: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Open positions in the order of the suffixes of their strings, by prefix doubling; equal suffixes by position.

        ``off``: where each position lies in its string, whose first ``wide``
        are open.  Ranks by a prefix are needed at open positions, and at whole
        steps of that length behind them.
        """
        n, rest = self.n, self.rest
        short = np.minimum(rest, 7).astype(np.uint64)
        keep = (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (np.uint64(8) - short)))
        keep[short == 0] = 0
        key = (self.packed & keep & np.uint64(0xFFFFFFFFFFFFFF00)) | short
        at = np.argsort(key)
        key = key[at]
        rank = np.empty(n, np.int64)
        base = np.zeros(n, np.int64)
        k, size = 7, max(1, int(2 * n).bit_length())
        while len(at):
            # rows at[...] are in order; those with equal keys share the rank of the first
            index = np.arange(len(at))
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.maximum.accumulate(np.where(new, index, 0))
            rank[at] = base + begin
            last = np.append(new[1:], True)
            tied = ~(new & last)
            at = at[tied]
            at = at[off[at] % (2 * k) < wide[at]]
            if not len(at):
                break
            tail = np.where(rest[at] > k, rank[np.minimum(at + k, n - 1)] + n, at)
            key = rank[at] << size | tail
            order = np.argsort(key)
            at, key = at[order], key[order]
            group = key >> size
            fresh = np.ones(len(at), bool)
            fresh[1:] = group[1:] != group[:-1]
            base = group - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            k *= 2
        order, rows = np.full(n, -1), np.flatnonzero(self.open)
        order[rank[rows]] = rows
        return order[order >= 0]

    def _sampled(self, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at ``rows``, in text order, with the common prefix of each and its neighbour row."""
        there = (rows + step >= 0) & (rows + step < len(order))
        length = np.zeros(len(rows), np.int64)
        length[there] = self._common(order[rows[there]], order[rows[there] + step])
        out = np.full(self.n, -1)
        out[order[rows]] = length
        at = np.flatnonzero(out >= 0)
        return at, out[at]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.rest[a], self.rest[b])
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x = self.packed[a[live] + out[live]] ^ self.packed[b[live] + out[live]]
            same = np.full(len(live), 8)
            for k in range(7, -1, -1):
                same[(x >> np.uint64(8 * (7 - k))) & np.uint64(0xFF) != 0] = k
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching(self) -> np.ndarray:
        """At each position, the longest prefix of the rest of its string that also begins at another position, if of ``least`` bytes; else less than these."""
        i, best = np.flatnonzero(self.open), np.zeros(self.n, np.int64)
        for at, length in (self.up, self.down):
            if len(at):
                # a sample holds until the next one; each string's first position is one
                ends = np.zeros(self.n, np.int64)
                ends[at] = np.diff(at + length, prepend=0)
                best[i] = np.maximum(best[i], np.cumsum(ends)[i] - i)
        return np.where(self.open & (self.count[self.string] > 1), self.rest, best)
