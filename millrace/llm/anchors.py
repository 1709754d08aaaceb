"""Where equal windows of a long sequence can lie, from a small share of its places.

Windows of ``window`` units that are equal have the same least gram hash at the
same place inside them, so each window is known by its *anchor*: the place of
its (leftmost) least gram.  Consecutive windows with one anchor form a *run*.
Equal windows always lie in runs of equal anchors; two runs whose whole
contents are equal hold the same windows.  So runs, a few units in a hundred,
stand for all windows, and windows themselves have to be looked at only where
an anchor has runs of different contents.

Contents are told apart by 128 bits.  A chunk of texts sends one row for each
content and, to the task of an anchor, one row only: where it already has
several contents of an anchor, that one row says so and the others are dealt
by content.  So neither a passage that very many documents share nor a short
line in very many surroundings fills a task with more than a row a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mix64

BASE, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Prefix:
    """Rabin-Karp values, modulo 2**64, of any stretch of a sequence of 64-bit hashes."""

    def __init__(self, hashes: np.ndarray, base: int = BASE):
        n = len(hashes)
        power = np.full(n + 1, base, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:-1], out=self.sums[1:])
        power = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        power[:1] = 1
        self.back = np.multiply.accumulate(power)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all_of(self, length: int) -> np.ndarray:
        """Of every stretch of ``length``."""
        n = max(len(self.sums) - length, 0)
        return mix64((self.sums[length:] - self.sums[:n]) * self.back[:n])


@dataclass
class Runs:
    """Runs of a chunk: text number, first window (place in the chunk), windows, units from the first window to the anchor, hashes of anchor and content."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    gap: np.ndarray
    anchor: np.ndarray
    c1: np.ndarray
    c2: np.ndarray


def runs_of(prefix: Prefix, second: Prefix, first: np.ndarray, window: int, gram: int) -> Runs:
    """Runs of all texts of a chunk; ``first`` are the places at which texts begin, with the total at the end.

    Grams are ordered by 32 bits of their hashes and, where these are equal, by
    place; that depends on what is in a window alone, so equal windows agree.
    """
    wide = window - gram + 1
    n = int(first[-1]) - window + 1
    none = np.zeros(0, np.int64)
    empty = Runs(none, none, none, none, none, none, none)
    if n <= 0:
        return empty
    grams = prefix.all_of(gram)
    key = (grams >> np.uint64(32)) << np.uint64(32)
    key |= np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < wide:
        key = np.minimum(key[: len(key) - (wide - size)], key[wide - size :])
    anchor = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + window <= first[text + 1])
    if not len(at):
        return empty
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    c1, c2 = (p.of(start, count + window - 1).view(np.int64) for p in (prefix, second))
    return Runs(text[start], start, count, anchor[start] - start, grams[anchor[start]].view(np.int64), c1, c2)


def spread(*columns: np.ndarray) -> np.ndarray:
    """A hash of some columns, to deal rows that need no company."""
    out = np.uint64(0)
    for c in columns:
        out = mix64(c.astype(np.int64).view(np.uint64) ^ out)
    return out.view(np.int64)


def changes(columns, out: np.ndarray | None = None) -> np.ndarray:
    """Rows that differ from the one before in any column."""
    new = np.zeros(len(columns[0]), bool) if out is None else out
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


#: What a row of a chunk is: for its key's task; the same, and its anchor is known to have several contents; or a later place of a content of the chunk.
COUNT, SEVERAL, LATER = 0, 1, 2


def thinned(key, c1, c2, doc, row, start, *more) -> list[np.ndarray]:
    """Rows of a chunk as they are sent on: ``kind, key, c1, c2, doc, row, start, places, *more``.

    Rows of equal ``(key, c1, c2)`` are places of one content.  The first is
    sent with the number of its places in the chunk; the others are ``LATER``.
    Of a key with several contents one goes to the key's task, flagged, and the
    others are dealt by content.
    """
    columns = [key, c1, c2, doc, row, start, *more]
    by = np.argsort(key, kind="stable")
    k = key[by]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    alone, met = by[~twin], by[twin]
    kind, places = np.full(len(alone), COUNT), np.ones(len(alone), np.int64)
    if not len(met):
        return [kind, *(x[alone] for x in columns[:6]), places, *(x[alone] for x in more)]
    order = met[np.lexsort((start[met], row[met], doc[met], row[met] >= 0, c2[met], c1[met], key[met]))]
    m = [x[order] for x in columns]
    new = changes(m[:3])
    fresh = changes(m[3:6], new.copy())  # the same place twice is a repeated row
    m, new = [x[fresh] for x in m], new[fresh]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(new)))
    key_new = changes([m[0][head]])
    several = (np.diff(np.append(np.flatnonzero(key_new), len(head))) > 1)[np.cumsum(key_new) - 1]
    m_kind, m_places = np.full(len(new), LATER), np.ones(len(new), np.int64)
    m_kind[head], m_places[head] = np.where(several, SEVERAL, COUNT), size
    by_content = np.zeros(len(new), bool)
    by_content[head[several & ~key_new]] = True
    dealt = np.where(by_content, spread(m[1], m[2]), np.where(new, m[0], spread(m[3], m[4], m[5])))
    cat = lambda a, b: np.concatenate([a, b])
    return [cat(kind, m_kind), cat(key[alone], dealt), *(cat(x[alone], y) for x, y in zip(columns[1:6], m[1:6])), cat(places, m_places), *(cat(x[alone], y) for x, y in zip(more, m[6:]))]


class Groups:
    """Rows sorted by ``key, c1, c2`` and place -> contents, once each is complete. Streams: it keeps one row.

    Columns are ``key, c1, c2, doc, row, start, places, flagged, *more``.
    """

    def __init__(self):
        self.row = None  # the first row of the last content, with its number of places so far
        self.before = self.place = None  # whether its key had a content before it, and its last place

    def push(self, columns: list[np.ndarray], last: bool = False):
        """(columns of the first rows of complete contents, which of them have company in their key), and columns of all later places."""
        carried = self.row is not None
        if carried:
            columns = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(self.row, columns)]
        size = len(columns[0])
        if not size:
            return None, None
        new = changes(columns[:3])
        place = columns[3:6]
        same = np.zeros(size, bool)
        same[1:] = ~new[1:] & np.all([c[1:] == c[:-1] for c in place], axis=0)
        if carried and size > 1 and not new[1]:
            same[1] = all(c[1] == x for c, x in zip(place, self.place))
        head = np.flatnonzero(new)
        later = ~new & ~same
        places = np.add.reduceat(np.where(same, 0, columns[6]), head)
        flagged = np.logical_or.reduceat(columns[7].astype(bool), head)
        key = columns[0][head]
        before = np.zeros(len(head), bool)
        before[1:] = key[1:] == key[:-1]
        before[0] = carried and self.before
        after = np.append(before[1:], False)
        heads = [c[head] for c in columns]
        heads[6], heads[7] = places, flagged
        keep = len(head) if last else len(head) - 1
        if last:
            self.row = None
        else:
            self.row, self.before = [c[-1] for c in heads], bool(before[-1])
            self.place = [c[-1] for c in place]
        company = before | after | flagged
        return ([c[:keep] for c in heads], company[:keep]), [c[later] for c in columns]


def complete(batches, more: int = 1):
    """Batches of sorted rows ``kind, key, c1, c2, doc, row, start, places, *more`` -> (complete contents, which have company in their key, later places).

    Contents and places come as their columns ``key, c1, c2, doc, row, start, places, flagged, *more``.
    """
    state = Groups()
    none = [np.zeros(0, np.int64)] * (8 + more)

    def columns_of(b):
        kind, *c = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        return kind, [*c[:7], kind == SEVERAL, *c[7:]]

    for b in batches:
        kind, c = columns_of(b)
        ready = kind == LATER
        if ready.any():
            yield none, np.zeros(0, bool), [x[ready] for x in c]
            c = [x[~ready] for x in c]
        if len(c[0]):
            (heads, company), later = state.push(c)
            yield heads, company, later
    if state.row is not None:
        (heads, company), later = state.push(none, last=True)
        yield heads, company, later
