"""Arrays of words for whole Arrow batches.

A text is a run of UTF-8 bytes; a word is a maximal run of bytes other than
the six ASCII separators.  Everything here works on all texts of a chunk at
once with numpy, so that a task spends no Python time on single words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer single text is its own chunk.
CHUNK_BYTES = 4 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the record batches with at most ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a chunk: byte ranges, the first word of each text, and ids in a dictionary of the chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _IS_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: word numbers at which each text begins, with the total at the end
        self.first = np.searchsorted(self.starts, offsets)
        self._inside = inside[:-1]
        self._ids = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def encoded(self) -> pa.DictionaryArray:
        if self._ids is None:
            at = np.zeros(len(self.starts) + 1, np.int32)
            np.cumsum(self.ends - self.starts, out=at[1:])
            body = self.data[self._inside]
            self._ids = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
        return self._ids

    def ids(self) -> np.ndarray:
        return self.encoded().indices.to_numpy(zero_copy_only=False)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        known = self.encoded().dictionary.to_pylist()
        table = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
        return table[self.ids()] if len(known) else np.zeros(0, np.uint64)


    def hash_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word."""
        known = self.encoded().dictionary.to_pylist()
        table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), np.uint64).reshape(-1, 2)
        ids = self.ids()
        return table[ids, 0], table[ids, 1]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    return Words(*text_bytes(texts), lower=lower)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp values, modulo 2**64, of every ``length`` consecutive hashes (none if there are fewer)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value, b = np.zeros(n, np.uint64), np.uint64(base)
    with np.errstate(over="ignore"):
        for k in range(length):
            value *= b
            value += hashes[k : k + n]
    return mix64(value)


def starts_within(first: np.ndarray, length: int) -> np.ndarray:
    """A mask over ``rolling``'s values: those whose words all lie in one text."""
    n = max(int(first[-1]) - length + 1, 0)
    ok = np.zeros(n + 1, np.int32)
    begin = np.minimum(first[:-1], n)
    end = np.maximum(np.minimum(first[1:] - length + 1, n), begin)
    np.add.at(ok, begin, 1)
    np.add.at(ok, end, -1)
    return np.cumsum(ok[:-1]) > 0
