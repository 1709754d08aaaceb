"""Packing token sequences: vector bin packing by the dot-product heuristic.

A bin (a training sequence) has three limits at once: tokens, segments and
loss-bearing tokens.  A document longer than a bin fills whole bins; its rest
joins a pool.  From the pool a bin takes, again and again, the piece with the
largest dot product of what it needs and what the bin has left, each weighted
by the pool's mean demand.  Once nothing fits, a piece is cut to fill the gap,
so that bins end full.  The last bins of a pool are cut to powers of two, which
need no padding.

Packing needs no shuffle: each task packs what it reads.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 32, 1024
#: Pieces that wait in a task to be packed together.
POOL = 512
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"


# Fixed value: how a byte-level vocabulary cuts texts before it merges.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in a row that the fast encoder's expressions still take, with room to spare.
LONG_SPACE = 50_000


@functools.lru_cache(2)
def tokenizer(path: str):
    """An encoder, text -> uint32 ids, of a ``tokenizers`` JSON file, added tokens recognised as that library does by default.

    A byte-level file's tokens are read into the ranks of ``tiktoken``, which
    gives the same ids several times faster (tests compare both).  Texts with
    very long white space, which its expressions can't take, and files of any
    other kind are left to the library itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    plain = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or ()
    simple = all(not t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or made.get("normalizer") or not simple:
        return plain
    special = {t["content"]: t["id"] for t in added}
    back = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)
    long_space = re.compile(r"\s{%d}" % LONG_SPACE)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and long_space.search(text):
            return plain(text)
        return enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    return encode


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Packer:
    """Bins for the pieces of one task. A piece: (document, start, ids, first id that bears loss)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_id: int):
        self.limits = np.array([max_tokens, max_segments, max_loss])
        self.pool: list[tuple] = []
        self.next_id, self.out = first_id, []

    def loss(self, start: int, length: int, loss_from: int) -> int:
        """A piece's first id has nothing before it to be predicted from, and ids before ``loss_from`` bear no loss."""
        return max(0, start + length - max(start + 1, loss_from))

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        tokens, _, most = self.limits
        at = 0
        while len(ids) - at >= tokens and self.loss(at, tokens, loss_from) <= most:
            self.emit([(doc, at, ids[at : at + tokens], loss_from, len(ids))])
            at += tokens
        while at < len(ids):
            n = min(len(ids) - at, tokens)
            n -= max(0, self.loss(at, n, loss_from) - most)
            self.pool.append((doc, at, ids[at : at + n], loss_from, len(ids)))
            at += n
        if len(self.pool) >= POOL:
            self.pack(POOL // 4)

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, _, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def fill(self, limits: np.ndarray, needs: np.ndarray, alive: np.ndarray, weight: np.ndarray) -> list[tuple]:
        """One bin: pieces chosen by dot product, then one cut to the gap."""
        left, chosen = limits.copy(), []
        while True:
            fits = alive & (needs <= left).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, needs @ (weight * left), -1.0)
            k = int(score.argmax())
            alive[k] = False
            chosen.append(self.pool[k])
            left -= needs[k]
        rest = np.flatnonzero(alive)
        if left[0] > 0 and left[1] > 0 and left[2] >= 0 and len(rest):
            k = int(rest[needs[rest, 0].argmax()])
            doc, start, ids, loss_from, total = self.pool[k]
            n = int(min(left[0], len(ids)))
            n -= max(0, self.loss(start, n, loss_from) - int(left[2]))
            if n > 0:
                chosen.append((doc, start, ids[:n], loss_from, total))
                self.pool[k] = (doc, start + n, ids[n:], loss_from, total)
                needs[k] = len(ids) - n, 1, self.loss(start + n, len(ids) - n, loss_from)
                alive[k] = len(ids) > n
        return self.trim(chosen, needs, alive)

    def trim(self, chosen: list[tuple], needs: np.ndarray, alive: np.ndarray) -> list[tuple]:
        """A bin that another limit has closed early is cut to a power of two; the cut part waits again."""
        over = sum(len(p[2]) for p in chosen)
        over -= 1 << (over.bit_length() - 1) if over < self.limits[0] else over
        free = [int(k) for k in np.flatnonzero(~alive)]
        while over > 0:
            doc, start, ids, loss_from, total = chosen.pop()
            n = max(len(ids) - over, 0)
            over -= len(ids) - n
            k = free.pop()
            self.pool[k] = (doc, start + n, ids[n:], loss_from, total)
            needs[k] = len(ids) - n, 1, self.loss(start + n, len(ids) - n, loss_from)
            alive[k] = True
            if n:
                chosen.append((doc, start, ids[:n], loss_from, total))
        return chosen

    def pack(self, keep: int) -> None:
        """Pack until at most ``keep`` pieces wait; with 0, all of them."""
        needs = np.array([(len(p[2]), 1, self.loss(p[1], len(p[2]), p[3])) for p in self.pool], np.int64).reshape(-1, 3)
        alive = np.ones(len(self.pool), bool)
        weight = needs.mean(axis=0) / self.limits.astype(float) ** 2 if len(needs) else None
        while (n := int(alive.sum())) > keep:
            tokens = int(needs[alive, 0].sum())
            limits = self.limits
            if not keep and tokens < limits[0]:
                limits = np.array([1 << (tokens.bit_length() - 1), *limits[1:]])
            got = self.fill(limits, needs, alive, weight)
            self.emit(got)
            if len(got) == 0 and n == int(alive.sum()):
                raise RuntimeError("a piece fits no bin")
        self.pool = [p for p, ok in zip(self.pool, alive) if ok]


def pack_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are its text's and one end id; a null or empty text has
    the end id alone, so every row has a piece.  ``loss_from_col`` names a
    column with the first id that bears loss (null or unset: 0), as of the
    answer in instruction data.  Rows with equal or null ids are packed one by
    one.  Other columns are not read; an empty table gives an empty result.
    ``vocabulary``: path of a byte-level JSON vocabulary, by default the
    installed ``byte_bpe_50k.json``.
    """

    def run(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        encode = tokenizer(str(path))
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 33)

        def rows():
            cols = list(zip(*packer.out)) or [()] * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text, loss_from in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END_ID))
                packer.add(doc, ids, loss_from)
                if len(packer.out) >= 10_000:
                    yield rows()
        packer.pack(0)
        yield rows()

    kind = docs.schema[id_col].dataType.simpleString()
    loss_from = F.coalesce(F.col(loss_from_col).cast("long"), F.lit(0)) if loss_from_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col), F.col(text_col), loss_from.alias("_loss_from")).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
