"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

A word goes if a window covers it whose word sequence also starts earlier, in
a smaller document or sooner in the same one.

1. Every task hashes all windows of its texts and gathers them in runs of one
   anchor (``anchors``).  Runs meet by anchor.  Of runs with equal contents,
   the first stays and the windows of all others are repeats.
2. Where an anchor has different contents, the windows of the first run of
   each content are counted one by one, by their hashes.
3. Repeated windows merge into maximal intervals of words, row by row.

Rows of one key arrive sorted and stream through a task.  Windows are told
apart by 128 bits and rows by an identity of their own (``identified``), so
rows without an id, or with one id and different texts, keep their places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SECOND, Prefix, complete, runs_of, thinned
from .shared import identified, written
from .words import chunks, words_of

WINDOW, GRAM = 20, 5
#: What a row that has met its like is: a repeat, or the first run of a content whose anchor has others.
REPEAT, ASK = 0, 1

_ROW = "kind int, key long, c1 long, c2 long, doc long, row long, start int, places int, n int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_MARK = "kind int, doc long, row long, start int, n int"


def _batch(*columns) -> pa.RecordBatch:
    kinds = [np.int32, *[np.int64] * 5, *[np.int32] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False)) for c, t in zip(columns, kinds)], names=_NAMES)


def _mark(kind: int, doc, row, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["kind", "doc", "row", "start", "n"])


def _rows_of(b: pa.RecordBatch):
    """Identity of each text of a chunk, and its words with the prefix hashes of both kinds."""
    w = words_of(b.column(2))
    h1, h2 = w.hash_pairs()
    doc, row = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return doc, row, w, Prefix(h1), Prefix(h2, SECOND)


def _runs(batches):
    for b in chunks(batches, "text"):
        doc, row, w, p, q = _rows_of(b)
        r = runs_of(p, q, w.first, WINDOW, GRAM)
        yield _batch(*thinned(r.anchor, r.c1, r.c2, doc[r.text], row[r.text], r.start - w.first[r.text], r.windows))


def _compare(batches):
    """Sorted rows -> repeats, and the first runs of contents with company at their anchor."""
    for heads, company, later in complete(batches):
        if len(later[0]):
            yield _mark(REPEAT, later[3], later[4], later[5], later[8])
        if company.any():
            _, _, _, doc, row, start, _, _, n = (c[company] for c in heads)
            yield _mark(ASK, doc, row, start, n)


def _windows(batches):
    """Rows of texts with the runs asked for -> the hash of each window of those runs, once a chunk."""
    for b in chunks(batches, "text"):
        asked = b.column(3)
        counts = np.where(asked.is_valid().to_numpy(zero_copy_only=False), np.diff(asked.offsets.to_numpy()), 0) if len(asked) else np.zeros(0, int)
        if not counts.any():
            continue
        b, counts = b.filter(pa.array(counts > 0)), counts[counts > 0]
        flat = b.column(3).flatten()
        start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        text = np.repeat(np.arange(b.num_rows), counts)
        doc, row, w, p, q = _rows_of(b)
        at = np.repeat(start + w.first[text], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        text = np.repeat(text, n)
        k1, k2 = (x.of(at, WINDOW).view(np.int64) for x in (p, q))
        yield _batch(*thinned(k1, k2, np.zeros(len(k1), np.int64), doc[text], row[text], at - w.first[text], np.ones(len(k1), np.int64)))


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "c1", "c2", F.col("row") >= 0, "doc", "row", "start").mapInArrow(_compare, _MARK)


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, row, spans``: for each row of ``docs`` (as ``identified``) with repeats, its runs of repeated windows (start, n); and the table it reads."""
    plain = docs.select("doc", "row", "text")
    marks = written(_met(plain.mapInArrow(_runs, _ROW)), "runs")
    spans = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("start", "n")))
    asked = marks.filter(f"kind = {ASK}").groupBy("doc", "row").agg(spans(ASK).alias("asked"))
    counted = _met(plain.join(asked, ["doc", "row"]).select("doc", "row", "text", "asked").mapInArrow(_windows, _ROW))
    return marks.unionByName(counted).filter(f"kind = {REPEAT}").groupBy("doc", "row").agg(spans(REPEAT).alias("spans")), marks


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` for every row, and with ``with_text`` the kept text.

    ``removed``: maximal removed intervals of words, "start:end" joined by
    commas.  Ids are whole numbers.  Null and wordless texts have no windows;
    texts of fewer than 20 words lose nothing.  Rows are ordered by id, null
    ids last, and rows of one id or of none by a hash of their text; rows that
    share both id and text are one document and don't remove one another.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = identified(docs, id_col, text_col)
    spans, _ = repeated_windows(plain)
    rows = plain.join(spans, ["doc", "row"], "left").select("id", "text", "spans")

    def run(batches):
        for b in chunks(batches, "text"):
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone, removed = np.zeros(len(words) + 1, np.int64), ""
                if spans:
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + WINDOW - 1] -= 1
                    gone = np.cumsum(gone) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(np.int8)))
                    removed = ",".join(f"{x}:{y}" for x, y in zip(edge[::2], edge[1::2]))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                else:
                    kept = b" ".join(words)
                out.append((len(words), int((gone > 0).sum()), hashlib.sha256(kept).hexdigest(), removed, kept.decode("utf-8", "surrogatepass") if with_text else None))
            cols = list(zip(*out))
            kinds = [pa.int64()] * 2 + [pa.string()] * 3
            arrays = [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_text else 5], names=["id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"][: 6 if with_text else 5])

    out = rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, removed string" + (", kept_text string" if with_text else ""))
    return out.withColumnRenamed("id", id_col)
