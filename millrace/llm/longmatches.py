"""Suffix-array dedup with a run-length index: bytes covered by 200-byte strings that occur elsewhere.

1. Every task finds the runs of all 200-byte windows of its texts (``anchors``)
   and sends each, with hashes of its bytes, to its anchor.  A run whose anchor
   occurs nowhere else holds no match and goes no further.
2. One string of each other content goes on, cut into pieces of a few windows.
   Pieces of equal inner bytes meet; a task builds a run-length index
   (``rindex``) over the strings of its groups, one entry per string with the
   number of its places, streams matching statistics over them and marks
   matches of 200 bytes and more.  Equal windows lie in pieces of equal inner
   bytes, so no match is missed and a text is never held against itself.
3. A group too large for an index is cut into narrower pieces, which share more
   bytes, and those into single windows, which only equal strings share.
4. Matches of a content hold at all its places; they merge into maximal byte
   intervals, row by row.

Rows have an identity of their own (``identified``), so rows without an id, or
with one id and different texts, keep their places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SECOND, Prefix, changes, complete, runs_of, spread, thinned
from .rindex import RunLengthIndex
from .shared import drop_written, identified, join_by_key, written
from .words import chunks, mix64, text_bytes

WINDOW, GRAM = 200, 32
#: Windows of a piece, from level to level.
PIECES = (43, 8, 1)
#: Bytes of an index, of one group in it, and strings of one group in a chunk of text from which on it is known to be too large.
INDEX_BYTES, GROUP_BYTES, CROWD = 1 << 18, 1 << 18, 4
#: Bytes of text hashed at once.
CHUNK = 1 << 20

_ROW = "kind int, key long, c1 long, c2 long, doc long, row long, start int, places int, shape int"
_MARK = "entry boolean, c1 long, c2 long, doc long, row long, start int, places int, shape int"
_PIECE = "key long, key2 long, crowded boolean, c1 long, c2 long, doc long, row long, start int, places int, shape int, off int, body binary"
_FOUND = "over boolean, c1 long, c2 long, doc long, row long, start int, places int, shape int, off int, n int"
_rng = np.random.default_rng(5)
_LETTER, _LETTER2 = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def _kinds(schema: str) -> tuple[list[str], list[type]]:
    types = {"int": np.int32, "long": np.int64, "boolean": bool}
    parts = [x.split() for x in schema.split(", ")]
    return [p[0] for p in parts if p[1] in types], [types[p[1]] for p in parts if p[1] in types]


def _batch(schema: str, *columns, body=None) -> pa.RecordBatch:
    """Columns (numbers stand for whole columns) as a batch; ``body``: the last one, if it holds bytes."""
    names, kinds = _kinds(schema)
    size = next(len(c) for c in columns if not np.isscalar(c))
    arrays = [pa.array(np.full(size, c, t) if np.isscalar(c) else c.astype(t, copy=False)) for c, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays + ([body] if body is not None else []), names=names + (["body"] if body is not None else []))


def _runs(batches):
    for b in chunks(batches, "text", CHUNK):
        data, offsets = text_bytes(b.column(2))
        r = runs_of(Prefix(_LETTER[data]), Prefix(_LETTER2[data], SECOND), offsets, WINDOW, GRAM)
        doc, row = (b.column(k).to_numpy(zero_copy_only=False)[r.text] for k in (0, 1))
        yield _batch(_ROW, *thinned(r.anchor, r.c1, r.c2, doc, row, r.start - offsets[r.text], r.windows + 1024 * r.gap))


def _compare(batches):
    """Sorted runs -> the places of all contents with company or several places; of each content one is the entry of an index."""
    for heads, company, later in complete(batches):
        _, c1, c2, doc, row, start, places, _, shape = heads
        k = np.flatnonzero(company | (places > 1))
        if len(k):
            yield _batch(_MARK, True, *(x[k] for x in (c1, c2, doc, row, start, places, shape)))
        _, c1, c2, doc, row, start, places, _, shape = later
        if len(c1):
            yield _batch(_MARK, False, c1, c2, doc, row, start, places, shape)


def _pieces(width: int):
    """Rows of texts with the entries asked for -> strings of their pieces of ``width`` windows, dealt by the bytes that all windows of such a piece share."""

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            asked = b.column(3)
            counts = np.diff(asked.offsets.to_numpy()) if len(asked) else np.zeros(0, int)
            if not counts.any():
                continue
            flat = asked.flatten()
            c1, c2, start, places, shape, off = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6))
            text = np.repeat(np.arange(b.num_rows), counts)
            doc, row = (b.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            # a place once, with the most places that are known of its content
            order = np.lexsort((-places, start, row, doc))
            k = order[changes([x[order] for x in (doc, row, start)])]
            text, doc, row, c1, c2, start, places, shape, off = (x[k] for x in (text, doc, row, c1, c2, start, places, shape, off))
            n, gap = shape % 1024, shape // 1024
            data, offsets = text_bytes(b.column(2))
            p, q = Prefix(_LETTER[data]), Prefix(_LETTER2[data], SECOND)
            # windows by their distance to the anchor, in steps of the width
            top, bottom = gap // width, (gap - n + 1) // width
            parts = top - bottom + 1
            e = np.repeat(np.arange(len(n)), parts)
            j = top[e] - (np.arange(len(e)) - np.repeat(np.cumsum(parts) - parts, parts))
            high, low = np.minimum(gap[e], j * width + width - 1), np.maximum(gap[e] - n[e] + 1, j * width)
            skip, count = gap[e] - high, high - low + 1
            at = offsets[text[e]] + start[e]
            inner = at + gap[e] - j * width
            mark = mix64(j.view(np.uint64) + np.uint64(width << 32))
            k1, k2 = ((x.of(inner, WINDOW - width + 1) ^ mark).view(np.int64) for x in (p, q))
            raw, begin, size = data.tobytes(), at + skip, count + WINDOW - 1
            more = (c1[e], c2[e], doc[e], row[e], start[e] + skip, places[e], count + 1024 * (gap[e] - skip), off[e] + skip)
            # of a group that is large within the chunk one string goes to its task and says so, the others to narrower pieces;
            # of a single window the others are known to match
            by = np.lexsort((k2, k1))
            new = changes([k1[by], k2[by]])
            head = np.flatnonzero(new)
            size_of = np.diff(np.append(head, len(by)))
            crowded, over = np.zeros(len(by), bool), np.zeros(len(by), bool)
            crowded[by] = np.repeat(size_of >= (CROWD if width > 1 else 2), size_of)
            over[by] = crowded[by] & ~new
            stay = np.flatnonzero(~over)
            body = pa.array([raw[x : x + y] for x, y in zip(begin[stay].tolist(), size[stay].tolist())], pa.binary())
            yield _batch(_PIECE, k1[stay], k2[stay], crowded[stay], *(x[stay] for x in more), body=body)
            k = np.flatnonzero(over)
            if len(k):
                yield _batch(_PIECE, spread(*(x[k] for x in more[2:5])), 0, True, *(x[k] for x in more), body=pa.nulls(len(k), pa.binary()))

    return run


def _indexed(rows: list[tuple], body: list[bytes]):
    """Matches in the strings of whole groups, as columns ``c1, c2, doc, row, start, places, shape, off, n``; equal strings are one entry with their places."""
    codes = pa.array(body, pa.binary()).dictionary_encode()
    strings, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    doc, row, start, places = columns[2:6]
    order = np.argsort(of, kind="stable")
    head = np.flatnonzero(np.diff(np.concatenate([[-1], of[order]])))
    lead = order[head][of]  # the first row of each row's string
    other = (doc != doc[lead]) | (row != row[lead]) | (start != start[lead])
    count = np.ones(len(strings), np.int64)
    np.maximum.at(count, of, np.where(other, 2, np.minimum(places, 2)))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
    index = RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), offsets, count, WINDOW)
    at = np.flatnonzero(index.matching() >= WINDOW)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (index.string[at[1:]] != index.string[at[:-1]])
    begin = np.flatnonzero(new)
    string, first, n = index.string[at[begin]], at[begin] - offsets[index.string[at[begin]]], np.diff(np.append(begin, len(at)))
    # every row of a string has its matches
    size = np.diff(np.append(head, len(of)))[string]
    k = np.repeat(np.arange(len(string)), size)
    r = order[head[string[k]] + (np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size))]
    out = [c[r] for c in columns]
    return [*out[:7], out[7] + first[k], n[k]]


def _match(width: int):
    def run(batches):
        """Sorted pieces -> matches, and the pieces of groups too large for an index (``over``)."""
        rows, body, size, key, group, group_size, over, seen = [], [], 0, None, 0, 0, False, set()
        for b in batches:
            # most strings have no company: they go here unless the batch's edge hides it
            k1, k2, flagged, places = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 8))
            new = changes([k1, k2])
            new[:1] = key is None or [(x, y) != key for x, y in zip(k1[:1].tolist(), k2[:1].tolist())]
            b = b.filter(pa.array(~(new & np.append(new[1:], False) & ~flagged & (places == 1))))
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            crowded, bodies, again = b.column(2).to_pylist(), b.column(11).to_pylist(), []
            for k, row in enumerate(zip(*(b.column(k).to_pylist() for k in range(3, 11)))):
                if keys[k] != key:
                    if len(rows) - group == 1 and rows[-1][5] == 1:  # a string without company
                        rows.pop()
                        size -= len(body.pop())
                    if size >= INDEX_BYTES:
                        if found := _indexed(rows, body):
                            yield _batch(_FOUND, False, *found)
                        rows, body, size = [], [], 0
                    key, over, group, group_size, seen = keys[k], crowded[k], len(rows), 0, set()
                if not over and group_size >= GROUP_BYTES:
                    over = True
                    again += rows[group:]
                    size -= group_size
                    del rows[group:], body[group:]
                if over:
                    again.append(row)
                elif row[2:5] not in seen:  # the same place again comes from a repeated row
                    seen.add(row[2:5])
                    rows.append(row)
                    body.append(bodies[k])
                    group_size += len(bodies[k])
                    size += len(bodies[k])
            if again:  # of single windows a group is one string: an entry of many places
                yield _batch(_FOUND, width > 1, *(np.array(c, np.int64) for c in zip(*again)), 1)
        if rows and (found := _indexed(rows, body)):
            yield _batch(_FOUND, False, *found)

    return run


def matches(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``c1, c2, places, m``: for each content with matches, the windows of it that match (off, n), by one index after the other."""
    entries, parts = marks.filter("entry").withColumn("off", F.lit(0)), []
    for width in PIECES:
        asked = entries.groupBy("doc", "row").agg(F.collect_set(F.struct("c1", "c2", "start", "places", "shape", "off")).alias("asked"))
        pieces = docs.join(asked, ["doc", "row"]).select("doc", "row", "text", "asked").mapInArrow(_pieces(width), _PIECE)
        pieces = pieces.repartition("key").sortWithinPartitions("key", "key2", F.desc("crowded"))
        found = written(pieces.mapInArrow(_match(width), _FOUND), f"matches-{width}")
        parts.append(found.filter("not over"))
        entries = found.filter("over")
        if width == PIECES[-1] or not entries.head(1):
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = written(out.groupBy("c1", "c2").agg(F.max("places").alias("places"), F.collect_set(F.struct("off", "n")).alias("m")), "matches")
    drop_written(*parts)
    return out


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc, row, spans``: for each row of ``docs`` (as ``identified``) with matches, its runs (start) with the windows of theirs that match (off, n)."""
    plain = docs.select("doc", "row", "text")
    runs = plain.mapInArrow(_runs, _ROW).repartition("key").sortWithinPartitions("key", "c1", "c2", F.col("row") >= 0, "doc", "row", "start")
    marks = written(runs.mapInArrow(_compare, _MARK), "byte-runs")
    found = join_by_key(marks.select("c1", "c2", "doc", "row", "start"), matches(plain, marks), ["c1", "c2"], "places")
    return found.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "m")).alias("spans"))


def long_match_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` for every row, and with ``with_bytes`` the kept bytes.

    ``removed``: maximal removed byte intervals, "start:end" joined by commas.
    Ids are whole numbers.  Null and empty texts have no bytes; texts under 200
    bytes lose nothing.  Rows that share both id - or have none - and text are
    one document and don't remove one another; rows of one id and different
    texts are different documents.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = identified(docs, id_col, text_col)
    rows = plain.join(repeated_windows(plain), ["doc", "row"], "left").select("id", "text", "spans")

    def run(batches):
        for b in chunks(batches, "text"):
            data, offsets = text_bytes(b.column(1))
            spans = b.column(2)
            n = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
            flat = spans.flatten()
            inner = flat.field(1)
            each = np.diff(inner.offsets.to_numpy()) if len(flat) else np.zeros(0, np.int64)
            start = np.repeat(flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), each)
            inner = inner.flatten()
            off, count = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            row = np.repeat(np.repeat(np.arange(b.num_rows), n), each)
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, offsets[row] + start + off, 1)
            np.add.at(step, offsets[row] + start + off + count + WINDOW - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for k in range(b.num_rows):
                own, cut = data[offsets[k] : offsets[k + 1]], gone[offsets[k] : offsets[k + 1]]
                kept = own[~cut].tobytes() if n[k] else own.tobytes()
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))) if n[k] else np.zeros(0, int)
                out.append((len(own), int(cut.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), ",".join(f"{x}:{y}" for x, y in zip(edge[::2], edge[1::2])), kept if with_bytes else None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()]
            width = 6 if with_bytes else 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)][:width]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_bytes"][: width + 1])

    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string" + (", kept_bytes binary" if with_bytes else ""))
    return out.withColumnRenamed("id", id_col)
