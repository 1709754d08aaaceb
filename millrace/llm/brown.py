"""Brown class-based n-grams: exchange clustering, class transitions and word emissions.

A text's probability is the product over its tokens of P(class | class before)
and P(word | class), with classes for every word of the training texts:

1. The ``FREQUENT`` most frequent words are clustered at the driver by exchange
   on the counts of their pairs, all other words being one unit.
2. Every other word is moved in Spark to the class that raises the likelihood
   most, given the class counts: each occurrence sends the classes at its
   sides to the word's task.
3. Class transitions are counted over all training texts with these classes.

All counts come from all training texts; what reaches the driver - counts of
pairs of units and of classes - has a size that the parameters bound.  Words
not seen in training have, as one word, the mass and the surroundings of those
seen once (Good-Turing).

A word's count and class are needed wherever it occurs.  Those of the ``HEAD``
most frequent words go to every task; tokens of others are joined, with their
place in the text, so that transitions between them are whole as well.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written
from .words import Words, chunks, text_bytes

FREQUENT, CLASSES, SWEEPS = 1024, 48, 8
#: The class of ends of texts, and the class that words below the most frequent are in before they are placed.
END_CLASS, REST = 0, CLASSES - 1
#: Words whose counts and classes are broadcast, 17 bytes each.
HEAD = 1_000_000
FOLDS, HELD_OUT = 7, 2
#: Added to each class transition; share of independence in the counts by which words are placed.
ALPHA, PRIOR = 0.1, 0.05
END = np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)[0]


def fold(ident) -> int:
    """crc32 of the id as text, modulo ``FOLDS``; a null id is the empty text."""
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % FOLDS


class Tokens:
    """Tokens of a chunk: hashes of its distinct words, and each text's word codes."""

    def __init__(self, texts: pa.Array):
        w = Words(*text_bytes(texts), lower=True)
        known = w.encoded().dictionary.to_pylist()
        self.hash = np.fromiter((xxhash.xxh64_intdigest(x) for x in known), np.uint64, len(known)).view(np.int64)
        self.codes, self.first, self.texts = w.ids().astype(np.int64), w.first, w.texts()

    def around(self, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """What stands before and after each token, by a value ``of`` each distinct word; ``end`` at the ends of texts."""
        v = of[self.codes]
        before, after = np.full(len(v), end, v.dtype), np.full(len(v), end, v.dtype)
        before[1:], after[:-1] = v[:-1], v[1:]
        full = np.diff(self.first) > 0
        before[self.first[:-1][full]] = end
        after[self.first[1:][full] - 1] = end
        return before, after


class Known:
    """Columns of some words by hash."""

    def __init__(self, hashes: np.ndarray, *columns: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.columns = hashes[order], [c[order] for c in columns]

    def find(self, hashes: np.ndarray, *default) -> list[np.ndarray]:
        """Whether each word is known, and its columns (``default`` where it isn't)."""
        if not len(self.hashes) or not len(hashes):
            return [np.zeros(len(hashes), bool), *(np.full(len(hashes), d, c.dtype) for c, d in zip(self.columns, default))]
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[k] == hashes
        return [found, *(np.where(found, c[k], np.array(d, c.dtype)) for c, d in zip(self.columns, default))]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units from the counts of their pairs; unit 0, the end, stays alone in class 0 and the last unit, all other words, in the last class.

    The likelihood of class bigrams is the sum of N log N over class pairs less
    that over left and right totals.  Units start spread by frequency; each
    sweep moves every unit to the class that raises the likelihood most.
    """
    units = len(pairs)
    pairs = pairs.astype(float)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = [int(u) for u in np.argsort(-total, kind="stable") if 0 < u < units - 1 and total[u] > 0]
    cls = np.ones(units, np.int64)
    cls[0], cls[-1] = 0, classes - 1
    for i, u in enumerate(order):
        cls[u] = 1 + i % (classes - 2)
    member = np.zeros((units, classes))
    member[np.arange(units), cls] = 1
    to, by = pairs @ member, (pairs.T @ member)  # unit -> class, class -> unit
    m = member.T @ to
    for _ in range(sweeps):
        moves = 0
        for u in order:
            g, own = int(cls[u]), pairs[u, u]
            r, c = to[u].copy(), by[u].copy()
            r[g] -= own
            c[g] -= own
            m[g] -= r
            m[:, g] -= c
            m[g, g] -= own
            rows, cols = m.sum(axis=1), m.sum(axis=0)
            gain = (_xlogx(m + r) - _xlogx(m)).sum(axis=1) + (_xlogx(m + c[:, None]) - _xlogx(m)).sum(axis=0)
            d = np.diag(m)
            gain += _xlogx(d + r + c + own) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + c.sum() + own) - _xlogx(cols)
            gain[0] = gain[-1] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[g] + 1e-9:
                k = g
            m[k] += r
            m[:, k] += c
            m[k, k] += own
            if k != g:
                cls[u] = k
                to[:, g] -= pairs[:, u]
                to[:, k] += pairs[:, u]
                by[:, g] -= pairs[u]
                by[:, k] += pairs[u]
                moves += 1
        if moves * 200 < len(order):
            break
    return cls


def _training(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.filter(pa.array([fold(i) != HELD_OUT for i in b.column(0).to_pylist()], pa.bool_()))


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: hash and count of each token of the training texts, ends included."""

    def run(batches):
        for b in map(_training, chunks(batches, "text")):
            if b.num_rows:
                t = Tokens(b.column(1))
                c = np.bincount(t.codes, minlength=len(t.hash))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(t.hash, END)), pa.array(np.append(c, b.num_rows))], names=["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _pairs(t: Tokens, of: np.ndarray, end: int, size: int) -> np.ndarray:
    """Counts of pairs of consecutive values, from end to end of each text; negative values are left out."""
    before, after = t.around(of, end)
    v = of[t.codes]
    last = np.zeros(len(v), bool)
    full = np.diff(t.first) > 0
    last[t.first[1:][full] - 1] = True
    a, b = np.concatenate([before, v[last]]), np.concatenate([v, after[last]])
    ok = (a >= 0) & (b >= 0)
    out = np.bincount(a[ok] * size + b[ok], minlength=size * size)
    out[end * size + end] += int((~full).sum())
    return out


def unit_pairs(docs: DataFrame, top: Known) -> np.ndarray:
    """Counts of pairs of units - 0 an end, then the words of ``top``, then all others - in the training texts; each task adds up its own before Spark does."""
    size = FREQUENT + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in map(_training, chunks(batches, "text")):
            if b.num_rows:
                t = Tokens(b.column(1))
                total += _pairs(t, top.find(t.hash, FREQUENT)[1], 0, size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    return _summed(docs.mapInArrow(run, "k long, n long"), size)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """``k, n`` added up by Spark into a square table."""
    got = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def gains(between: np.ndarray) -> np.ndarray:
    """(class before * CLASSES + class after, class): what an occurrence there adds to a word's likelihood in each class, but for what is alike in all."""
    n, left, right = between.sum(), between.sum(axis=1), between.sum(axis=0)
    b = between + PRIOR * np.outer(left, right) / max(n, 1) + 1e-9
    ok = (left > 0) & (right > 0)
    ok[END_CLASS] = False
    ok[REST] |= not ok.any()
    size = np.where(ok, np.log(np.maximum(left, 1)) + np.log(np.maximum(right, 1)), np.inf)
    gain = (np.log(b)[:, None, :] + np.log(b.T)[None, :, :] - size).reshape(-1, CLASSES)
    return np.round(gain * (1 << 20)) / (1 << 20)  # sums are exact, in whatever order rows arrive


def placed(docs: DataFrame, top: Known, between: np.ndarray) -> DataFrame:
    """``h, c, cls``: count and best class of each training word that ``top`` hasn't, from the classes at its sides."""

    def run(batches):
        for b in map(_training, chunks(batches, "text")):
            if not b.num_rows:
                continue
            t = Tokens(b.column(1))
            found, cls = top.find(t.hash, REST)
            before, after = t.around(cls, END_CLASS)
            at = np.flatnonzero(~found[t.codes])
            at = at[np.argsort(t.codes[at], kind="stable")]
            side = (before * CLASSES + after)[at].astype("<u2")
            word, n = np.unique(t.codes[at], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * 2
            yield pa.RecordBatch.from_arrays([pa.array(t.hash[word]), pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(side)])], names=["h", "sides"])

    gain = gains(between)

    def place(batches):
        h0, c0, sum0 = None, 0, np.zeros(CLASSES)
        for b in chunks(batches, "sides", 1 << 17):
            h = b.column(0).to_numpy()
            data, at = text_bytes(b.column(1))
            side, n = data.view("<u2"), np.diff(at) // 2
            sums = np.add.reduceat(gain[side], at[:-1] // 2, axis=0)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(new)
            sums, n, h = np.add.reduceat(sums, begin, axis=0), np.add.reduceat(n, begin), h[begin]
            if h0 is not None and h[0] == h0:
                sums[0] += sum0
                n[0] += c0
            elif h0 is not None:
                h, n, sums = np.append(h0, h), np.append(c0, n), np.concatenate([sum0[None], sums])
            h0, c0, sum0 = h[-1], n[-1], sums[-1]
            yield word_rows(h[:-1], n[:-1], sums[:-1])
        if h0 is not None:
            yield word_rows(np.array([h0]), np.array([c0]), sum0[None])

    def word_rows(h, n, sums):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64)), pa.array(sums.argmax(axis=1).astype(np.int32))], names=["h", "c", "cls"])

    return docs.mapInArrow(run, "h long, sides binary").repartition("h").sortWithinPartitions("h").mapInArrow(place, "h long, c long, cls int")


def head_words(words: DataFrame, most: int = HEAD) -> Known:
    """Counts and classes of the most frequent words, at most ``most`` of them; all words of a count class or none."""
    level = F.floor(F.log2("c") * 8).cast("int")
    have, least = 0, None
    for r in sorted(words.groupBy(level.alias("l")).count().collect(), key=lambda r: -r.l):
        if have + r["count"] > most:
            break
        have, least = have + r["count"], r.l
    if least is None:
        return Known(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    got = words.filter(level >= least).select("h", "c", "cls").toArrow()
    return Known(got["h"].to_numpy(), got["c"].to_numpy(), got["cls"].to_numpy().astype(np.int64))


_TAIL = "row long, at long, h long"


def _tail(t: Tokens, code: np.ndarray, row: int) -> list[np.ndarray]:
    """Tokens of words without a code: row, place with the codes before and after it (0 for none, else one more), hash."""
    k = np.flatnonzero(code[t.codes] < 0)
    before, after = t.around(code, END_CLASS)
    place = k - t.first[t.texts[k]]
    return [row + t.texts[k], place << 16 | (before[k] + 1) << 8 | (after[k] + 1), t.hash[t.codes[k]]]


def _in_place(tail: DataFrame, words: DataFrame, run, schema: str) -> DataFrame:
    """Tokens joined with their words, in the order of their texts."""
    return tail.join(words, "h", "left").select("row", "at", "c", "cls").repartition("row").sortWithinPartitions("row", "at").mapInArrow(run, schema)


class _Sequence:
    """Codes before and after each token of sorted batches; a token without a code before it follows the one of the row above."""

    def __init__(self):
        self.row = self.place = self.code = None

    def push(self, row: np.ndarray, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, before, after = at >> 16, (at >> 8 & 0xFF) - 1, (at & 0xFF) - 1
        above = np.empty_like(code)
        above[1:] = code[:-1]
        above[0] = self.code if self.code is not None else -1
        self.row, self.place, self.code = row[-1], place[-1], code[-1]
        return np.where(before >= 0, before, above), after


@dataclass
class Model:
    """Logarithms (base 10) of class transitions, of class sizes, and of what the unknown word adds in its class."""

    transition: np.ndarray
    size: np.ndarray
    unknown: float
    unknown_class: int


def class_pairs(docs: DataFrame, words: DataFrame, head: Known) -> np.ndarray:
    """Counts of pairs of classes in the training texts; a word seen once has its class plus ``CLASSES``."""
    size = 2 * CLASSES
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        total = np.zeros(size * size, np.int64)
        row = TaskContext.get().partitionId() << 33
        for b in map(_training, chunks(batches, "text")):
            if not b.num_rows:
                continue
            t = Tokens(b.column(1))
            _, c, cls = shared.value.find(t.hash, 0, -1)
            code = np.where(c == 1, cls + CLASSES, cls)
            total += _pairs(t, code, END_CLASS, size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tail(t, code, row)], names=["row", "at", "h"])
            row += b.num_rows
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(total[k])], names=["row", "at", "h"])

    def count(batches):
        total, state = np.zeros(size * size, np.int64), _Sequence()
        for b in batches:
            row, at, c, cls = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            if not len(row):
                continue
            code = np.where(c == 1, cls + CLASSES, cls).astype(np.int64)
            before, after = state.push(row, at, code)
            total += np.bincount(before * size + code, minlength=size * size)
            k = after >= 0
            total += np.bincount(code[k] * size + after[k], minlength=size * size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    seen = written(docs.mapInArrow(run, _TAIL), "class-pairs")
    rows = seen.filter("row is null").select(F.col("at").alias("k"), F.col("h").alias("n"))
    out = _summed(rows.unionByName(_in_place(seen.filter("row is not null"), words, count, "k long, n long")), size)
    drop_written(seen)
    return out


def model_of(pairs: np.ndarray) -> Model:
    """Probabilities from the counts of class pairs, words seen once apart."""
    once = pairs[:, CLASSES:].sum(axis=0)
    unknown, n1 = int(once.argmax()) if once.any() else REST, int(once.sum())
    between = (pairs[:CLASSES, :CLASSES] + pairs[CLASSES:, :CLASSES] + pairs[:CLASSES, CLASSES:] + pairs[CLASSES:, CLASSES:]).astype(float)
    size = between.sum(axis=0)
    # the unknown word stands wherever a word seen once does, as often as those together
    left = pairs[:, CLASSES:].sum(axis=1)
    right = pairs[CLASSES:].sum(axis=0)
    between[:, unknown] += left[:CLASSES] + left[CLASSES:]
    between[unknown] += right[:CLASSES] + right[CLASSES:]
    mass = max(n1, 1)
    size[unknown] += mass
    between += ALPHA
    return Model(np.log10(between / between.sum(axis=1, keepdims=True)), np.log10(np.maximum(size, 1)), float(np.log10(mass)), unknown)


def train(docs: DataFrame, counts: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame, Known]:
    """The model of the training texts from their word counts (a written table), all words with count and class (another), and those of the head."""
    spark = docs.sparkSession
    top = counts.filter(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(FREQUENT - 1).collect()
    hashes, n = np.array([r.h for r in top], np.int64), np.array([r.c for r in top], np.int64)
    units = unit_pairs(docs, Known(hashes, np.arange(1, len(top) + 1)))
    cls = exchange(units)
    one = np.zeros((len(units), CLASSES), np.int64)
    one[np.arange(len(units)), cls] = 1
    cls = cls[1 : len(top) + 1]
    words = placed(docs, Known(hashes, cls), one.T @ units @ one)
    if top:
        words = words.unionByName(spark.createDataFrame([(r.h, r.c, int(k)) for r, k in zip(top, cls)], "h long, c long, cls int"))
    words = written(words, "words")
    known = head_words(words, head)
    return model_of(class_pairs(docs, words, known)), words, known


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``base_score`` is the unigram model with one added to each count, ``score``
    the class model's log10 probability.  Null texts count as empty: their end
    is their only token.  A null id hashes as the empty text and so trains.
    Repeated rows train once each and score alike.  Other columns are not
    read.  Without training texts every word is unknown and the classes are
    uniform.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = written(word_counts(plain), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("h") == int(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    m, words, known = train(plain, counts, head)
    drop_written(counts)
    shared = spark.sparkContext.broadcast((m, known))
    scale = float(np.log10(total.n + total.v + 1.0))
    out = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("id", _arrow(docs.schema[id_col].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        m, known = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in chunks(batches, "text"):
            t, texts = Tokens(b.column(1)), b.num_rows
            found, c, cls = known.find(t.hash, 0, -1)
            before, after = t.around(cls, END_CLASS)
            w, f = cls[t.codes], found[t.codes]
            per = lambda x: np.bincount(t.texts, x, texts) if len(t.codes) else np.zeros(texts)
            score = np.where(f, (np.log10(np.maximum(c, 1)) - m.size[cls])[t.codes], 0.0)
            score += np.where(f & (before >= 0), m.transition[before, w], 0.0)
            last = np.zeros(len(w), bool)
            full = np.diff(t.first) > 0
            last[t.first[1:][full] - 1] = True
            score += np.where(f & last, m.transition[w, END_CLASS], 0.0)
            score = per(score) + np.where(full, 0.0, m.transition[END_CLASS, END_CLASS])
            base = per(np.where(found, np.log10(c + 1.0), 0.0)[t.codes]) + np.log10(total.ends + 1.0)
            n = np.diff(t.first) + 1
            held = np.array([fold(i) == HELD_OUT for i in b.column(0).to_pylist()], bool)
            empty = pa.nulls(texts, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + texts)), empty, empty, b.column(0), pa.array(held), pa.array(n), pa.array(per(f).astype(np.int64) + (total.ends > 0)), pa.array(base - n * scale), pa.array(score)], schema=out)
            tail = [pa.array(x) for x in _tail(t, cls, row)]
            yield pa.RecordBatch.from_arrays([*tail, *(pa.nulls(len(tail[0]), out.field(k).type) for k in range(3, 9))], schema=out)
            row += texts

    def score_tail(batches):
        m, _ = shared.value
        state = _Sequence()
        for b in batches:
            row, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(row):
                continue
            c, cls = (b.column(k).fill_null(d).to_numpy(zero_copy_only=False).astype(np.int64) for k, d in ((2, 0), (3, m.unknown_class)))
            before, after = state.push(row, at, cls)
            score = np.where(c > 0, np.log10(np.maximum(c, 1)), m.unknown) - m.size[cls] + m.transition[before, cls]
            score += np.where(after >= 0, m.transition[cls, after], 0.0)
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums = [np.add.reduceat(x, begin) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0), score)]
            yield pa.RecordBatch.from_arrays([pa.array(row[begin]), *map(pa.array, sums)], names=["row", "n_known", "base", "score"])

    schema = f"row long, at long, h long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = written(plain.mapInArrow(run, schema), "scored")
    rare = _in_place(scored.filter("h is not null").select("row", "at", "h"), words, score_tail, "row long, n_known long, base double, score double")
    rare = rare.groupBy("row").agg(*(F.sum(c).alias(f"rare_{c}") for c in ("n_known", "base", "score")))
    both = lambda c: (F.col(c) + F.coalesce(F.col(f"rare_{c}"), F.lit(0))).alias(c)
    rows = scored.filter("h is null").drop("at", "h").join(rare, "row", "left")
    return rows.select(F.col("id").alias(id_col), "held_out", "n_tokens", both("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), both("base").alias("base_score"), both("score"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
