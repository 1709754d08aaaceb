"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` counts whole texts with numpy, a chunk of an Arrow batch at a
time.  ``fit`` grows histogram trees for the logistic loss on a bounded sample
of labelled documents; chosen features are monotonic: a split that would make
quality rise with them is not taken, and bounds pass down to both children.
The trees are flattened into node arrays (feature, threshold, children,
value), which score a whole batch with one gather per level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks, starts_within, text_bytes

#: At most so many labelled documents train the model, chosen by a hash of their id.
SAMPLE = 20_000
#: Bytes of text counted at once.
CHUNK = 1 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents below this probability of good quality are rejected.
THRESHOLD = 0.5

FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "marks", "distinct_words", "same_again", "bars", "line_words")
#: Quality never rises with these features.
FALLING = ("symbols_per_word", "dup_lines", "repeat_words", "same_again", "bars")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _codes(values: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text that hold a word and equal an earlier line, and lines with a word."""
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    ends = np.concatenate([breaks, offsets[1:]])
    # a text's end comes before a line break that is the first byte of the next text
    key = np.concatenate([breaks * 2 + 1, offsets[1:] * 2])
    order = np.argsort(key, kind="stable")
    ends = ends[order]
    is_break = (order < len(breaks))
    text = np.concatenate([[0], np.cumsum(~is_break)])[:-1]
    starts = np.concatenate([[0], ends[:-1] + is_break[:-1]])
    words = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = words[ends] > words[starts]
    at = np.zeros(len(ends) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data[data != 10])])
    key = _codes(text.astype(np.int64) << 32 | lines.dictionary_encode().indices.to_numpy(zero_copy_only=False))
    seen = np.zeros(len(key), bool)
    seen[np.unique(key, return_index=True)[1]] = True
    return np.bincount(text[full & ~seen], minlength=texts), np.bincount(text[full], minlength=texts)


def _repeats(ids: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A mask of the words that lie in a 3-word window found twice or more in their text."""
    out = np.zeros(len(ids), bool)
    ok = starts_within(first, 3)
    if not ok.any():
        return out
    pair = _codes(ids[:-1].astype(np.int64) << 32 | ids[1:])
    at = np.flatnonzero(ok)
    three = _codes(pair[at].astype(np.int64) << 32 | ids[at + 2])
    key = _codes(text[at].astype(np.int64) << 32 | three)
    at = at[np.bincount(key)[key] > 1]
    for k in range(3):
        out[at + k] = True
    return out


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts by name, and a row of ``FEATURES`` per text."""
    data, offsets = text_bytes(texts)
    w = Words(data, offsets)
    n, text, ids, inside = w.counts(), w.texts(), w.ids().astype(np.int64), w._inside
    cut = w.first
    count = lambda mask: _per_text(mask, offsets)
    word_chars = count(inside & ((data & 0xC0) != 0x80))
    symbols = count(_SYMBOL[data])
    dups, lines = _dup_lines(data, offsets, inside)
    repeat = _per_text(_repeats(ids, cut, text), cut) if len(w) else np.zeros(len(n), np.int64)
    key = _codes(text.astype(np.int64) << 32 | ids)
    fresh = np.zeros(len(key), bool)
    fresh[np.unique(key, return_index=True)[1]] = True
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    per = lambda x, by: x / np.maximum(by, 1)
    base = {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeat}
    f = [np.log1p(n), per(word_chars, n), per(symbols, n), per(dups, lines), per(repeat, n), per(count((data >= 65) & (data <= 90)), word_chars), per(count((data >= 48) & (data <= 57)), word_chars)]
    f += [per(count((data == 33) | (data == 63)), n), per(_per_text(fresh, cut), n), per(_per_text(again, cut), n), per(count(data == 124), n), per(n, lines)]
    return base, np.column_stack(f) if len(n) else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Flattened trees: node k goes to ``left[k]`` if feature <= threshold, else to ``left[k] + 1``; leaves point to themselves."""

    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                nxt = self.left[at]
                at = np.where(nxt == at, at, nxt + (x[rows, self.feature[at]] > self.threshold[at])).astype(np.int32)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, falling=tuple(FEATURES.index(f) for f in FALLING), trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows, or with one label only, the model keeps everything it can't tell."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(start=20.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    out = Trees(start=float(np.log(y.mean() / (1 - y.mean()))), depth=depth)
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), out.start)

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (value, 0.0)):
            a.append(v)
        return len(left) - 1

    def grow(k: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows], hess[rows]
        value[k] = rate * float(np.clip(-g.sum() / (h.sum() + l2), low, high))
        if level == depth or len(rows) < 2 * least:
            margin[rows] += value[k]
            return
        best = (1e-6, None)
        score = lambda a, b: a * a / (b + l2)
        for j in range(x.shape[1]):
            size = len(cuts[j]) + 1
            if size < 2:
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = score(gl, hl) + score(gr, hr) - score(g.sum(), h.sum())
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            bad = (nl < least) | (len(rows) - nl < least)
            if j in falling:
                bad |= vr > vl
            gain[bad] = -1
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (j, c, float(vl[c]), float(vr[c])))
        if best[1] is None:
            margin[rows] += value[k]
            return
        j, c, vl, vr = best[1]
        a = node()
        b = node()
        feature[k], threshold[k], left[k] = j, float(cuts[j][c]), a
        goes = binned[rows, j] <= c
        mid = (vl + vr) / 2
        # left holds the smaller feature values, so the higher quality
        grow(a, rows[goes], level + 1, mid if j in falling else low, high)
        grow(b, rows[~goes], level + 1, low, mid if j in falling else high)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        grow(root, np.arange(len(y)), 0, -np.inf, np.inf)
    out.roots, out.feature, out.left = (np.array(a, np.int32) for a in (roots, feature, left))
    out.threshold, out.value = np.array(threshold), np.array(value)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from the ``sample`` labelled documents whose ids hash lowest (all, if there are fewer).

    At most ``sample`` ids are broadcast and at most ``sample`` rows of
    statistics come to the driver.  Null ids and labels are not used; of
    repeated labels of one id, and of repeated documents, one trains.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches):
        for b in chunks(batches, "_text", CHUNK):
            _, x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "_x"])

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    kind = dict(found.dtypes)["_id"]
    rows = found.mapInArrow(run, f"_id {kind}, _y double, _x array<double>").groupBy("_id").agg(F.min(F.struct("_y", "_x")).alias("r")).orderBy("_id").limit(sample).select("r.*").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows.column("_x").to_pylist())
    return fit(x, (rows.column("_y").to_numpy() >= 0.5).astype(float))


def verdicts(texts: pa.Array, model: Trees, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """Base counts, ``base_failed``, ``p_quality`` and ``kept`` of each text."""
    base, x = statistics(texts)
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    p = model.probability(x)
    return base | {"base_failed": failed, "p_quality": p, "kept": ~failed & (p >= threshold)}


def quality_rules(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: counts, ``base_failed``, ``kept`` and ``p_quality``.

    Null and empty texts have no words and fail; null ids stay null; repeated
    rows get equal verdicts; other columns are not read.
    """

    def run(batches):
        for b in chunks(batches, text_col, CHUNK):
            v = verdicts(b.column(1), model, threshold)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v[c], k) for c, k in zip(names, kinds))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double")


def keep_quality(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps."""

    def run(batches):
        for b in chunks(batches, text_col, CHUNK):
            yield b.filter(pa.array(verdicts(b.column(b.schema.get_field_index(text_col)), model, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)
