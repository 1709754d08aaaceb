"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a maximal run of a character class.  A window of fixed length
slides over it; the counts of its characters change by one in and one out, and
with them the window's Shannon entropy.  Windows at or above the class's
threshold join into spans, but for those that the allow-list covers: windows
that hold a short allowed string, or lie by half or more in a long one.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks, text_bytes

# Fixed patterns of the contract. Letters in either case are spelled out, so that no letter outside ASCII folds to one.
_ANY = lambda s: "".join(f"[{c.upper()}{c}]" for c in s)
ASSIGN = re.compile("(?:" + "|".join([_ANY("password"), _ANY("passwd"), _ANY("secret"), _ANY("token"), _ANY("api") + "_?" + _ANY("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
#: (class, its runs, bits that a window needs, kinds of characters - lower, upper, digit, sign - that it needs)
CLASSES = (
    ("hex", re.compile("[0-9A-Fa-f]{%d,}" % WINDOW), 3.0, 2),
    ("alnum", re.compile("[0-9A-Za-z]{%d,}" % WINDOW), 3.6, 3),
    ("base64", re.compile("[0-9A-Za-z+/=_-]{%d,}" % WINDOW), 3.8, 3),
)
#: Strings that are no secrets: UUIDs, dates and times, alphabets in order, placeholders.
ALLOW = (
    re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"),
    re.compile(r"\d{4}-\d\d-\d\d"),
    re.compile(r"abcdef|012345|123456|uvwxyz", re.I | re.A),
    re.compile(r"example|placeholder|changeme|your|x{6}|(.)\1{5}", re.I | re.A),
)
_NLOGN = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]
_ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/=_-"]] = True


def _kind(c: str) -> int:
    return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8


def windows(candidate: str, window: int = WINDOW):
    """(start, entropy in bits, kinds of characters) of each window, from counts kept up to date."""
    counts: dict[str, int] = {}
    kinds = {1: 0, 2: 0, 4: 0, 8: 0}
    total = 0.0  # sum of n log n over the counts
    for i, c in enumerate(candidate):
        if i >= window:
            old = candidate[i - window]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
            kinds[_kind(old)] -= 1
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        kinds[_kind(c)] += 1
        if i >= window - 1:
            yield i - window + 1, log2(window) - total / window, sum(n > 0 for n in kinds.values())


def _suppressed(m: re.Match) -> tuple[int, int]:
    """The first and the last start of windows that an allowed string covers."""
    need = min(m.end() - m.start(), WINDOW // 2)
    return m.start() + need - WINDOW, m.end() - need


def entropy_spans(text: str, allow=ALLOW) -> list[tuple[int, int]]:
    """Maximal spans covered by windows of high entropy, over all classes."""
    found: list[tuple[int, int]] = []
    for _, runs, bits, kinds in CLASSES:
        for m in runs.finditer(text):
            run = m.group()
            fine = [_suppressed(a) for pattern in allow for a in pattern.finditer(run)]
            for at, h, k in windows(run):
                if h >= bits and k >= kinds and not any(a <= at <= b for a, b in fine):
                    found.append((m.start() + at, m.start() + at + WINDOW))
    found.sort()
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def base_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns. ``runs``: whether the text may have runs of 20 characters at all."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if runs:
        if "AKIA" in text:
            out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def uncovered(a: int, b: int, spans) -> list[tuple[int, int]]:
    """The parts of ``a`` to ``b`` outside ``spans``, which are in order of their starts."""
    out = []
    for _, s, e in spans:
        if s >= b:
            break
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return out + [(a, b)] if a < b else out


def scan(text: str, runs: bool = True) -> tuple[list, list]:
    """Base spans, and all spans: entropy adds what no base span covers."""
    base = base_spans(text, runs)
    more = []
    if runs:
        more = [("entropy", a, b) for span in entropy_spans(text) for a, b in uncovered(*span, base)]
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]]))


def has_runs(texts: pa.Array) -> np.ndarray:
    """Whether each text has a run of at least ``WINDOW`` characters of the widest class; patterns other than assign need one."""
    data, at = text_bytes(texts)
    out = np.zeros(len(texts), bool)
    if len(data):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _RUN[data], [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        long = np.flatnonzero(b - a >= WINDOW)
        for k in long:  # a run may go over the edge of a text, so mark every text it touches
            first = int(np.searchsorted(at, a[k], "right")) - 1
            last = int(np.searchsorted(at, b[k] - 1, "right")) - 1
            out[first : last + 1] = True
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``n_assign, n_access, n_hex, base_sha256, spans``.

    Offsets are code points, ends exclusive.  A null or empty text has no
    spans; a null id stays null; repeated rows are scanned alike; other
    columns are not read.
    """

    def run(batches):
        for b in chunks(batches, text_col):
            rows = []
            for text, runs in zip(b.column(1).to_pylist(), has_runs(b.column(1))):
                base, spans = scan(text or "", bool(runs))
                n = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` replaced by ``mark`` and, where the text changed, its length in ``chars_col`` renewed.

    All rows and columns stay; null and clean texts stay as they are.
    """

    def clean(text):
        if not text:
            return text
        _, spans = scan(text)
        out, at = [], 0
        for _, a, b in spans:
            if b <= at:
                continue
            out += [text[at : max(a, at)], mark] if a >= at else []
            at = b
        return "".join([*out, text[at:]]) if spans else text

    def run(batches):
        for b in chunks(batches, text_col):
            k = b.schema.get_field_index(text_col)
            flagged, old = has_runs(b.column(k)), b.column(k).to_pylist()
            new = [clean(t) if f or (t and ("=" in t or ":" in t)) else t for t, f in zip(old, flagged)]
            cols = list(b.columns)
            cols[k] = pa.array(new, b.schema.field(k).type)
            if chars_col and (c := b.schema.get_field_index(chars_col)) >= 0:
                cols[c] = pa.array([len(y) if y != x else n for x, y, n in zip(old, new, cols[c].to_pylist())], b.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
