"""ISO media containers: write, walk and read back.

``walk`` follows nested boxes, decodes the sample tables of every track, those
of movie fragments included, and gives codec, duration and the times and byte
ranges of keyframes; it never looks into ``mdat``.  Whatever is not well
formed, or claims more than ``MOST_SAMPLES`` samples, is a ``MediaError``.
``wrap`` stores a payload losslessly as 8-bit samples in such a container, so
that a column of bytes can be tested end to end.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: boxes that hold boxes, and the header bytes before their children.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "udta": 0, "mvex": 0, "moof": 0, "traf": 0}
# Fixed values of the format: optional fields of a track fragment, of a run of samples and of each of them, by their flag; the flag of a sample that is no keyframe.
FRAGMENT = ((0x01, "base", "Q"), (0x02, "entry", "I"), (0x08, "duration", "I"), (0x10, "size", "I"), (0x20, "flags", "I"))
RUN = ((0x01, "offset", "i"), (0x04, "flags", "I"))
SAMPLE = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
BASE_IS_MOOF, NO_KEYFRAME = 0x20000, 0x10000
#: Samples per second of a stored payload, samples in a chunk, and chunks from one keyframe to the next.
RATE, PER_CHUNK, KEY_EVERY = 8000, 4096, 8
#: Boxes in one another, and samples of a track, beyond which a file is refused.
MOST_DEEP, MOST_SAMPLES = 64, 1 << 24


class MediaError(ValueError):
    """The bytes are no well-formed container."""


def _box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind.encode("ascii"), len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind.encode("ascii")) + body


def _full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def wrap(payload: bytes) -> bytes:
    """A file with one audio track of raw 8-bit mono samples, a media sample being a chunk of the payload.

    Each media sample holds ``PER_CHUNK`` bytes (the last one what is left);
    every ``KEY_EVERY``-th is marked as a keyframe.
    """
    sizes = [PER_CHUNK] * (len(payload) // PER_CHUNK) + ([len(payload) % PER_CHUNK] if len(payload) % PER_CHUNK else [])
    keys = range(1, len(sizes) + 1, KEY_EVERY)
    times = [(len(sizes) - 1, PER_CHUNK), (1, sizes[-1])] if len(sizes) > 1 else [(1, sizes[0])] if sizes else []
    ftyp = _box("ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")
    short = len(sizes) % KEY_EVERY  # samples in the last chunk, if it is not full
    runs = [(1, KEY_EVERY, 1)] * (len(sizes) >= KEY_EVERY) + [(len(keys), short, 1)] * (short > 0)
    entry = _box("raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(at: int) -> bytes:
        stbl = _box(
            "stbl",
            _full("stsd", struct.pack(">I", 1), entry),
            _full("stts", struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times)),
            _full("stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full("stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
            _full("co64", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}Q", *(at + (k - 1) * PER_CHUNK for k in keys))),
            _full("stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        dinf = _box("dinf", _full("dref", struct.pack(">I", 1), _full("url ", flags=1)))
        minf = _box("minf", _full("smhd", b"\0" * 4), dinf, stbl)
        mdhd = _full("mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1)
        mdia = _box("mdia", mdhd, _full("hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"), minf)
        tkhd = _full("tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, version=1, flags=3)
        mvhd = _full("mvhd", struct.pack(">QQIQ", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1)
        return _box("moov", mvhd, _box("trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(at) + _box("mdat", payload)


def boxes(data, start: int = 0, end: int | None = None, path: str = ""):
    """(path, body start, body end) of each box, parents before children."""
    end = len(data) if end is None else end
    if path.count("/") > MOST_DEEP:
        raise MediaError(f"boxes nest too deep at {start}")
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"no long size at {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box at {start} has size {size}")
        name = kind.decode("latin-1")
        here = f"{path}/{name}"
        yield here, body, start + size
        if name in CONTAINERS:
            yield from boxes(data, body + CONTAINERS[name], start + size, here)
        start += size


def _table(data, at: int, end: int, row: str) -> list[tuple]:
    """The rows of a counted table after version and flags."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = struct.calcsize(">" + row)
    if at + 8 + n * size > end:
        raise MediaError(f"table at {at} has {n} rows")
    return list(struct.iter_unpack(">" + row, data[at + 8 : at + 8 + n * size]))


def walk(data) -> list[dict]:
    """Per track: codec, handler, timescale, duration, byte ranges of samples and keyframes, times of keyframes."""
    tracks: list[dict] = []
    usual: dict[int, dict] = {}  # what samples of fragments are unless these say otherwise, by track
    start = stop = after = 0  # of the outermost box; where the data of the last run ended
    fragment: dict = {}
    for path, at, end in boxes(data):
        kind = path.rsplit("/", 1)[1]
        if path.count("/") == 1:
            start, stop = stop, end
            after = start
        try:
            if kind == "trak":
                tracks.append({})
            elif path == "/moov/mvex/trex":
                track, _, *values = struct.unpack_from(">5I", data, at + 4)
                usual[track] = dict(zip(("duration", "size", "flags"), values))
            elif path == "/moof/traf":
                fragment = {}
            elif path == "/moof/traf/tfhd":
                fragment = _fragment(data, at, end, tracks, usual, start, after)
            elif path == "/moof/traf/tfdt" and fragment:
                (fragment["track"]["clock"],) = struct.unpack_from(">Q" if data[at] == 1 else ">I", data, at + 4)
            elif path == "/moof/traf/trun":
                after = _run(data, at, end, fragment)
            elif "/trak/" in path:
                _read(tracks[-1], kind, data, at, end)
        except struct.error as e:
            raise MediaError(f"{path}: {e}") from e
    return [_placed(t) for t in tracks]


def _read(t: dict, kind: str, data, at: int, end: int) -> None:
    """What a box in a track says of it."""
    if kind == "tkhd":
        (t["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    elif kind == "mdhd":
        t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    elif kind == "hdlr":
        t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == "stsd":
        t["codec"] = next((p.rsplit("/", 1)[1] for p, _, _ in boxes(data, at + 8, end)), "")
    elif kind == "stts":
        t["times"] = _table(data, at, end, "II")
    elif kind == "stsc":
        t["per_chunk"] = _table(data, at, end, "III")
    elif kind == "stsz":
        same, n = struct.unpack_from(">II", data, at + 4)
        if n > MOST_SAMPLES or not same and at + 12 + 4 * n > end:
            raise MediaError(f"table at {at} has {n} rows")
        t["sizes"] = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 12))
    elif kind in ("stco", "co64"):
        t["chunks"] = [x for (x,) in _table(data, at, end, "I" if kind == "stco" else "Q")]
    elif kind == "stss":
        t["keys"] = [x for (x,) in _table(data, at, end, "I")]


def _given(data, at: int, end: int, flags: int, fields) -> tuple[dict, int]:
    """The optional fields that ``flags`` say are there, and where they end."""
    out = {}
    for flag, name, form in fields:
        if flags & flag:
            (out[name],) = struct.unpack_from(">" + form, data, at)
            at += struct.calcsize(">" + form)
    if at > end:
        raise MediaError(f"box ends at {end}, its fields at {at}")
    return out, at


def _fragment(data, at: int, end: int, tracks: list[dict], usual: dict, moof: int, after: int) -> dict:
    """A track's part of a movie fragment: its track, what its samples are by default, and where its offsets count from."""
    flags, ident = struct.unpack_from(">II", data, at)
    got, _ = _given(data, at + 8, end, flags, FRAGMENT)
    track = next((t for t in tracks if t.get("id") == ident), None)
    if track is None:
        raise MediaError(f"fragment at {at} is of no track")
    track.setdefault("clock", sum(n * d for n, d in track.get("times", [])))
    base = got.pop("base", moof if flags & BASE_IS_MOOF else after)
    return {"track": track, "base": base, "next": base, "usual": {"duration": 0, "size": 0, "flags": 0} | usual.get(ident, {}) | got}


def _run(data, at: int, end: int, fragment: dict) -> int:
    """Add a run of samples to its track; where their data ends."""
    flags, n = struct.unpack_from(">II", data, at)
    first, at = _given(data, at + 8, end, flags, RUN)
    names = [name for flag, name in SAMPLE if flags & flag]
    row = struct.Struct(f">{len(names)}I")
    if not fragment:
        raise MediaError(f"run at {at} before its fragment's header")
    track = fragment["track"]
    samples = track.setdefault("fragments", [])
    if at + n * row.size > end or len(samples) + n > MOST_SAMPLES:
        raise MediaError(f"run at {at} has {n} samples")
    place = fragment["base"] + first.pop("offset") if "offset" in first else fragment["next"]
    if place < 0:
        raise MediaError(f"run at {at} begins before the file")
    for k in range(n):
        own = dict(zip(names, row.unpack_from(data, at + k * row.size)))
        s = fragment["usual"] | (first if k == 0 else {}) | own
        samples.append((place, place + s["size"], track["clock"], not s["flags"] & NO_KEYFRAME))
        place += s["size"]
        track["clock"] += s["duration"]
    fragment["next"] = place
    return place


def _placed(t: dict) -> dict:
    """The track with the byte range of each sample, from its chunk table and its fragments."""
    sizes, chunks, runs = t.get("sizes", []), t.get("chunks", []), t.get("per_chunk", [])
    at, sample = [], 0
    for i, (first, n, _) in enumerate(runs):
        stop = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for c in range(first, stop):
            if not 1 <= c <= len(chunks):
                raise MediaError(f"no chunk {c}")
            pos = chunks[c - 1]
            for _ in range(min(n, len(sizes) - sample)):
                at.append((pos, pos + sizes[sample]))
                pos += sizes[sample]
                sample += 1
    if sample != len(sizes):
        raise MediaError(f"{len(sizes)} samples, {sample} placed")
    keys = [k for k in t.get("keys", range(1, len(sizes) + 1)) if 1 <= k <= len(at)]
    times = _key_times(t.get("times", []), keys)
    frames, scale, duration = [at[k - 1] for k in keys], t.get("timescale") or 1, t.get("duration", 0)
    if more := t.get("fragments"):
        at += [(a, b) for a, b, _, _ in more]
        frames += [(a, b) for a, b, _, key in more if key]
        times += [time for _, _, time, key in more if key]
        duration = max(duration, t["clock"])
    return {"codec": t.get("codec", ""), "handler": t.get("handler", ""), "timescale": scale, "duration": duration, "samples": at, "keyframes": frames, "key_times": times}


def _key_times(runs: list[tuple], keys: list[int]) -> list[int]:
    """When each keyframe is shown, in units of the timescale: the durations of the samples before it."""
    out, run, passed, time = [], 0, 0, 0
    for k in sorted(keys):
        while run < len(runs) and passed + runs[run][0] < k:
            passed, time, run = passed + runs[run][0], time + runs[run][0] * runs[run][1], run + 1
        if run == len(runs):
            raise MediaError(f"no duration for sample {k}")
        out.append(time + (k - 1 - passed) * runs[run][1])
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent ranges made one."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def read_back(data, track: dict) -> bytes:
    """The track's samples in order, cut out of the stored bytes."""
    return b"".join(data[a:b] for a, b in joined(track["samples"]))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text in a container, index it from its boxes, and read the payload back.

    One row per input row: ``n_bytes``, ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``feature`` (JSON with
    codec, duration in units of the timescale, keyframe byte ranges and times).
    A null text counts as empty and a null id stays null; equal texts give
    equal values; other columns of ``docs`` are not read.
    """

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                stored = wrap(pad(raw))
                (track,) = walk(stored)
                back = read_back(stored, track)
                feature = {"codec": track["codec"].strip(), "handler": track["handler"], "timescale": track["timescale"], "duration": track["duration"], "keyframes": [list(k) for k in track["keyframes"]], "key_times": track["key_times"]}
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), json.dumps(feature, separators=(",", ":"))))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
