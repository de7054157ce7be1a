"""ISO base media containers as columns.

`pack` stores bytes losslessly as 8-bit samples of one audio track (unsigned
8-bit PCM, a sample table entry for each block of `UNIT` bytes, a keyframe every
`KEY_EVERY` entries). `parse` walks the nested boxes of any such container and
decodes the sample tables of every track (stsd, stts, stss, stsc, stsz or stz2,
stco or co64) and of its fragments (trex, tfhd, trun) into codec, duration and the
byte ranges of keyframes; payload bytes are never decoded.

Memory is bounded by the container: boxes nest DEPTH deep at most, a track's samples
are no more than the container's bytes and don't add up to more than these.

Defined cases: a null text counts as empty and gives one block of spaces; null,
empty, truncated or foreign media, boxes nested too deep, forged tables and
samples beyond the container's end give null features and no error; a track
without a keyframe table has keyframes only (ISO 14496-12); a track without samples
has none. Rows are independent: repeated rows give equal values, null ids and extra
columns change nothing, an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .shared import map_rows

UNIT = 192
KEY_EVERY = 8
PER_CHUNK = 16
RATE = 8000
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}

DEPTH = 16

#: A track: what `tracks` holds of each.
TRACK = (
    "track_id:bigint,codec:string,timescale:bigint,duration:bigint,duration_s:double,n_samples:bigint,n_keyframes:bigint,"
    "keyframes:array<struct<offset:bigint,size:bigint>>"
)


@dataclass
class Track:
    """Samples in order: byte ranges, and which of them are keyframes."""

    track_id: int
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def keyframes(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))


# --- writing -----------------------------------------------------------------
def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _matrix() -> bytes:
    return struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (max(1, -(-len(data) // unit)) * unit - len(data))


def pack(payload: bytes) -> bytes:
    """A container whose media data is the payload, in blocks of UNIT bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    chunks, rest = divmod(n, PER_CHUNK)
    runs = ([(1, PER_CHUNK, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    keys = range(1, n + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    starts = range(0, len(payload), UNIT * PER_CHUNK)
    large = len(payload) >= 1 << 31

    def moov(base: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        offsets = [base + s for s in starts]
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets))
            if large
            else _full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets)),
        )
        length = n * UNIT
        # Version 1 headers: durations of 64 bits.
        times = struct.pack(">QQ", 0, 0)
        mdhd = _box(b"mdhd", struct.pack(">I", 1 << 24), times, struct.pack(">IQHH", RATE, length, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        tkhd = _box(
            b"tkhd", struct.pack(">I", (1 << 24) | 7), times, struct.pack(">IIQ", 1, 0, length),
            bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _matrix(), bytes(8),
        )
        mvhd = _box(
            b"mvhd", struct.pack(">I", 1 << 24), times, struct.pack(">IQ", RATE, length),
            struct.pack(">IH", 0x10000, 0x100), bytes(10), _matrix(), bytes(24), struct.pack(">I", 2),
        )
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    base = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(base), head, payload))


# --- reading -----------------------------------------------------------------
def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes side by side in a range."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def walk(data: memoryview, start: int, end: int, depth: int = 0) -> dict[bytes, list]:
    """Nested boxes: lists of inner dicts for containers, of ranges for the rest."""
    if depth > DEPTH:
        raise ValueError("boxes are nested too deep")
    found: dict[bytes, list] = {}
    for kind, a, b in boxes(data, start, end):
        found.setdefault(kind, []).append(walk(data, a, b, depth + 1) if kind in CONTAINERS else (a, b))
    return found


def _numbers(data: memoryview, a: int, n: int, b: int, kind: str) -> np.ndarray:
    """n numbers of a kind from a on, none of them beyond b."""
    if n < 0 or a + n * np.dtype(kind).itemsize > b:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, kind, n, a).astype(np.int64)


def _table(data: memoryview, span: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a table box: a count, then `columns` numbers a row."""
    (n,) = struct.unpack_from(">I", data, span[0] + 4)
    return _numbers(data, span[0] + 8, n * columns, span[1], kind).reshape(n, columns)


def _sizes(data: memoryview, table: dict[bytes, list]) -> np.ndarray:
    if b"stz2" in table:
        a, b = table[b"stz2"][0]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            pairs = _numbers(data, a + 12, (n + 1) // 2, b, ">u1")
            return np.stack((pairs >> 4, pairs & 15), axis=1).ravel()[:n]
        return _numbers(data, a + 12, n, b, {8: ">u1", 16: ">u2"}[bits])
    a, b = table[b"stsz"][0]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if not fixed:
        return _numbers(data, a + 12, n, b, ">u4")
    if n * fixed > len(data):
        raise ValueError("more samples than bytes")
    return np.full(n, fixed, np.int64)


def sample_ranges(data: memoryview, table: dict[bytes, list]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sizes) of all samples, from chunk runs, sizes and chunk offsets."""
    sizes = _sizes(data, table)
    wide = b"co64" in table
    chunks = _table(data, table[b"co64" if wide else b"stco"][0], 1, ">u8" if wide else ">u4")[:, 0]
    runs = _table(data, table[b"stsc"][0], 3)
    first = np.clip(runs[:, 0] - 1, 0, len(chunks))
    if (np.diff(runs[:, 0]) <= 0).any() or (len(runs) and runs[0, 0] != 1):
        raise ValueError("chunk runs out of order")
    held = np.repeat(runs[:, 1], np.diff(first, append=len(chunks)))
    ends = np.minimum(np.cumsum(np.minimum(held, len(sizes))), len(sizes))  # samples up to each chunk's end
    held = np.diff(ends, prepend=0)
    if held.sum() != len(sizes):
        raise ValueError("chunks and sizes differ in length")
    before = np.cumsum(sizes) - sizes
    begin = np.where(held > 0, before[np.minimum(ends - held, max(len(sizes) - 1, 0))], 0) if len(sizes) else held
    return np.repeat(chunks - begin, held) + before, sizes


def _fields(data: memoryview, a: int, flags: int, bits: tuple[int, ...], kinds: str) -> tuple[list[int | None], int]:
    """Fields that stand only where their bit is set; and where they end."""
    out: list[int | None] = []
    for bit, kind in zip(bits, kinds):
        out.append(None)
        if flags & bit:
            (out[-1],) = struct.unpack_from(f">{kind}", data, a)
            a += struct.calcsize(f">{kind}")
    return out, a


def _fragments(data: memoryview, preset: dict[int, tuple]) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """(offsets, sizes, keys, duration) of each run of samples, by track; preset:
    duration, size and flags that a track's samples have where nothing else is said."""
    found: dict[int, list] = {}
    total = 0
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moof":
            continue
        head = 16 if struct.unpack_from(">I", data, a - 8)[0] != b - a + 8 and a >= 16 and struct.unpack_from(">I", data, a - 16)[0] == 1 else 8
        end = moof = a - head
        for traf in walk(data, a, b).get(b"traf", []):
            at = traf[b"tfhd"][0][0]
            flags, track = struct.unpack_from(">II", data, at)
            (base, _, *own), _ = _fields(data, at + 8, flags, (1, 2, 8, 16, 32), "QIIII")
            own = [x if x is not None else y for x, y in zip(own, preset.get(track, (0, 0, 0)))]
            end = base if base is not None else moof if flags & 0x20000 or end == moof else end
            base = end
            for s, e in traf.get(b"trun", []):
                flags, n = struct.unpack_from(">II", data, s)
                (offset, first), s = _fields(data, s + 8, flags, (1, 4), "iI")
                total += n
                if total > len(data):
                    raise ValueError("more samples than bytes")
                there = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
                rows = _numbers(data, s, n * sum(there), e, ">u4").reshape(n, sum(there))
                times, sizes, signs = (rows[:, sum(there[:k])] if there[k] else np.full(n, own[k], np.int64) for k in range(3))
                signs = signs.copy()
                if n and first is not None:
                    signs[0] = first
                begin = base + offset if offset is not None else end
                end = begin + int(sizes.sum())
                found.setdefault(track, []).append((begin + np.cumsum(sizes) - sizes, sizes, signs & 0x10000 == 0, int(times.sum())))
    return found


def _track(data: memoryview, trak: dict[bytes, list], fragments: dict[int, list]) -> Track:
    mdia = trak[b"mdia"][0]
    table = mdia[b"minf"][0][b"stbl"][0]
    at = mdia[b"mdhd"][0][0]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at = trak[b"tkhd"][0][0] if b"tkhd" in trak else None
    (track,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12)) if at is not None else (0,)
    codec = bytes(data[table[b"stsd"][0][0] + 12 :][:4]).decode("latin-1")
    offsets, sizes = sample_ranges(data, table)
    if _table(data, table[b"stts"][0], 2)[:, 0].sum() != len(sizes):
        raise ValueError("times and sizes differ in length")
    keys = np.ones(len(sizes), bool)
    if b"stss" in table:
        at = _table(data, table[b"stss"][0], 1)[:, 0]
        keys[:] = False
        keys[at[(at > 0) & (at <= len(sizes))] - 1] = True
    parts = fragments.get(track, [])
    offsets, sizes, keys = (np.concatenate((x, *(p[k] for p in parts))) for k, x in enumerate((offsets, sizes, keys)))
    if sizes.sum() > len(data) or (len(sizes) and ((offsets < 0).any() or (offsets + sizes).max() > len(data))):
        raise ValueError("samples beyond the container")
    return Track(track, codec, scale, duration + sum(p[3] for p in parts), offsets, sizes, keys.astype(bool))


def parse(media: bytes | None) -> list[Track] | None:
    """All tracks; None for what isn't a readable container."""
    if not media:
        return None
    try:
        data = memoryview(media)
        ((_, a, b),) = [x for x in boxes(data, 0, len(data)) if x[0] == b"moov"][:1]
        moov = walk(data, a, b)
        preset = {}
        for at, _ in (x for mvex in moov.get(b"mvex", []) for x in mvex.get(b"trex", [])):
            track, _, *values = struct.unpack_from(">5I", data, at + 4)
            preset[track] = tuple(values)
        fragments = _fragments(data, preset)
        return [_track(data, trak, fragments) for trak in moov[b"trak"]]
    except (KeyError, IndexError, ValueError, struct.error, TypeError):
        return None


def samples(media: bytes, track: Track) -> bytes:
    """The stored samples of a track, in order."""
    data, joined = memoryview(media), []
    for at, size in zip(track.offsets.tolist(), track.sizes.tolist()):  # neighbours in one piece
        if joined and joined[-1][1] == at:
            joined[-1][1] = at + size
        else:
            joined.append([at, at + size])
    return b"".join(data[a:b] for a, b in joined)


# --- DataFrames --------------------------------------------------------------
def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the text in UTF-8) and media (its container)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids, texts):
        for i, text in zip(ids, texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            yield i, len(data), pack(pad(data))

    return map_rows(df.select(id_col, text_col), lambda: run, f"`{id_col}` {kind}, n_bytes bigint, media binary", 200)


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id_col and `tracks`, an array of TRACK, for every container."""
    kind = df.schema[id_col].dataType.simpleString()

    def seconds(t: Track) -> float | None:
        return t.duration / t.timescale if t.timescale else None

    def run(ids, media):
        for i, m in zip(ids, media):
            found = parse(m)
            yield i, found and [
                {
                    "track_id": t.track_id, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "duration_s": seconds(t),
                    "n_samples": len(t.sizes), "n_keyframes": int(t.keys.sum()), "keyframes": [{"offset": a, "size": b} for a, b in t.keyframes()],
                }
                for t in found
            ]

    return map_rows(df.select(id_col, media_col), lambda: run, f"`{id_col}` {kind}, tracks array<struct<{TRACK}>>", 200)


def feature(track: Track) -> str:
    """Codec, time scale, duration, samples, keyframes, the first and last keyframe's
    range and a digest of all keyframe ranges."""
    spans = [f"{a}+{b}" for a, b in track.keyframes()]
    return (
        f"codec={track.codec};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(spans)};"
        f"first={spans[0] if spans else ''};last={spans[-1] if spans else ''};"
        f"ranges={hashlib.sha256(','.join(spans).encode()).hexdigest()[:16]}"
    )


def media_digests(df: DataFrame, id_col: str, media_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Digests of the stored form and of the first track's samples read back from
    it, and the `feature` of all tracks."""
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (id_col, *more))

    def run(*cols):
        for *kept, m in zip(*cols):
            found = parse(m)
            if not found:
                yield (*kept, None, None, None, None, None, None)
                continue
            payload = samples(m, found[0])
            yield (
                *kept, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                len(m), hashlib.sha256(m).hexdigest(), "|".join(map(feature, found)),
            )

    schema = (
        f"{kinds}payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string"
    )
    return map_rows(df.select(id_col, *more, media_col), lambda: run, schema, 200)
