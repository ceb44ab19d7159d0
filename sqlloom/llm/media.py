"""Media columns: payloads as motion-JPEG in AVI, and the clips found in them.

A payload (a text's bytes, filled with bytes 255 to a multiple of 576) becomes
frames of 24 x 24 samples.  Each sample is one 8 x 8 block of constant value
in a baseline grey JPEG of 192 x 192 pixels: only DC terms are stored, with a
quantiser of 8, so decoding is exact.  Frames are ``00dc`` chunks of an AVI
file with an ``idx1`` index.

Reading goes by the file alone: RIFF chunks and the index are parsed (files
without an index are walked chunk by chunk).  Frames of the form written here
are decoded in lockstep, all of a batch together (one table look-up gives length
and difference of a block); any other baseline JPEG goes through ``jpeg.luminance``.
Shots are cut where the difference of neighbouring 16-bin histograms exceeds
mean + 2.5 deviations of its surroundings.

Defined results: a null text counts as empty and is one frame of 255s;
repeated rows and ids each give a row, and equal texts equal values; a very long
text is a long file; an empty table gives an empty table; other columns are ignored,
whatever their names.  A file that is null, damaged, without frames or of a kind
that is not read gives one row of nulls with the reason in ``error``.  Rows
are independent, so nothing is shuffled; a batch holds a bounded number of frames
beyond its longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole
from .jpeg import luminance

SIDE, UNIT, FPS, BINS = 24, 576, 25, 16
#: Frames that are coded or decoded together.
AT_ONCE = 2048
PIXELS = SIDE * 8
#: Fixed values of the frame's Huffman tables: DC categories 0 to 8 with codes of 4 bits; end of block with a code of 1 bit.
DC_BITS, DC_LENGTH = bytes([0, 0, 0, 9] + [0] * 12), 4
AC_BITS = bytes([1] + [0] * 15)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


HEAD = b"".join((
    b"\xff\xd8",
    _segment(0xDB, b"\x00" + bytes([8] * 64)),
    _segment(0xC0, struct.pack(">BHHB", 8, PIXELS, PIXELS, 1) + b"\x01\x11\x00"),
    _segment(0xC4, b"\x00" + DC_BITS + bytes(range(9))),
    _segment(0xC4, b"\x10" + AC_BITS + b"\x00"),
    _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
))
TAIL = b"\xff\xd9"


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or UNIT * (not text))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, 576)."""
    n = len(samples)
    value = samples.astype(np.int32) - 128
    diff = np.diff(value, axis=1, prepend=0)
    size = np.abs(diff)
    category = np.zeros(size.shape, np.int32)
    for k in range(8):
        category += size >= 1 << k
    bits = np.where(diff < 0, diff + (1 << category) - 1, diff)
    code = (category << category | bits) << 1  # and the 0 of the end of block
    length = category + DC_LENGTH + 1
    end = np.cumsum(length, axis=1)
    used = end[:, -1]
    per = (used + 7) >> 3
    base = np.cumsum(per) - per
    at = end - length
    code <<= 24 - (at & 7) - length
    byte = (base[:, None] + (at >> 3)).ravel()
    code = code.ravel()
    total = int(per.sum())
    out = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, (code >> shift) & 255, total + 2)
    out = out[:total].astype(np.uint8)
    out[base + per - 1] |= ((1 << (-used & 7)) - 1).astype(np.uint8)
    # a byte 255 is followed by a 0
    full = out == 255
    moved = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(total + int(moved[-1]), np.uint8)
    stuffed[np.arange(total) + moved[:-1]] = out
    cut = (np.append(base, total) + moved[np.append(base, total)]).tolist()
    raw = stuffed.tobytes()
    return [HEAD + raw[cut[i] : cut[i + 1]] + TAIL for i in range(n)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, PIXELS, PIXELS, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, PIXELS, PIXELS)
    form = struct.pack("<IiiHH4sIiiII", 40, PIXELS, PIXELS, 1, 8, b"MJPG", PIXELS * PIXELS, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, index = 4, []
    for f, c in zip(frames, chunks, strict=True):
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames of the first video stream that the index names, in its order, and the frames a second."""
    try:
        return _read_avi(data)
    except (struct.error, KeyError, ZeroDivisionError, IndexError) as e:
        raise ValueError("a damaged AVI file") from e


def _chunks(data: bytes, at: int, end: int):
    """kind, place and size of the chunks in a part of the file; a list's kind is its own name."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield data[at + 8 : at + 12] if kind == b"LIST" else kind, at + 8, size
        at += 8 + size + (size & 1)


def _read_avi(data: bytes) -> tuple[list[bytes], float]:
    kind, size, form = struct.unpack_from("<4sI4s", data)
    if kind != b"RIFF" or form != b"AVI " or size + 8 > len(data):
        raise ValueError("not an AVI file")
    found = {kind: (at, size) for kind, at, size in _chunks(data, 12, size + 8)}
    start, size = found[b"hdrl"]
    streams = [(at, n) for kind, at, n in _chunks(data, start + 4, start + size) if kind == b"strl"]
    heads = [at for place, n in streams for kind, at, _ in _chunks(data, place + 4, place + n) if kind == b"strh"]
    video = next((i for i, at in enumerate(heads) if data[at : at + 4] == b"vids"), None)
    if video is None:
        raise ValueError("no video stream")
    scale, ticks = struct.unpack_from("<II", data, heads[video] + 20)
    own = (b"%02ddc" % video, b"%02ddb" % video)
    movi, size = found[b"movi"]
    if b"idx1" not in found:
        return [data[at : at + n] for kind, at, n in _chunks(data, movi + 4, movi + size) if kind in own], ticks / scale
    start, size = found[b"idx1"]
    frames = []
    for kind, _, offset, n in struct.iter_unpack("<4s3I", data[start : start + size - size % 16]):
        if kind in own and n:
            # offsets count from the list's name, or from the file's start
            at = next((k for k in (movi + offset, offset) if data[k : k + 8] == struct.pack("<4sI", kind, n)), None)
            if at is None:
                raise ValueError("the index does not fit the chunks")
            frames.append(data[at + 8 : at + 8 + n])
    return frames, ticks / scale


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For 13 bits: how many make the next block, and its DC difference; length 0 where they are no block."""
    x = np.arange(1 << 13)
    category = x >> 9
    held = np.minimum(category, 8)
    bits = x >> (9 - held) & (1 << held) - 1
    closed = (x >> (8 - held) & 1) == 0
    negative = (held > 0) & (bits < 1 << np.maximum(held - 1, 0))
    return np.where((category <= 8) & closed, category + DC_LENGTH + 1, 0), np.where(negative, bits - (1 << held) + 1, bits)


LENGTH, DIFFERENCE = (t.astype(np.int64) for t in _tables())


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, 576) of DC-only frames as encode_frames makes them; all frames advance together, block by block."""
    n = len(frames)
    if any(not f.startswith(HEAD) or not f.endswith(TAIL) for f in frames):
        raise ValueError("not a frame of this kind")
    scans = b"".join(f[len(HEAD) : -2] + b"\x00\x00\x00" for f in frames)
    raw = np.frombuffer(scans, np.uint8)
    size = np.fromiter((len(f) - len(HEAD) + 1 for f in frames), np.int64, n)
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[:-1] == 255) & (raw[1:] == 0))
    gone = np.concatenate([[0], np.cumsum(~keep)])
    start = np.cumsum(size) - size
    start -= gone[start]
    raw = np.append(raw[keep], np.zeros(3, np.uint8)).astype(np.int32)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at = start << 3
    out = np.empty((UNIT, n), np.int32)
    for i in range(UNIT):
        x = ((window[at >> 3] << (at & 7)) & 0xFFFFFF) >> 11
        step = LENGTH[x]
        if not step.all():
            raise ValueError("not a block of this kind")
        out[i] = DIFFERENCE[x]
        at += step
    return (np.cumsum(out, axis=0) + 128).astype(np.uint8).T


def histograms(samples: np.ndarray) -> np.ndarray:
    """Shares of 16 grey levels in each frame; samples: (frames, samples of a frame)."""
    n, size = samples.shape
    return np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / size


def shots(h: np.ndarray, reach: int = 8, deviations: float = 2.5, least: float = 0.12) -> list[tuple[int, int]]:
    """Frame ranges (first, beyond the last) between cuts, from the frames' histograms."""
    n = len(h)
    if n < 3:
        return [(0, n)]
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    m = len(d)
    lo, hi = np.maximum(np.arange(m) - reach, 0), np.minimum(np.arange(m) + reach + 1, m)
    one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    count = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / count
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / count - mean * mean, 0))
    cuts = [0, *(np.flatnonzero((d > mean + deviations * spread) & (d > least)) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: each text's payload as an AVI file."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(_stored(texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _stored(texts: list[bytes]) -> list[bytes]:
    payloads = [payload(t) for t in texts]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    frames = [f for k in range(0, len(samples), AT_ONCE) for f in encode_frames(samples[k : k + AT_ONCE])]
    out, at = [], 0
    for p in payloads:
        out.append(write_avi(frames[at : at + len(p) // UNIT]))
        at += len(p) // UNIT
    return out


def _read(media: list[bytes]) -> list[tuple[np.ndarray, float]]:
    parsed = [read_avi(m) for m in media]
    frames = [f for frames, _ in parsed for f in frames]
    samples = np.concatenate([decode_frames(frames[k : k + AT_ONCE]) for k in range(0, len(frames), AT_ONCE)]) if frames else None
    at, out = 0, []
    for frames, rate in parsed:
        out.append((samples[at : at + len(frames)], rate))
        at += len(frames)
    return out


def _histograms_of(media: bytes | None) -> tuple[np.ndarray, float]:
    """Histograms of the frames of any motion-JPEG file, and its frames a second."""
    if media is None:
        raise ValueError("no file")
    frames, rate = read_avi(media)
    if not frames:
        raise ValueError("no frames")
    if all(f.startswith(HEAD) for f in frames):
        return np.concatenate([histograms(decode_frames(frames[k : k + AT_ONCE])) for k in range(0, len(frames), AT_ONCE)]), rate
    return np.concatenate([histograms(luminance(f).reshape(1, -1)) for f in frames]), rate


CLIP = "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, error string"


def clips(media: DataFrame) -> DataFrame:
    """One row for each shot of motion-JPEG files (doc_id, media): doc_id, clip, first_frame, frames, start_s, end_s, error (null)."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, m in zip(b["doc_id"].to_pylist(), b["media"].to_pylist(), strict=True):
                try:
                    h, rate = _histograms_of(m)
                    rows += [(i, k, a, z - a, a / rate, z / rate, None) for k, (a, z) in enumerate(shots(h))]
                except ValueError as e:
                    rows.append((i, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in CLIP.split(", ")])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, CLIP)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests, feature (frames, and the first frame of each clip); the payload is what the stored file gives back."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b["text"].to_pylist()]
            media = _stored(texts)
            rows = []
            for i, t, m, (s, rate) in zip(b["doc_id"].to_pylist(), texts, media, _read(media), strict=True):
                p = np.ascontiguousarray(s).tobytes()
                found = shots(histograms(s))
                feature = f"frames={len(s)};fps={rate:g};clips={','.join(str(a) for a, _ in found)}"
                rows.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), whole().alias("text")).mapInArrow(run, DIGEST)
