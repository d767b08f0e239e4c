"""ISO base media files in binary columns: writing lossless 8-bit frames and reading the structure back.

write_media() stores a payload as 8 x 8 frames of one byte per sample ('raw ' video) in ftyp, mdat and
moov boxes; read_media() walks the nested boxes of any such file, decodes the sample tables (stsd, stts,
stss, stsc, stsz, stco or co64) and returns codec, duration and the byte ranges of the key frames.  The payload is never
decoded: the ranges address it.

Cases: a null text is empty and is stored as one frame of zeros; null or repeated ids pass through; an
empty table gives an empty result; a column value that is no such file gives a null struct in media_info(); extra columns
are ignored; repeated rows and equal texts give equal files; files over 4 GB use 64-bit sizes and offsets; a text of any length is one
file, held whole by its task, as a row is; a count of samples that the file can't hold makes it no such file; fragmented files
(moof) have empty sample tables and give no ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import bounded

FRAME = 64
RATE = 25
CHUNK_FRAMES = 256
KEY_EVERY = 32
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def padded(data: bytes) -> bytes:
    """The payload: zeros up to a positive multiple of the frame size."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def write_media(payload: bytes) -> bytes:
    """A media file whose frames are the payload's bytes, 64 each."""
    frames = len(payload) // FRAME
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    data = box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    starts = first + np.arange(0, frames, CHUNK_FRAMES, dtype=np.int64) * FRAME
    wide = first + len(payload) >= 2**32
    offsets = full(b"co64", struct.pack(">I", len(starts)), starts.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", len(starts)), starts.astype(">u4").tobytes())
    last = frames - (len(starts) - 1) * CHUNK_FRAMES
    to_chunk = [(1, min(CHUNK_FRAMES, frames), 1)]
    if len(starts) > 1 and last != CHUNK_FRAMES:
        to_chunk.append((len(starts), last, 1))
    keys = np.arange(1, frames + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, frames, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", *x) for x in to_chunk)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        offsets,
    )
    minf = box(b"minf", full(b"vmhd", bytes(8)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url "))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16))
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return head + data + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray  # of every sample in the file
    keys: np.ndarray  # numbers of the key samples from 0

    def ranges(self, samples: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Byte ranges of the given samples (all if None), neighbours merged."""
        at, n = (self.offsets, self.sizes) if samples is None else (self.offsets[samples], self.sizes[samples])
        if not len(at):
            return []
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + n[:-1]
        ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
        return list(zip(at[new].tolist(), (at + n)[ends].tolist(), strict=True))


#: Sample tables lie five boxes deep; what is nested deeper than this is not walked.
DEEPEST = 8


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, end) of every box, outer before inner; raises ValueError where sizes don't add up."""
    open_ = [(start, end, ())]
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box is longer than its parent")
        yield (*path, kind), body, start + size
        open_.append((start + size, end, path))
        if kind in _NESTED and len(path) + 1 < DEEPEST:
            open_.append((body, start + size, (*path, kind)))


def read_media(data: bytes) -> list[Track]:
    """The tracks of a file; ValueError if it isn't one."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    seen = False
    for path, s, e in walk(data, 0, len(data)):
        seen |= path == (b"ftyp",)
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = (s, e)
    if not seen:
        raise ValueError("no ftyp box")
    try:
        return [_track(data, t) for t in tracks]
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError(f"bad sample tables: {e!r}") from e


def _table(data: bytes, at: tuple[int, int], kind: str, width: int, skip: int = 8) -> np.ndarray:
    s, e = at
    n = struct.unpack_from(">I", data, s + skip - 4)[0]
    size = np.dtype(kind).itemsize
    if s + skip + n * width * size > e:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, kind, n * width, s + skip).reshape(n, width).astype(np.int64)


def _track(data: bytes, t: dict[bytes, tuple[int, int]]) -> Track:
    s, _ = t[b"mdhd"]
    timescale, declared = struct.unpack_from(">IQ", data, s + 20) if data[s] == 1 else struct.unpack_from(">II", data, s + 12)
    codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
    s, _ = t[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, s + 4)
    if fixed * n > len(data):
        raise ValueError("more samples than the file has bytes")
    sizes = np.full(n, fixed, np.int64) if fixed else _table(data, t[b"stsz"], ">u4", 1, 12)[:, 0]
    chunks = (_table(data, t[b"stco"], ">u4", 1) if b"stco" in t else _table(data, t[b"co64"], ">u8", 1))[:, 0]
    groups = _table(data, t[b"stsc"], ">u4", 3)
    per_chunk = np.zeros(len(chunks), np.int64)
    for i, (first, count, _) in enumerate(groups.tolist()):
        per_chunk[first - 1 : groups[i + 1, 0] - 1 if i + 1 < len(groups) else None] = count
    if per_chunk.sum() != n:
        raise ValueError("chunks and samples don't agree")
    before = np.cumsum(sizes) - sizes
    head = np.cumsum(per_chunk) - per_chunk
    which = np.repeat(np.arange(len(chunks)), per_chunk)
    offsets = chunks[which] + before - before[head[which]] if n else before
    times = _table(data, t[b"stts"], ">u4", 2)
    duration = int((times[:, 0] * times[:, 1]).sum()) or declared
    keys = _table(data, t[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
    return Track(codec, timescale, duration, sizes, offsets, keys)


def payload_of(data: bytes, track: Track) -> bytes:
    """The samples' bytes, laid end to end."""
    return b"".join(data[s:e] for s, e in track.ranges())


def feature_of(track: Track) -> str:
    """codec, duration in seconds, frames, key frames and a digest of their byte ranges."""
    spans = ",".join(f"{s}-{e}" for s, e in track.ranges(track.keys))
    return f"codec={track.codec.strip()};duration={track.duration / track.timescale:.2f};frames={len(track.sizes)};keys={len(track.keys)};ranges_crc32={zlib.crc32(spans.encode())}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, key_ranges array<struct<start:long,end:long>>, media binary"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = True) -> DataFrame:
    """Stores every whole text as a media file, reads the file back, and returns digests of payload and file, features, the byte ranges of the key frames, and (if media is set) the file."""

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("key_ranges", span), ("media", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                stored = write_media(padded(raw))
                track = read_media(stored)[0]
                back = payload_of(stored, track)
                rows.append((key.as_py(), len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(track), [{"start": s, "end": e} for s, e in track.ranges(track.keys)], stored if media else None))
                held += len(stored) * media
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(work, OUT)


INFO = "media_codec string, media_seconds double, media_frames long, media_key_ranges array<struct<start:long,end:long>>"


def media_info(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Codec, seconds, samples and key frame ranges of the first track of every file in a binary column; nulls where it can't be read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column("media"):
                try:
                    t = read_media(value.as_py() or b"")[0]
                    rows.append((t.codec.strip(), t.duration / t.timescale, len(t.sizes), [{"start": s, "end": e} for s, e in t.ranges(t.keys)]))
                except (ValueError, IndexError, ZeroDivisionError):
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), span), strict=True))], names=["id", *(x.split()[0] for x in INFO.replace("array<struct<start:long,end:long>>", "x").split(", "))])

    plain = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return plain.mapInArrow(work, f"id {plain.schema['id'].dataType.simpleString()}, {INFO}").withColumnRenamed("id", id_col)
