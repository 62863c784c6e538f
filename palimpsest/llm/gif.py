"""GIF as a media column: writing samples to frames, decoding streams, and timed frames.

The decoder reads any GIF: LZW code streams of every width with early or late clear codes, global
and local palettes, interlacing, transparency, the four disposal rules and frame delays. The encoder
writes streams with growing code tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row, rows in a frame, and how long a frame stands.
WIDTH, FRAME_ROWS, FRAME_CS = 64, 1024, 10
LEVELS = 16


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of at most 255 bytes, each after its length, and the end mark."""
    whole, rest = divmod(len(data), 255)
    rows = np.full((whole, 256), 255, np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8, count=255 * whole).reshape(whole, 255)
    return rows.tobytes() + (bytes([rest]) + data[255 * whole :] if rest else b"") + b"\0"


def _widths(size: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear code, up to the full table."""
    known = (1 << size) + 2 + np.maximum(np.arange(_FULL) - 1, 0)
    return np.clip(np.ceil(np.log2(known + 1)), size + 1, 12).astype(np.int64)


#: Codes after a clear code, at most, until the code table is full and the next one is cleared again.
_FULL = 4096


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 1 << size: a code table that grows with each code written, and
    is cleared when its 4,096 places are taken."""
    clear = 1 << size
    codes, table, free, run = [], {}, clear + 2, -1
    ends = []  # places of clear codes
    for s in samples:
        if run < 0:
            run = s
            continue
        longer = run << 8 | s
        code = table.get(longer)
        if code is not None:
            run = code
            continue
        codes.append(run)
        if free < 4096:
            table[longer] = free
            free += 1
        else:
            ends.append(len(codes))
            codes.append(clear)
            table, free = {}, clear + 2
        run = s
    if run >= 0:
        codes.append(run)
    codes.append(clear + 1)
    value = np.array([clear, *codes], np.int64)
    first = np.concatenate([[0], np.array(ends, np.int64) + 1])
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    bits = np.concatenate([[size + 1], _widths(size)[place]])
    at = np.cumsum(bits) - bits
    shifted, byte = value << (at & 7), at >> 3
    total = -(-int(at[-1] + bits[-1]) // 8)
    return sum(np.bincount(byte + i, shifted >> 8 * i & 255, total + 3) for i in range(3)).astype(np.uint8)[:total].tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> np.ndarray:
    """At most `most` samples of a code stream. The widths of the codes after a clear code depend on
    their number alone, so that codes are unpacked as arrays, a table at a time; a code then copies
    the samples of the code before its entry, and the one that follows them."""
    clear, raw = 1 << size, np.zeros(len(data) + 3, np.uint32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    widths = _widths(size)
    begins = np.cumsum(widths) - widths
    out, bit, end = bytearray(), 0, 8 * len(data)
    while len(out) < most and bit < end:
        codes: list[int] = []
        start, closed = bit, False
        while not closed:  # a full table may stay for any number of codes of 12 bits
            at = begins if bit == start else np.arange(_FULL) * 12
            room = widths if bit == start else np.full(_FULL, 12)
            n = int(np.searchsorted(at + room, end - bit, "right"))
            if not n:
                break
            at = at[:n] + bit
            got = (three[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << room[:n]) - 1).astype(np.uint32)
            marks = np.flatnonzero((got == clear) | (got == clear + 1))
            closed = len(marks) > 0
            last = int(marks[0]) if closed else n - 1
            codes += got[: last + (not closed)].tolist()
            bit = int(at[last] + room[last])
        _expand(codes, clear, out)
        if not closed or got[last] == clear + 1:
            break
    return np.frombuffer(bytes(out[:most]), np.uint8)


def _expand(codes: list[int], clear: int, out: bytearray) -> None:
    begin, size = [], []
    for c in codes:
        start = len(out)
        if c < clear:
            out.append(c)
            n = 1
        else:
            c -= clear + 2
            if c >= len(begin):
                raise ValueError("broken code stream")
            p, n = begin[c], size[c] + 1
            out += out[p : p + n]
            if len(out) - start < n:  # the entry that this very code completes
                out.append(out[start])
        begin.append(start)
        size.append(n)


GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


def write_gif(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = FRAME_CS) -> bytes:
    """payload, a multiple of width, as grey samples in frames of at most rows rows."""
    samples = np.frombuffer(payload, np.uint8)
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GRAY.tobytes()]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        stream = lzw_encode(part.tobytes())
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(stream)]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray = field(repr=False)  #: rgba of the whole screen while the frame stands

    def pixels(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order, each with the screen as it looks while the frame stands: transparent
    samples leave what was there, and what a frame leaves follows its disposal rule."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None

    def palette(at: int, bits: int) -> tuple[np.ndarray, int]:
        n = 3 << (bits + 1)
        rgba = np.full((256, 4), 255, np.uint8)
        rgba[:, :3] = 0
        rgba[: n // 3, :3] = np.frombuffer(data, np.uint8, count=n, offset=at).reshape(-1, 3)
        return rgba, at + n

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    if packed & 0x80:
        common, at = palette(at, packed & 7)
    screen = np.zeros((height, width, 4), np.uint8)
    disposal, delay, transparent, start = 0, 0, None, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
            _, at = joined(at + 2)
            continue
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at, colours = at + 10, common
        if packed & 0x80:
            colours, at = palette(at, packed & 7)
        size = data[at]
        stream, at = joined(at + 1)
        found = lzw_decode(stream, size, w * h)
        index = np.zeros(w * h, np.uint8)
        index[: len(found)] = found
        index = index.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = screen.copy() if disposal == 3 else None
        area = screen[top : top + h, left : left + w]
        index = index[: area.shape[0], : area.shape[1]]
        if transparent is None:
            area[:] = colours[index]
        else:
            seen = index != transparent
            area[seen] = colours[index[seen]]
        yield Frame(left, top, area.shape[1], area.shape[0], start, delay, disposal, transparent, screen.copy())
        start += delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            screen = before
        disposal, delay, transparent = 0, 0, None


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by colour, two bits of each of red, green and blue."""
    flat = rgba.reshape(-1, 4)
    packed = (flat[:, 0] >> 6) << 4 | (flat[:, 1] >> 6) << 2 | flat[:, 2] >> 6
    return np.bincount(packed[flat[:, 3] > 0], minlength=64)


def timed(raw: bytes) -> Iterator[tuple[int, int, int, Frame, np.ndarray]]:
    """Number, start and duration in ms, frame, and colour histogram of the frame's own pixels."""
    for k, f in enumerate(read_gif(raw)):
        yield k, 10 * f.start_cs, 10 * f.delay_cs, f, histogram(f.pixels())


def store(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_bytes and media: each whole text's UTF-8 bytes (null: none), with bytes 0 up to a
    positive multiple of 64, as a GIF of 8-bit samples."""
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(len(keys)).to_pylist()
                media = [write_gif(x + bytes((-len(x)) % WIDTH if x else WIDTH)) for x in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=[*keys, "n_bytes", "media"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_bytes bigint", "media binary"]))


def frames(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each frame: keep, frame, start_ms, duration_ms, width, height, rgba (the screen
    while the frame stands) and histogram (64 counts by colour of the frame's own pixels). Null media
    have no frames; bytes that are no GIF are an error. Rows may be repeated, keys null."""
    rows = media.select(*keep, F.col(column).alias("_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "frame", "start_ms", "duration_ms", "width", "height", "rgba", "histogram"]
        for batch in batches:
            for i, raw in enumerate(batch.column(len(keep))):
                for k, start, ms, f, counts in timed(raw.as_py()) if raw.is_valid else ():
                    h, w = f.canvas.shape[:2]
                    more = [pa.array([x], pa.int64()) for x in (k, start, ms, w, h)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(len(keep))), *more, pa.array([f.canvas.tobytes()], pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "frame bigint, start_ms bigint, duration_ms bigint, width bigint, height bigint, rgba binary, histogram array<bigint>"]))


def digests(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep and what the stored bytes, read back frame by frame, hold: payload_bytes,
    payload_sha256, tail_crc32 (of the last 64), media_bytes, media_sha256 and feature (frames,
    time and the summed colour histogram). Null media give nulls; bytes that are no GIF are an error.
    Rows may be repeated, keys null."""
    rows = media.select(*keep, F.col(column).alias("_media"))

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        samples, counts, ms, n = [], np.zeros(64, np.int64), 0, 0
        for k, start, took, f, colours in timed(raw):
            samples.append(f.pixels()[..., 0].tobytes())
            counts += colours
            ms, n = start + took, k + 1
        payload = b"".join(samples)
        shown = ",".join(f"{i}:{c}" for i, c in enumerate(counts.tolist()) if c)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={n};ms={ms};rgb={shown}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 6, kinds, strict=True))], names=[*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"]))
