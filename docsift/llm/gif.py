"""GIF media columns: texts stored losslessly as the pixels of timed GIF frames, and any GIF read back.

The decoder takes GIF87a and GIF89a: LZW code streams of any minimum size with early or deferred clear codes, global and
local palettes, interlacing, transparency, the disposal methods (keep, background, previous) and delays. A decoded frame
is the composed canvas. The encoder writes 24 pixels a row, up to 240 rows a frame, with a grey ramp as palette.

Defined results: a null text is empty; every payload is filled with bytes 255 to a positive multiple of 576 (24 x 24);
texts of any length become more frames; repeated rows give equal values; bytes that are no GIF raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec

WIDTH = 24
UNIT = WIDTH * WIDTH
FRAME_ROWS = 240
DELAY_CS = 4
_FULL = 4096


def _widths(clear: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code (the clear or end code that follows included)."""
    most = np.minimum(clear + 1 + np.arange(n), _FULL - 1)
    return np.maximum(np.floor(np.log2(np.maximum(most, 1))).astype(np.int64) + 1, int(clear).bit_length())


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = [clear]
    runs = [1]  # codes between clear codes, each run with the clear or end code that closes it
    if data:
        table: dict[int, int] = {}
        find, put, free, before = table.get, codes.append, end + 1, 1
        rest = iter(data)
        current = next(rest)
        for byte in rest:
            key = current << 8 | byte
            code = find(key)
            if code is not None:
                current = code
                continue
            put(current)
            current = byte
            table[key] = free
            free += 1
            if free == _FULL:
                put(clear)
                table.clear()
                free = end + 1
                runs.append(len(codes) - before)
                before = len(codes)
        codes += [current, end]
        runs.append(len(codes) - before)
    if len(runs) == 1:
        codes.append(end)
        runs.append(1)
    w = np.concatenate([_widths(clear, n) for n in runs])
    w[0] = bits + 1
    offsets = np.concatenate([[0], np.cumsum(w)])
    shifted = np.array(codes, np.int64) << (offsets[:-1] & 7)
    size = (int(offsets[-1]) + 7) >> 3
    out = np.zeros(size + 3, np.int64)
    for k in range(3):
        np.add.at(out, (offsets[:-1] >> 3) + k, shifted >> (8 * k) & 255)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    at, out = 0, []
    while at + bits + 1 <= total:
        w = _widths(clear, min((total - at) // (bits + 1) + 1, 4200))
        offsets = at + np.concatenate([[0], np.cumsum(w)])
        w = w[: np.searchsorted(offsets[1:], total, "right")]
        offsets = offsets[: len(w)]
        byte = offsets >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offsets & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        values = codes[:n].tolist()
        table = base.copy()
        if values:
            if values[0] >= clear:
                raise ValueError("an LZW stream starts with a code that is no colour")
            previous = base[values[0]]
            out.append(previous)
            add, put, free = table.append, out.append, end + 1
            for c in values[1:]:
                if c < free:
                    text = table[c]
                elif c == free and free < _FULL:
                    text = previous + previous[:1]
                else:
                    raise ValueError("an LZW code is ahead of its table")
                put(text)
                if free < _FULL:
                    add(previous + text[:1])
                    free += 1
                previous = text
        if not len(stop):
            if len(w) < 4200:
                return b"".join(out)
            # the table is full and no clear code came: the codes stay 12 bits wide
            at = int(offsets[-1] + w[-1])
            while at + 12 <= total:
                c = int((raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16) >> (at & 7) & 4095)
                at += 12
                if c == end:
                    return b"".join(out)
                if c == clear:
                    break
                out.append(table[c])
            continue
        at = int(offsets[n] + w[n])
        if codes[n] == end:
            break
    return b"".join(out)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  #: height x width x 3 of the whole screen once this frame is drawn

    def region(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def decode(data: bytes) -> list[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, background, at = data[10], data[11], 13

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n

    colours = None
    if flags & 128:
        colours, at = palette(flags, at)
    fill = colours[background] if colours is not None and background < len(colours) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = fill
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay = block[0] >> 2 & 7, int.from_bytes(block[1:3], "little")
                transparent = block[3] if block[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("a GIF block of unknown kind")
        left, top, w, h = (int.from_bytes(data[at + 1 + 2 * k : at + 3 + 2 * k], "little") for k in range(4))
        flags, at, own = data[at + 9], at + 10, colours
        if flags & 128:
            own, at = palette(flags, at)
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        pixels = np.frombuffer(lzw_decode(stream, bits), np.uint8)
        if len(pixels) < w * h:
            raise ValueError("a GIF frame ends early")
        pixels = pixels[: w * h].reshape(h, w)
        if flags & 64:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            pixels = pixels[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        pixels = pixels[: part.shape[0], : part.shape[1]]
        drawn = own[pixels]
        if transparent is None:
            part[:] = drawn
        else:
            shown = pixels != transparent
            part[shown] = drawn[shown]
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, canvas.copy()))
        if disposal == 2:
            part[:] = fill
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return frames


_GREY = bytes(v for k in range(256) for v in (k, k, k))


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames, one after the other, show the samples as shades of grey."""
    rows = len(samples) // width
    out = [b"GIF89a", width.to_bytes(2, "little"), min(rows, frame_rows).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for row in range(0, rows, frame_rows):
        n = min(frame_rows, rows - row)
        stream = lzw_encode(samples[row * width : (row + n) * width])
        out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), n.to_bytes(2, "little"), b"\0\x08"]
        for k in range(0, len(stream), 255):
            out += [bytes([min(255, len(stream) - k)]), stream[k : k + 255]]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (unit - len(text) if not text else -len(text) % unit)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a GIF."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in vec.pieces(batch.column("text")):
                data = buf.tobytes()
                media = [encode(padded(data[a:b])) for a, b in zip(off, off[1:], strict=False)]
                yield pa.record_batch([batch.column("doc_id")[rows], pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """One row a frame of the GIFs in column ``media``: doc_id, frame, start_cs, delay_cs, width, height, histogram
    (64 colours, two bits a channel, of the composed canvas)."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                got, start, rows = decode(data) if data else [], 0, []
                for k, f in enumerate(got):
                    rows.append((doc, k, start, f.delay_cs, f.width, f.height, _histogram(f.canvas)))
                    start += f.delay_cs
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), *[pa.int32()] * 5, pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "frame", "start_cs", "delay_cs", "width", "height", "histogram"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, start_cs int, delay_cs int, width int, height int, histogram array<bigint>")


def _histogram(canvas: np.ndarray) -> np.ndarray:
    two = canvas.reshape(-1, 3) >> 6
    return np.bincount(two[:, 0] << 4 | two[:, 1] << 2 | two[:, 2], minlength=64)


def read_back(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored GIF holds: payload and media digests, and features of its frames."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                got = decode(data)
                regions = [f.region() for f in got]
                payload = b"".join(r[:, :, 0].tobytes() for r in regions)
                histogram = sum(_histogram(r) for r in regions)[[0, 21, 42, 63]]
                feature = f"frames={len(got)};cs={sum(f.delay_cs for f in got)};size={got[0].canvas.shape[1]}x{got[0].canvas.shape[0]};grey={','.join(map(str, histogram))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
