"""GIF media columns: a whole-format decoder, timed frames and colour histograms.

The decoder reads LZW code streams of any legal code size, global and local palettes,
interlacing, transparency, disposal and delays, and returns each frame as it is shown.
The encoder writes true LZW streams.  :func:`store_payload` puts arbitrary bytes into
the 8-bit samples of an image 64 wide, under the grey palette that maps each index to
itself, and :func:`read_payload` gets them back from the shown frames.  A payload of
over ``FRAME_ROWS`` rows becomes timed frames, each cleared before the next.

Defined results
* null or empty texts are one row of 64 zero samples;
* damaged or null media, and media whose screen has over ``MAX_PIXELS`` pixels, give one
  row with an ``error`` from :func:`decode_media`, after the frames shown before the damage;
* equal texts give equal values; repeated rows stay repeated rows;
* extra columns are never read.

Scale: map-only.  A task holds one text or one medium at a time, and one of its frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship_package, small_batches

WIDTH = 64
#: Rows of 64 samples in a frame of a stored payload; the format allows 65,535.
FRAME_ROWS = 512
#: Media with a larger screen give an error: a header of 13 bytes may claim 17 GB.
MAX_PIXELS = 1 << 26
#: Fixed value of the format: codes have at most 12 bits.
TABLE = 4096
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


class GifError(ValueError):
    """The bytes are not a legal image."""


@dataclass
class Frame:
    index: int
    delay_ms: int
    disposal: int
    transparent: int | None
    pixels: np.ndarray  # rows x columns x RGBA, as shown


# --- LZW -------------------------------------------------------------------


@lru_cache(maxsize=8)
def _bit_starts(min_size: int) -> np.ndarray:
    """Bit offset of the i-th code after a clear code, and past the last that can add an entry."""
    added = np.maximum(np.arange(TABLE + 1) - 1, 0) + (1 << min_size) + 2
    width = np.full(len(added), min_size + 1)
    for bits in range(min_size + 1, 12):
        width += added >= (1 << bits)
    return np.concatenate([[0], np.cumsum(width)])


def lzw_compress(samples: bytes, min_size: int = 8) -> bytes:
    """The code stream of the samples, with a clear code whenever the table is full."""
    clear = 1 << min_size
    first = clear + 2
    segments: list[list[int]] = [[]]
    codes = segments[0]
    if samples:
        table: dict[int, int] = {}
        known = table.get
        free = first
        rest = iter(samples)
        prefix = next(rest)
        for s in rest:
            key = prefix << 8 | s
            code = known(key)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            prefix = s
            if free < TABLE:
                table[key] = free
                free += 1
            else:
                codes.append(clear)
                codes = []
                segments.append(codes)
                table.clear()
                free = first
        codes.append(prefix)
    codes.append(clear + 1)
    starts = _bit_starts(min_size)
    offsets, base = [np.zeros(1, np.int64)], min_size + 1
    for part in segments:
        offsets.append(base + starts[: len(part)])
        base += int(starts[len(part)])
    bits = np.concatenate(offsets)
    values = np.array([clear, *(c for part in segments for c in part)], np.uint32) << (bits & 7).astype(np.uint32)
    at = bits >> 3
    out = np.zeros(len(values) * 2 + 8, np.uint8)
    for byte in range(3):  # codes don't share bits, so adding is joining
        np.add.at(out, at + byte, (values >> np.uint32(8 * byte)).astype(np.uint8))
    return out[: (base + 7) >> 3].tobytes()


def lzw_expand(stream: bytes, min_size: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream; the end code or the end of the stream ends it."""
    if not 1 <= min_size <= 11:
        raise GifError(f"code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    starts = _bit_starts(min_size)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total_bits = len(stream) * 8
    out: list[bytes] = []
    made, position, ended = 0, 0, False
    while not ended and made < limit:
        # All codes up to the next clear code have widths known from their place alone.
        parts: list[np.ndarray] = []
        place = 0
        while True:
            if place < TABLE:
                most = min(TABLE, place + 2 + (total_bits - position) // (min_size + 1))
                bits = position + starts[place : most + 1] - starts[place]
            else:
                bits = position + 12 * np.arange(min(TABLE, 2 + (total_bits - position) // 12) + 1)
            n = int(np.searchsorted(bits[1:], total_bits, "right"))
            if not n:
                ended = True
                break
            at = bits[:n] >> 3
            word = raw[at] | raw[at + 1] << np.uint32(8) | raw[at + 2] << np.uint32(16)
            codes = ((word >> (bits[:n] & 7).astype(np.uint32)) & ((np.uint32(1) << np.diff(bits[: n + 1]).astype(np.uint32)) - np.uint32(1))).astype(np.int64)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops):
                stop = int(stops[0])
                parts.append(codes[:stop])
                position = int(bits[stop + 1])
                ended = int(codes[stop]) == end
                break
            parts.append(codes)
            position = int(bits[n])
            place = min(place + n, TABLE)
        segment = _expand_segment(np.concatenate(parts) if parts else np.zeros(0, np.int64), clear, limit - made)
        out.append(segment)
        made += len(segment)
    return b"".join(out)


def _expand_segment(codes: np.ndarray, clear: int, limit: int) -> bytes:
    """The samples of the codes between two clear codes.

    Entry k is what code k gave and the sample after it, so each code of an entry copies
    an earlier stretch of the output; chains of copies are halved until they end in literals.
    """
    if not len(codes):
        return b""
    entry = codes - (clear + 2)
    order = np.arange(len(codes))
    if (entry >= order).any():
        raise GifError("a code before its entry")
    literal = entry < 0
    parent = np.where(literal, order, entry)
    length = np.where(literal, 0, 1)
    while True:  # steps to the literal at the end of the chain of entries
        further = length[parent]
        if not further.any():
            break
        length = length + further
        parent = parent[parent]
    length += 1
    ends = np.cumsum(length)
    if ends[-1] > limit:
        keep = int(np.searchsorted(ends, limit, "left")) + 1
        codes, entry, literal, length, ends = codes[:keep], entry[:keep], literal[:keep], length[:keep], ends[:keep]
    begin = ends - length
    back = np.where(literal, 0, begin[np.where(literal, 0, entry)] - begin)
    source = np.arange(int(ends[-1])) + np.repeat(back, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    values = np.zeros(len(source), np.uint8)
    values[begin[literal]] = codes[literal]
    return values[source[:limit]].tobytes()


# --- container ---------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([min(255, len(data) - i)]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _palette_bytes(palette: np.ndarray) -> tuple[int, bytes]:
    bits = max(1, int(len(palette) - 1).bit_length())
    return bits, np.vstack([palette, np.zeros(((1 << bits) - len(palette), 3), np.uint8)]).astype(np.uint8).tobytes()


def encode(frames: list[dict], palette: np.ndarray = GREY, size: tuple[int, int] | None = None) -> bytes:
    """Media bytes of frames given as ``indices`` (rows x columns) and, if wanted, ``left``,
    ``top``, ``delay_ms``, ``disposal``, ``transparent``, ``palette`` and ``interlace``."""
    rows = size[0] if size else max(f["indices"].shape[0] + f.get("top", 0) for f in frames)
    columns = size[1] if size else max(f["indices"].shape[1] + f.get("left", 0) for f in frames)
    bits, colours = _palette_bytes(palette)
    out = [b"GIF89a", columns.to_bytes(2, "little"), rows.to_bytes(2, "little"), bytes([0x80 | 0x70 | bits - 1, 0, 0]), colours]
    for f in frames:
        indices = np.asarray(f["indices"], np.uint8)
        clear = f.get("transparent")
        out.append(b"\x21\xf9\x04" + bytes([f.get("disposal", 0) << 2 | (clear is not None)]) + (f.get("delay_ms", 0) // 10).to_bytes(2, "little") + bytes([clear or 0, 0]))
        local = f.get("palette")
        flags, own = (0, b"") if local is None else (lambda p: (0x80 | p[0] - 1, p[1]))(_palette_bytes(local))
        if f.get("interlace"):
            flags |= 0x40
            indices = indices[_interlaced(indices.shape[0])]
        out.append(b"\x2c" + b"".join(int(x).to_bytes(2, "little") for x in (f.get("left", 0), f.get("top", 0), indices.shape[1], indices.shape[0])) + bytes([flags]) + own)
        code_size = max(2, int(indices.max(initial=0)).bit_length())
        out.append(bytes([code_size]) + _sub_blocks(lzw_compress(indices.tobytes(), code_size)))
    return b"".join(out) + b"\x3b"


def _interlaced(rows: int) -> np.ndarray:
    """The rows in the order of the format's four passes."""
    return np.concatenate([np.arange(first, rows, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The frames of an image as they are shown, in order; damage raises :class:`GifError`."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise GifError("no GIF header")
    view = memoryview(media)
    columns, rows = int.from_bytes(view[6:8], "little"), int.from_bytes(view[8:10], "little")
    if columns * rows > max_pixels:
        raise GifError(f"a screen of {columns} x {rows}")
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        if at + 3 * n > len(media):
            raise GifError("palette cut short")
        table = np.frombuffer(view[at : at + 3 * n], np.uint8).reshape(n, 3)
        at += 3 * n
        return table

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(media):
                raise GifError("blocks cut short")
            n = view[at]
            if not n:
                at += 1
                return b"".join(parts)
            if at + 1 + n > len(media):
                raise GifError("blocks cut short")
            parts.append(view[at + 1 : at + 1 + n])
            at += 1 + n

    shared = colours(view[10])
    canvas = np.zeros((rows, columns, 4), np.uint8)
    disposal, delay, clear, index = 0, 0, None, 0
    while True:
        if at >= len(media):
            raise GifError("no trailer")
        kind = view[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            if at >= len(media):
                raise GifError("extension cut short")
            label = view[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(media):
            raise GifError(f"block {kind}")
        left, top, wide, high = (int.from_bytes(view[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
        flags = view[at + 8]
        at += 9
        if left + wide > columns or top + high > rows:
            raise GifError("frame outside the screen")
        palette = colours(flags)
        palette = shared if palette is None else palette
        if palette is None or at >= len(media):
            raise GifError("no palette or no image data")
        code_size = view[at]
        at += 1
        samples = np.frombuffer(lzw_expand(blocks(), code_size, wide * high), np.uint8)
        if len(samples) < wide * high:
            raise GifError("image data cut short")
        samples = samples.reshape(high, wide)
        if flags & 0x40:
            straight = np.empty_like(samples)
            straight[_interlaced(high)] = samples
            samples = straight
        if int(samples.max(initial=0)) >= len(palette):
            raise GifError("sample outside the palette")
        before = canvas.copy() if disposal == 3 else None
        place = canvas[top : top + high, left : left + wide]
        if clear is None:
            place[..., :3] = palette[samples]
            place[..., 3] = 255
        else:
            seen = samples != clear
            place[seen] = np.concatenate([palette[samples[seen]], np.full((int(seen.sum()), 1), 255, np.uint8)], axis=1)
        yield Frame(index, delay, disposal, clear, canvas.copy())
        if disposal == 2:
            place[...] = 0
        elif before is not None:
            canvas = before
        index, disposal, delay, clear = index + 1, 0, 0, None


# --- columns -----------------------------------------------------------------


def colour_histogram(pixels: np.ndarray, levels: int = 4) -> np.ndarray:
    """Counts of opaque pixels by red, green and blue level."""
    shown = pixels[pixels[..., 3] > 0][:, :3].astype(np.int64) * levels // 256
    return np.bincount((shown[:, 0] * levels + shown[:, 1]) * levels + shown[:, 2], minlength=levels**3)


def store_payload(payload: bytes, delay_ms: int = 100) -> bytes:
    """Media whose shown frames have the payload's bytes as grey samples, row by row."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [samples[i : i + FRAME_ROWS] for i in range(0, len(samples), FRAME_ROWS)]
    return encode([{"indices": p, "delay_ms": delay_ms, "disposal": 2 if len(parts) > 1 else 0} for p in parts])


def shown_rows(frame: Frame) -> np.ndarray:
    """The samples of a stored payload's frame: a cleared canvas is transparent, so opaque rows are the frame's own."""
    return frame.pixels[frame.pixels[:, 0, 3] > 0][..., 0]


def read_payload(media: bytes) -> bytes:
    return b"".join(shown_rows(f).tobytes() for f in decode(media))


def padded(raw: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text stored as an image."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            raws = [x.encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array([store_payload(padded(x)) for x in raws], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAME_SCHEMA = "media_id long, frame int, delay_ms int, n_rows int, n_columns int, pixels binary, histogram array<long>, error string"


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per shown frame: time, size, RGBA pixels and a 4 x 4 x 4 colour histogram.

    Media that can't be decoded, null included, gives one row with an error; frames shown
    before the damage are kept.
    """
    ship_package(media.sparkSession)
    names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for f in decode(raw or b"", max_pixels):
                        yield row(key, f.index, f.delay_ms, f.pixels.shape[0], f.pixels.shape[1], f.pixels.tobytes(), colour_histogram(f.pixels).tolist(), None)
                except GifError as e:
                    yield row(key, None, None, None, None, None, None, str(e))

    return media.select(F.col(f"`{id_col}`").cast("long").alias("media_id"), F.col(f"`{media_col}`").alias("media")).mapInArrow(run, FRAME_SCHEMA)


DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, duration_ms long, frames array<struct<frame:int,start_ms:int,delay_ms:int,n_rows:int,histogram:array<long>>>"
)
_FRAMES = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int32()), ("delay_ms", pa.int32()), ("n_rows", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def media_digest(raw: bytes) -> tuple:
    """What :data:`DIGEST_SCHEMA` tells of a text's bytes, from the stored media read back.

    The feature is the colour histogram of all frames: cell and count of those that occur.
    """
    media = store_payload(padded(raw))
    parts, frames, time, total = [], [], 0, 0
    for f in decode(media):
        rows, cells = shown_rows(f), colour_histogram(f.pixels)
        parts.append(rows.tobytes())
        frames.append({"frame": f.index, "start_ms": time, "delay_ms": f.delay_ms, "n_rows": len(rows), "histogram": cells.tolist()})
        time, total = time + f.delay_ms, total + cells
    payload = b"".join(parts)
    return (
        len(raw),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-64:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        ",".join(f"{c}:{total[c]}" for c in np.flatnonzero(total)),
        len(frames),
        time,
        frames,
    )


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media, read the stored bytes back and describe both."""
    ship_package(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), _FRAMES]
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature n_frames duration_ms frames".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            rows = [media_digest(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return documents(docs, id_col, text_col).mapInArrow(run, DIGEST_SCHEMA)
