import hashlib
import random
import zlib

import numpy as np
import pytest

from factorloom.llm import gif


def plain_expand(stream, min_size):
    """Textbook bit-by-bit decoder."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end = 1 << min_size, (1 << min_size) + 1
    at, out, table, previous, width = 0, b"", {}, None, min_size + 1
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table = {i: bytes([i]) for i in range(clear)}
            free, previous, width = end + 1, None, min_size + 1
            continue
        if code == end:
            return out
        entry = table[code] if code in table else previous + previous[:1]
        out += entry
        if previous is not None and free < 4096:
            table[free] = previous + entry[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        previous = entry


@pytest.mark.parametrize("min_size", [2, 4, 8])
def test_code_streams_round_trip_and_agree_with_a_plain_decoder(min_size):
    rng = random.Random(min_size)
    for n in (0, 1, 2, 5, 255, 4000, 30000):
        for alphabet in (1, min(3, 1 << min_size), 1 << min_size):
            data = bytes(rng.randrange(alphabet) for _ in range(n))
            stream = gif.lzw_compress(data, min_size)
            assert gif.lzw_expand(stream, min_size, n) == data
            assert plain_expand(stream, min_size) == data


def test_a_full_table_without_a_clear_code_is_read():
    rng = random.Random(1)
    codes, bits, at, free, width = [256], "", 0, 258, 9
    want, table, previous = b"", {i: bytes([i]) for i in range(256)}, None
    bits = f"{256:09b}"[::-1]
    for _ in range(9000):
        code = rng.randrange(256)
        bits += f"{code:0{width}b}"[::-1]
        want += bytes([code])
        if previous is not None and free < 4096:
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        previous = code
    bits += f"{257:0{width}b}"[::-1]
    bits += "0" * (-len(bits) % 8)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert gif.lzw_expand(stream, 8, len(want)) == want
    assert codes and not at and table


def test_disposal_transparency_palettes_and_interlace():
    red_green = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    base = np.zeros((9, 4), np.uint8)
    patch = np.array([[1, 3], [3, 2]], np.uint8)
    media = gif.encode(
        [
            {"indices": base, "delay_ms": 50, "disposal": 1},
            {"indices": patch, "left": 1, "top": 2, "delay_ms": 70, "disposal": 3, "transparent": 3},
            {"indices": patch, "left": 0, "top": 0, "disposal": 2, "palette": red_green[::-1]},
            {"indices": np.arange(36, dtype=np.uint8).reshape(9, 4) % 3, "interlace": True},
        ],
        red_green,
    )
    a, b, c, d = gif.decode(media)
    assert [f.delay_ms for f in (a, b, c, d)] == [50, 70, 0, 0]
    assert (a.pixels[..., :3] == [255, 0, 0]).all() and (a.pixels[..., 3] == 255).all()
    assert b.pixels[2, 1, :3].tolist() == [0, 255, 0] and b.pixels[3, 2, :3].tolist() == [0, 0, 255]
    assert b.pixels[2, 2, :3].tolist() == [255, 0, 0]  # transparent: what was there
    assert c.pixels[2, 1, :3].tolist() == [255, 0, 0]  # the patch was taken back
    assert c.pixels[0, 0, :3].tolist() == [0, 0, 255]  # its own palette
    assert d.pixels[..., :3].tolist() == red_green[np.arange(36).reshape(9, 4) % 3].tolist()
    assert gif.colour_histogram(a.pixels).sum() == 36


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"PNG" * 20])
def test_damage_is_an_error(bad):
    with pytest.raises(gif.GifError):
        list(gif.decode(bad))
    good = gif.store_payload(bytes(range(256)) * 4)
    for cut in range(13, len(good) - 1, 37):
        with pytest.raises(gif.GifError):
            list(gif.decode(good[:cut]))


def test_every_kind_of_damage_is_a_gif_error():
    rng = random.Random(3)
    good = [gif.store_payload(bytes(rng.randrange(256) for _ in range(64 * 40))), gif.store_payload(b"abc " * 16 * 1100)]
    good.append(gif.encode([{"indices": np.zeros((9, 4), np.uint8), "delay_ms": 50, "transparent": 1, "interlace": True}], gif.GREY[:4]) + b"")
    for media in good:
        cases = [media[:k] for k in range(0, min(len(media), 900))] + [media[:13], b"GIF89a\xff\xff\xff\xff\x00\x00\x00\x3b", media[:-1] + b"\x21"]
        for _ in range(400):
            x = bytearray(media)
            for _ in range(rng.randrange(1, 6)):
                x[rng.randrange(len(x))] = rng.randrange(256)
            cases.append(bytes(x))
        for case in cases:
            try:
                list(gif.decode(case, 1 << 20))
            except gif.GifError:
                pass


def test_long_payloads_are_timed_frames():
    payload = bytes(np.random.default_rng(0).integers(0, 3, 64 * (2 * gif.FRAME_ROWS + 5), dtype=np.uint8))
    media = gif.store_payload(payload)
    assert gif.read_payload(media) == payload
    frames = list(gif.decode(media))
    assert [(f.index, f.delay_ms, f.disposal, len(gif.shown_rows(f))) for f in frames] == [(0, 100, 2, 512), (1, 100, 2, 512), (2, 100, 2, 5)]
    assert (frames[2].pixels[5:, :, 3] == 0).all()


def test_columns(spark):
    texts = [(1, "héllo wörld " * 30, 5), (2, "", 5), (3, None, 5), (3, None, 5), (4, "x" * 200_000, 5), (None, "a" * 64, 5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, media long")
    rows = gif.media_digests(docs).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    for key, text, _ in texts:
        raw = gif.padded((text or "").encode())
        r = by[key]
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-64:])
        samples = np.frombuffer(raw, np.uint8)
        level = samples.astype(int) * 4 // 256
        want = np.bincount(level * 21, minlength=64)  # a grey sample has one level in every colour
        assert r.feature == ",".join(f"{c}:{n}" for c, n in enumerate(want) if n)
        assert r.n_frames == -(-len(raw) // (64 * gif.FRAME_ROWS)) and r.duration_ms == 100 * r.n_frames
        assert np.array([f.histogram for f in r.frames]).sum(axis=0).tolist() == want.tolist() and [f.start_ms for f in r.frames] == list(range(0, r.duration_ms, 100))
        assert r.media_bytes == len(gif.store_payload(raw)) and r.media_sha256 == hashlib.sha256(gif.store_payload(raw)).hexdigest()
    assert by[2].media_sha256 == by[3].media_sha256
    frames = gif.decode_media(gif.encode_texts(docs)).collect()
    assert len(frames) == sum(r.n_frames for r in rows) and all(f.error is None and 0 < sum(f.histogram) <= f.n_rows * f.n_columns for f in frames)
    assert gif.decode_media(spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")).where("error is null").count() == 0
    large = spark.createDataFrame([(1, bytearray(b"GIF89a\xff\xff\xff\xff\x00\x00\x00\x3b")), (2, bytearray(gif.store_payload(bytes(64))[:-1] + b"\x21"))], "doc_id long, media binary")
    damaged = {r.media_id: r for r in gif.decode_media(large).where("error is not null").collect()}
    assert "65535 x 65535" in damaged[1].error and "cut short" in damaged[2].error
    assert gif.media_digests(docs.limit(0)).count() == 0
