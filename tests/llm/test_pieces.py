import numpy as np
import struct

import pytest

from factorloom.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  a  b ", "日本語 😀 x", "▁ a ▁▁b", " \n\t x", "a" * 5000, "<0x41> <s> </s> <unk>", "a\0b", "﻿x", "trailing ", " leading", "ﬁ ½", "new\nline word\nnew"]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def unigram(byte_fallback=True, extra=True):
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        table += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "▁the", "the", "▁t", "h", "e", "t", "a", "b", "ab", "▁ab", "abab", "x", "y", "xy", "▁xyx", "n", "\n"]
    table += [(w, -1.0 - 0.37 * i - 0.9 / len(w), 1) for i, w in enumerate(words)]
    raw = b"".join(message((1, message((1, p), (2, s), (3, k)))) for p, s, k in table)
    raw += message((2, message((3, 1), (35, int(byte_fallback)))))
    return raw + message((3, message((1, "identity"), (3, 1), (4, int(extra)), (5, 1))))


def test_merge_model_agrees_with_its_own_library():
    import duckdb

    model, encoder, own = pieces.load(pieces.read_model(MODEL))
    texts = ODD + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    ids = [x.tolist() for x in encoder.encode_batch(texts)]
    assert ids == own.encode(texts)
    assert encoder.decode_batch([np.array(x, "<i4") for x in ids], ids) == encoder.whole.decode_batch(ids, skip_special_tokens=False) == own.decode(ids)
    encoder.KEPT = 3  # starting the store anew changes nothing
    assert [x.tolist() for x in encoder.encode_batch(texts)] == ids


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("extra", [True, False])
def test_unigram_scores_and_byte_fallback(byte_fallback, extra):
    raw = unigram(byte_fallback, extra)
    model, encoder, own = pieces.load(raw)
    assert model.model_type == pieces.UNIGRAM and model.byte_fallback == byte_fallback
    texts = ["the ab abab xyx", "tthe  xyxy", "abthe", "the é ab", "", " the ", "xyab"]
    ids = [x.tolist() for x in encoder.encode_batch(texts)]
    assert ids == own.encode(texts)
    if byte_fallback:
        assert encoder.decode_batch([np.array(x, "<i4") for x in ids], ids) == encoder.whole.decode_batch(ids, skip_special_tokens=False) == own.decode(ids)


def test_damaged_models_are_refused():
    with pytest.raises(ValueError):
        pieces.parse_model(unigram()[:-4])
    with pytest.raises(ValueError):
        pieces.parse_model(message((1, message((1, "a"), (2, 0.0)))))


def test_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(90, None, "x"), (None, "the end", "x"), (1, " ", "x")], "doc_id long, text string, ids string")
    rows = pieces.encode(docs, MODEL).collect()
    assert len(rows) == len(ODD) + 3 and all(r.parity for r in rows)
    digests = pieces.encoded_digests(docs, MODEL).collect()
    assert {(r.doc_id, len(r.ids)) for r in rows} == {(r.doc_id, r.n_tokens) for r in digests}
    assert [r.ids for r in rows if r.doc_id == 90] == [[]]
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
