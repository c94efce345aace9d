"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here, field by field, and rebuilt as a tokenizers
pipeline: the stored character map or the named normaliser, removal of extra spaces,
the metaspace marker and its prefix, unigram scores (or, for models of the merge kind,
merges ranked by those scores), user-defined and control pieces, and byte fallback.
Batches are encoded by the library's threads.  Ids are held against the model's own
library text by text.

Defined results
* null and empty texts have no ids; they decode to the empty text;
* characters without a piece become byte pieces where the model has them, else unknown;
* repeated rows, ties and extra columns have no effect; an empty table gives no rows;
* texts are encoded whole.

Scale: map-only; the model is broadcast and refused above ``MAX_MODEL_BYTES``.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, ship_package, small_batches

MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    character_map: bytes = b""
    add_prefix: bool = True
    remove_extra: bool = True
    escape_spaces: bool = True
    suffix_marker: bool = False

    @property
    def unknown_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as ints, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 0x7F) << shift
            at += 1
            if byte < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
            yield tag >> 3, value
            continue
        if wire == 2:
            size, at = varint(at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire}")
        if at + size > len(raw):
            raise ValueError("message cut short")
        yield tag >> 3, raw[at : at + size]
        at += size


def parse_model(raw: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a model file."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 24:
                    model.suffix_marker = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 44:
                    model.unknown_surface = v.decode()
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.character_map = v
                elif n == 3:
                    model.add_prefix = bool(v)
                elif n == 4:
                    model.remove_extra = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    if UNKNOWN not in model.kinds:
        raise ValueError("no unknown piece")
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.model_type}")
    if model.suffix_marker or not model.escape_spaces:
        raise ValueError("markers after words and unescaped spaces aren't supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every pair of pieces that makes a piece, best score first, in the order of their ids."""
    rank = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = []
    for piece, i in rank.items():
        ranked += [(-model.scores[i], i, rank[piece[:cut]], rank[piece[cut:]], piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in rank and piece[cut:] in rank]
    return [x[4:] for x in sorted(ranked)]


def has_inner_marks(model: Model) -> bool:
    """Whether a piece has a marker after another character and so can reach across words."""
    return any(MARK in p.lstrip(MARK) for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED))


def build_tokenizer(model: Model):
    """The tokenizers pipeline that gives the model's ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.pieces[model.unknown_id]
    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unknown_id, model.byte_fallback)
    else:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not has_inner_marks(model):
        # No piece has a marker after another character, so none reaches across these places,
        # and the library's cache of short words serves whole texts.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    own = [AddedToken(p, normalized=False, special=False) for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    return tokenizer


#: Threads of a worker's batch encoding: a task has one core, and threads that wait for work burn others'.
THREADS = 2


@lru_cache(maxsize=2)
def load(raw: bytes):
    """The rebuilt tokenizer and the model's own library, kept by the process."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library first encodes a batch
    import sentencepiece

    model = parse_model(raw)
    return model, Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=raw)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return raw


_NO_IDS = np.zeros(0, "<i4")


class Encoder:
    """Batch encoding that asks the library once for each distinct word.

    Where no piece has a marker after another character, a text without marker
    characters or runs of spaces is a row of independent words, so their ids join to
    the text's.  Words not seen lately go to the library in one multithreaded batch, as
    does every other text whole.
    """

    #: Bytes of words and ids kept; the store starts anew beyond it, which changes no result.
    KEPT = 112 << 20
    #: Words of more characters aren't kept beyond their batch.
    LONGEST = 256

    def __init__(self, model: Model) -> None:
        from tokenizers import Tokenizer

        self.whole = build_tokenizer(model)
        self.by_word = model.add_prefix and not model.character_map and not has_inner_marks(model) and USER_DEFINED not in model.kinds and MARK in model.pieces
        #: The same pipeline for text whose markers are in place.
        self.marked = Tokenizer(self.whole.model)
        if self.by_word:
            self.marked.pre_tokenizer = self.whole.pre_tokenizer
        self.begins = np.array([p.startswith(MARK) for p in model.pieces])
        self.ids: dict[str, bytes] = {}  # little-endian 32-bit
        self.kept = 0
        self.surface = [p.replace(MARK, " ") for p in model.pieces]
        #: Pieces whose text doesn't depend on their neighbours, once the prefix is stripped:
        #: normal ones, and ASCII bytes where no other bytes are about.
        free = {i for i, k in enumerate(model.kinds) if k == NORMAL}
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == BYTE and int(p[1:-1], 16) < 128:
                self.surface[i] = chr(int(p[1:-1], 16))
                free.add(i)
        self.free = np.zeros(len(model.pieces), bool)
        if model.add_prefix:
            self.free[list(free)] = True

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and t != "" and "  " not in t and MARK not in t and t[0] != " " and t[-1] != " " for t in texts]
        words = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        out: list[np.ndarray] = [_NO_IDS] * len(texts)
        odd = [i for i, p in enumerate(plain) if not p]
        for i, x in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, "<i4")
        if self.kept > self.KEPT:
            self.ids.clear()
            self.kept = 0
        known = self.ids
        new = list(set().union(*words).difference(known))
        long = []
        for w, x in zip(new, self._new_words(new), strict=True):
            known[w] = x
            if len(w) > self.LONGEST:
                long.append(w)
            else:
                self.kept += 200 + 4 * len(w) + len(x)  # both objects' headers and the entry
        for i, row in enumerate(words):
            if plain[i]:
                out[i] = np.frombuffer(b"".join(map(known.__getitem__, row)), "<i4")
        for w in long:
            del known[w]
        return out

    def _new_words(self, words: list[str], at_once: int = 256) -> Iterator[bytes]:
        """The ids of each word; words travel in rows, whose ids part where markers begin."""
        rows = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        for row, x in zip(rows, self.marked.encode_batch_fast(["".join([MARK + w for w in row]) for row in rows], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<i4")
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(row):
                raise AssertionError("a word without a marker of its own")
            raw = ids.tobytes()
            ends = (4 * cuts).tolist() + [len(raw)]
            for a, b in zip(ends, ends[1:], strict=False):
                yield raw[a:b]

    def decode_batch(self, ids: list[np.ndarray], lists: list[list[int]]) -> list[str]:
        """The texts of ids, given as arrays and lists; rows with other than normal pieces go to the library."""
        surface = self.surface.__getitem__
        free = [bool(self.free[x].all()) for x in ids]
        out = ["".join(map(surface, row)).removeprefix(" ") if f else "" for f, row in zip(free, lists, strict=True)]
        odd = [k for k, f in enumerate(free) if not f]
        for k, t in zip(odd, self.whole.decode_batch([lists[k] for k in odd], skip_special_tokens=False), strict=True):
            out[k] = t
        return out


ENCODED = "doc_id long, ids array<int>, parity boolean, decoded string"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, whether the model's own library gives the same ids and text, and the text that the ids decode to."""
    return _run(docs, model_path, id_col, text_col, ENCODED, lambda ids, same, back, _: (ids, same, back), [pa.list_(pa.int32()), pa.bool_(), pa.string()])


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, n_byte_pieces long, decoded_sha256 string, parity boolean"


def encoded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`encode` gives, as counts and digests of the ids (little-endian 32-bit) and the decoded text."""

    def describe(ids: np.ndarray, same: bool, back: str, is_byte: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids).hexdigest(), int(np.count_nonzero(is_byte[ids])), hashlib.sha256(back.encode()).hexdigest(), same

    return _run(docs, model_path, id_col, text_col, DIGEST, describe, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()])


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, describe, types: list) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(read_model(model_path))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder, own = load(raw.value)
        is_byte = np.array([k == BYTE for k in model.kinds])
        for batch in small_batches(batches, 1, 4 << 20):
            texts = batch.column(1).to_pylist()
            ids = encoder.encode_batch(texts)
            lists = [x.tolist() for x in ids]
            decoded = encoder.decode_batch(ids, lists)
            same = [a == b for a, b in zip(lists, own.encode(texts, num_threads=1), strict=True)]
            same = [s and a == b for s, a, b in zip(same, decoded, own.decode(lists, num_threads=1), strict=True)]
            columns = zip(*(describe(*row, is_byte) for row in zip(ids, same, decoded, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)
