"""Removal of byte strings that repeat anywhere in a corpus, by suffix arrays over groups.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
doc_id, or the same document and an earlier place) is removed.

One suffix array over a corpus can't be spread over machines, but equal strings can be
brought together first.  Each string of ``length`` bytes names one anchor: the place of
the least hash among its ``GRAM``-byte grams, the leftmost of equals.  Equal strings
name equal grams at equal distances, so they meet under the gram's hash.  Consecutive
strings that name the same anchor travel as one stretch of text, its context.

1. anchors: hashes of all anchors, pre-aggregated by task and block of documents, are
   dealt into shards, which return those that occur twice or more;
2. contexts: the stretches around those anchors, once per block and distinct stretch,
   are dealt by hash;
3. suffix groups: in each shard, stretches that share an anchor with a different one
   are cut to what they can share and sorted by :mod:`suffix_groups`; runs of suffixes
   with ``length`` equal bytes are one string, and all of its places but the first go;
4. removal: the spans go back to their blocks.

Anchors that occur more than ``hot`` times send single strings instead of stretches,
dealt by the string's own hash, so that a passage in a third of all documents spreads
over all shards, and no group to be sorted has more than ``hot`` stretches.

Defined results
* null and empty texts are 0 bytes long and lose nothing;
* rows with the same doc_id follow each other in the order of a hash of their texts, then
  of the texts; null ids count as the greatest id;
* repeated rows lose all but their first when they are ``length`` bytes or longer;
* an empty table gives no rows; extra columns are never read;
* texts are judged whole, and on the input, not on what is left.

Scale: texts cross the network once (steps 2 and 4 share the exchange); hashes, about
one per 35 bytes, once; contexts of repeated anchors once.  No step needs all rows of a
key in one row; texts are dealt by id and hash, so a repeated or null id spreads over all
blocks, and blocks and shards hold a fixed number of stored bytes on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, parts_for, ship_package, small_batches, text_bytes
from .suffix_groups import suffix_array

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
#: Tasks of a step at most; a task takes its blocks or shards one by one.
MOST_TASKS = 200_000
SHARD_BYTES = 2 << 20
#: Stretches of one anchor sorted together: about 1.4 million symbols, some 300 MB as lists.
HOT = 1 << 13
#: Symbols given to one suffix array, unless a single group of stretches has more.
SORT_AT_ONCE = 1 << 17
#: Fixed odd multipliers of the gram hash.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_PLACE_BITS = 20
_STEP = 1 << 17


# --- anchors -----------------------------------------------------------------


def gram_hashes(raw: bytes) -> np.ndarray:
    """The hash of the gram at each place of the bytes."""
    n = len(raw) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for t in range(GRAM // 8):
        w = np.ndarray((n,), "<u8", raw, 8 * t, (1,)) * _MIX[t % 4]
        w ^= w >> np.uint64(29)
        h *= _MIX[3]
        h += w
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and the first and last string naming each, and its hash, over texts end to end.

    Strings across the end of a text aren't strings of it.
    """
    window = length - GRAM + 1
    last = len(data) - length + 1
    found: list[tuple[np.ndarray, ...]] = []
    sizes = np.diff(offsets)
    valid = np.ones(max(0, last) + 1, np.int32)
    if last > 0:
        # strings starting in the last length - 1 bytes of a text
        cut = np.zeros(len(data) + 2, np.int32)
        np.add.at(cut, np.maximum(offsets[:-1], offsets[1:] - length + 1)[sizes > 0], 1)
        np.add.at(cut, offsets[1:][sizes > 0], -1)
        valid = np.cumsum(cut)[: last + 1]
    for start in range(0, max(0, last), _STEP):
        stop = min(last, start + _STEP)
        h = gram_hashes(data[start : stop + length - 1].tobytes())
        key = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if window > span:
            key = np.minimum(key[: span - window], key[window - span :])
        place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        own = np.flatnonzero(valid[start:stop] == 0)
        if not len(own):
            continue
        place = place[own]
        new = np.flatnonzero((np.diff(place) != 0) | (np.diff(own) != 1)) + 1
        first, end = np.concatenate([[0], new]), np.concatenate([new - 1, [len(own) - 1]])
        found.append((place[first] + start, own[first] + start, own[end] + start, h[place[first]]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    x, a, b, h = (np.concatenate(c) for c in zip(*found, strict=True))
    return x, a, b, h


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    at, out = 0, []
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of neighbours that are equal in every key."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    return starts, np.append(starts[1:], len(keys[0]))


# --- the four steps ------------------------------------------------------------


def _anchor_rows(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            data, offsets = text_bytes(batch.column(1))
            x, _, _, h = anchors(data, offsets, length)
            if not len(x):
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)[np.searchsorted(offsets, x, "right") - 1]
            order = np.lexsort((block, h))
            h, block = h[order], block[order]
            starts, ends = _runs(h, block)
            times = (ends - starts).astype(np.int32)
            h, block = h[starts], block[starts]
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((block, shard))
            h, block, times, shard = h[order], block[order], times[order], shard[order]
            starts, ends = _runs(shard)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[starts]), pa.array([_pack(h[s:e], block[s:e], times[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())],
                ["shard", "payload"],
            )

    return run


def _repeated(hot: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(raw, "<u8", "<i4", "<i4") for raw in table.column("payload").to_pylist()]
        h, block, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, block, times = h[order], block[order], times[order]
        starts, ends = _runs(h)
        total = np.add.reduceat(times.astype(np.int64), starts)
        repeats = np.repeat(total >= 2, ends - starts)
        frequent = np.repeat(total > hot, ends - starts)[repeats]
        h, block = h[repeats], block[repeats]
        order = np.argsort(block, kind="stable")
        h, block, frequent = h[order], block[order], frequent[order]
        starts, ends = _runs(block)
        return pa.table(
            {
                "block": pa.array(block[starts], pa.int32()),
                "payload": pa.array([_pack(h[s:e], frequent[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _in_order(table: pa.Table) -> pa.Table:
    """The block's rows by doc_id, null last, then the hash of the text, then text."""
    return table.sort_by([("doc_id", "ascending"), ("__turn", "ascending"), ("text", "ascending")])


def _contexts(shards: int, length: int):
    empty = pa.table({"shard": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})

    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        if not docs.num_rows or not repeated.num_rows:
            return empty
        block = docs.column("__block")[0].as_py()
        docs = _in_order(docs)
        data, offsets = text_bytes(docs.column("text"))
        ids = docs.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        turn = docs.column("__turn").to_numpy().astype("<i4")
        parts = [_unpack(raw, "<u8", "?") for raw in repeated.column("payload").to_pylist()]
        known, frequent = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(known)
        known, frequent = known[order], frequent[order]
        x, a, b, h = anchors(data, offsets, length)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        keep = known[at] == h
        x, a, b, h, at = x[keep], a[keep], b[keep], h[keep], at[keep]
        is_hot = frequent[at]
        raw = data.tobytes()
        spans = list(zip(a[~is_hot].tolist(), b[~is_hot].tolist(), x[~is_hot].tolist(), h[~is_hot].tolist(), strict=True))
        for i, j in zip(a[is_hot].tolist(), b[is_hot].tolist(), strict=True):
            for p in range(i, j + 1):
                own = int.from_bytes(hashlib.blake2b(raw[p : p + length], digest_size=8).digest(), "little")
                spans.append((p, p, p, own))
        number: dict[bytes, int] = {}
        texts, keys, rel = [], [], []
        which = []
        for i, j, place, key in spans:
            text = raw[i : j + length]
            k = number.get(text)
            if k is None:
                k = number[text] = len(texts)
                texts.append(text)
                keys.append(key)
                rel.append(place - i)
            which.append(k)
        if not spans:
            return empty
        starts = np.array([s[0] for s in spans], np.int64)
        row = np.searchsorted(offsets, starts, "right") - 1
        which, keys = np.array(which), np.array(keys, np.uint64)
        shard = (keys % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard[which], kind="stable")
        out_shard, out = [], []
        s, e = _runs(shard[which][by_shard])
        for u, v in zip(s, e, strict=True):
            own = by_shard[u:v]
            used, local = np.unique(which[own], return_inverse=True)
            stretch = [texts[k] for k in used]
            out_shard.append(int(shard[used[0]]))
            out.append(
                _pack(
                    keys[used],
                    np.array([rel[k] for k in used], "<i4"),
                    np.array([len(t) for t in stretch], "<i4"),
                    local.astype("<i4"),
                    ids[row[own]],
                    turn[row[own]],
                    row[own].astype("<i4"),
                    (starts[own] - offsets[row[own]]).astype("<i4"),
                    np.frombuffer(b"".join(stretch), np.uint8),
                )
            )
        return pa.table({"shard": pa.array(out_shard, pa.int64()), "block": pa.array([block] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return run


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix that it shares with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    reach = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = shared_prefix(parts[i], parts[j])
        if n > reach[i]:
            reach[i] = n
        reach[j] = n
    return reach


def equal_strings(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Classes of two or more equal ``length``-byte strings, as (text, place), by suffix array."""
    m = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    flat = np.zeros(int(ends[-1]), np.int64)
    joined = b"\0".join(texts) + b"\0"
    flat[:] = np.frombuffer(joined, np.uint8)
    flat += m
    flat[ends - 1] = np.arange(m)  # each text ends in a symbol of its own
    order = np.array(suffix_array(flat.tolist()), np.int64)
    text = np.searchsorted(ends, order, "right")
    fits = order + length < ends[text]
    order, text = order[fits].tolist(), text[fits].tolist()
    begin = (ends - [len(t) + 1 for t in texts]).tolist()
    classes: list[list[tuple[int, int]]] = []
    last, current = None, None
    for p, t in zip(order, text, strict=True):
        string = joined[p : p + length]
        if string == last:
            if current is None:
                current = [before]
                classes.append(current)
            current.append((t, p - begin[t]))
        else:
            current = None
        before = (t, p - begin[t])
        last = string
    return classes


def _suffix_groups(length: int):
    empty = pa.table({"block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        texts: list[bytes] = []
        keys: list[int] = []
        rel: list[int] = []
        occurrences = []
        for block, raw in zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True):
            key, place, size, local, ids, turn, row, start, letters = _unpack(raw, "<u8", "<i4", "<i4", "<i4", "<i8", "<i4", "<i4", "<i4", "u1")
            letters = letters.tobytes()
            end = np.cumsum(size).tolist()
            names = []
            for k, r, n, e in zip(key.tolist(), place.tolist(), size.tolist(), end, strict=True):
                t = letters[e - n : e]
                i = number.get(t)
                if i is None:
                    i = number[t] = len(texts)
                    texts.append(t)
                    keys.append(k)
                    rel.append(r)
                names.append(i)
            occurrences.append((np.array(names, np.int64)[local], ids, turn, row, start, np.full(len(local), block, np.int32)))
        # Rows that are equal in id and hash are in one block, so their places in it order them.
        which, ids, turn, row, start, block = (np.concatenate(c) for c in zip(*occurrences, strict=True))
        order = np.lexsort((start, row, turn, ids, which))
        which, ids, turn, row, start, block = which[order], ids[order], turn[order], row[order], start[order], block[order]
        first, _ = _runs(which)  # every stretch occurs, so run k is stretch k
        earliest = list(zip(ids[first].tolist(), turn[first].tolist(), row[first].tolist(), start[first].tolist(), strict=True))

        groups: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(k, []).append(i)
        later: dict[int, set[int]] = {}  # strings of a stretch that start earlier in another one

        def settle(cut: dict[bytes, list[tuple[int, int]]]) -> None:
            strings = list(cut)
            owners = list(cut.values())
            if len(strings) == 1:
                classes = [[(0, p)] for p in range(len(strings[0]) - length + 1)]
            else:
                classes = equal_strings(strings, length)
                inner = {x for c in classes for x in c}
                classes += [[(t, p)] for t, s in enumerate(strings) if len(owners[t]) > 1 for p in range(len(s) - length + 1) if (t, p) not in inner]
            for places in classes:
                own = [(i, p + shift) for t, p in places for i, shift in owners[t]]
                if len(own) < 2:
                    continue
                least = min((*earliest[i][:3], earliest[i][3] + p) for i, p in own)
                for i, p in own:
                    if (*earliest[i][:3], earliest[i][3] + p) != least:
                        later.setdefault(i, set()).add(p)

        waiting: dict[bytes, list[tuple[int, int]]] = {}
        held = 0
        for own in groups.values():
            if len(own) < 2:
                continue
            right = _reach([texts[i][rel[i] :] for i in own])
            left = _reach([texts[i][: rel[i]][::-1] for i in own])
            for i, r, l in zip(own, right, left, strict=True):
                if l + r >= length:
                    t = texts[i][rel[i] - l : rel[i] + r]
                    owners = waiting.get(t)
                    if owners is None:
                        waiting[t] = owners = []
                        held += len(t)
                    owners.append((i, rel[i] - l))
            if held > SORT_AT_ONCE:
                settle(waiting)
                waiting, held = {}, 0
        if waiting:
            settle(waiting)

        size = np.array([len(t) for t in texts], np.int64)
        is_first = np.zeros(len(which), bool)
        is_first[first] = True
        out = [(block[~is_first], row[~is_first], start[~is_first], size[which[~is_first]].astype(np.int32))]
        extra = []
        for i, places in later.items():
            p = np.array(sorted(places))
            s, e = _runs(p - np.arange(len(p)))
            at = first[i]
            extra += [(block[at], row[at], start[at] + p[u], p[v - 1] - p[u] + length) for u, v in zip(s, e, strict=True)]
        if extra:
            out.append(tuple(np.array(c, np.int32) for c in zip(*extra, strict=True)))
        block, row, start, size = (np.concatenate(c) for c in zip(*out, strict=True))
        if not len(block):
            return empty
        order = np.lexsort((start, row, block))
        block, row, start, size = block[order], row[order], start[order].astype("<i4"), size[order].astype("<i4")
        s, e = _runs(block)
        return pa.table({"block": pa.array(block[s], pa.int32()), "payload": pa.array([_pack(row[u:v].astype("<i4"), start[u:v], size[u:v]) for u, v in zip(s, e, strict=True)], pa.binary())})

    return run


def _removed(docs: pa.Table, spans: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The block's rows in order, their bytes and offsets, and which bytes go."""
    docs = _in_order(docs)
    data, offsets = text_bytes(docs.column("text"))
    change = np.zeros(len(data) + 1, np.int32)
    for raw in spans.column("payload").to_pylist():
        row, start, size = _unpack(raw, "<i4", "<i4", "<i4")
        begin = offsets[row] + start
        np.add.at(change, begin, 1)
        np.add.at(change, begin + size, -1)
    return docs, data, offsets, np.cumsum(change[:-1]) > 0


def _digests(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs, data, offsets, gone = _removed(docs, spans)
    begins = np.zeros(len(data), np.int64)
    begins[:] = gone
    begins[1:] -= gone[1:] & gone[:-1]
    inside = offsets[:-1][np.diff(offsets) > 0]
    begins[inside] = gone[inside]  # a run never reaches over from the text before
    removed, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
    kept = data[~gone].tobytes()
    before = offsets - removed[offsets]
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(np.diff(removed[offsets]), pa.int64()),
            "n_spans": pa.array(np.diff(runs[offsets]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(before, before[1:], strict=False)], pa.string()),
        }
    )


def _texts(docs: pa.Table, spans: pa.Table) -> pa.Table:
    docs, data, offsets, gone = _removed(docs, spans)
    kept = data[~gone].tobytes()
    removed = np.concatenate([[0], np.cumsum(gone)])
    before = offsets - removed[offsets]
    out = docs.drop_columns(["text", "__block", "__turn"]).append_column(
        "text", pa.array([kept[i:j].decode("utf-8", "ignore") for i, j in zip(before, before[1:], strict=False)], pa.string())
    )
    return out.append_column("n_removed", pa.array(np.diff(removed[offsets]), pa.int64()))


def _plan(docs: DataFrame, length: int, hot: int, blocks: int | None, shards: int | None) -> tuple[DataFrame, DataFrame]:
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    ship_package(docs.sparkSession)
    blocks = blocks or parts_for(docs, BLOCK_BYTES)
    shards = shards or parts_for(docs, SHARD_BYTES)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks // 4, MOST_TASKS))
    turn = F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")
    own = F.pmod(F.xxhash64("doc_id", turn), F.lit(blocks)).cast("int")
    dealt = docs.withColumn("__turn", turn).withColumn("__block", own).repartition(parts, "__block")
    # Read before the exchange, which the last two steps share.
    read = docs.select(own.alias("block"), "text")
    hashes = read.mapInArrow(_anchor_rows(shards, length), "shard long, payload binary")
    repeated = hashes.repartition(parts, "shard").groupBy("shard").applyInArrow(_repeated(hot), "block int, payload binary")
    contexts = dealt.groupBy("__block").cogroup(repeated.groupBy("block")).applyInArrow(_contexts(shards, length), "shard long, block int, payload binary")
    spans = contexts.repartition(parts, "shard").groupBy("shard").applyInArrow(_suffix_groups(length), "block int, payload binary")
    return dealt, spans


def repeat_digests(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, blocks: int | None = None, shards: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is removed from each document."""
    dealt, spans = _plan(documents(docs, id_col, text_col), length, hot, blocks, shards)
    return dealt.groupBy("__block").cogroup(spans.groupBy("block")).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, blocks: int | None = None, shards: int | None = None
) -> DataFrame:
    """doc_id, the carried columns, text and n_removed: the documents without their repeats.

    A character cut by the edge of a span goes as a whole.
    """
    own = documents(docs, id_col, text_col, *carry)
    dealt, spans = _plan(own, length, hot, blocks, shards)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return dealt.groupBy("__block").cogroup(spans.groupBy("block")).applyInArrow(_texts, f"{schema}, text string, n_removed long")
