"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the longest permitted length are cut into pieces of that
length; the pieces of all documents are dealt into shards by a hash, and each shard
is packed by variable-capacity best fit over its pieces in descending length:

* a piece goes to the open bin it leaves least room in;
* if none has room, a bin is opened, of the permitted length that costs least per token
  it can be expected to hold: the piece itself, and of the pieces still to come those that
  fit the room left, less the room that open bins already offer them;
* at the end each bin is downsized to the least permitted length that holds its contents.

A bin of length c costs ``c + c * c / attention + overhead``: its tokens, attention within
it, and what a sequence costs whatever its length.  Short bins are cheaper for each token
until the overhead outweighs that, and long pieces need long ones, so the lengths are
chosen together.

Lengths are counted in the tokens of a byte-level vocabulary (:mod:`token_counts`).

Defined results
* null and empty texts have length 0: one piece of length 0, bin null, offset null;
* repeated rows are packed once each; pieces that are equal in id, text and place are
  interchangeable, and other ties go by length, doc_id, hash of the text and piece;
* equal tables give equal bins, however they are stored, partitioned or ordered;
* an empty table gives an empty result; extra columns are never read.

Scale: texts stay where they are read.  (id, hash, length) rows are pre-aggregated, counted,
and dealt into shards of about ``SHARD_TOKENS`` tokens and at most ``SHARD_PIECES`` expected
pieces by id, hash, copy and piece, so that no source, id, length or group of copies can fill one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ship_package
from .token_counts import encoded_lengths

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 64
#: The length at which attention costs as much as everything else.
ATTENTION = 65536
SHARD_TOKENS = 16_000_000
SHARD_PIECES = 100_000
SCHEMA = "doc_id long, piece long, start long, length long, bin string, capacity long, bin_offset long, bin_used long"


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of this length costs, in tokens."""
    return capacity + capacity * capacity / attention + overhead


def pack(lengths: Sequence[int], capacities: Sequence[int], overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the final length of each bin.  The pieces descend in length."""
    sizes = sorted(capacities)
    price = {c: cost(c, overhead, attention) for c in sizes}
    to_come = np.concatenate([np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]]).tolist()
    negated = [-n for n in lengths]
    offered = 0
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    size_of: list[int] = []
    at, offset = [], []
    for i, n in enumerate(lengths):
        k = bisect_left(open_bins, (n, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
            offered -= room
        else:

            def per_token(c: int) -> tuple[float, int]:
                later = max(i + 1, bisect_left(negated, n - c))  # pieces that fit in the room
                return price[c] / (n + min(c - n, max(0, to_come[later] - offered))), c

            room = min(sizes[bisect_left(sizes, n) :], key=per_token)
            b = len(used)
            used.append(0)
            size_of.append(room)
        at.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
            offered += room - n
    final = [min((c for c in sizes[bisect_left(sizes, u) :]), default=s) for u, s in zip(used, size_of, strict=True)]
    return at, offset, final


def pack_pieces(pieces: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """Pack rows (shard, doc_id, text_hash, piece, start, length); each shard on its own."""

    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "text_hash", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        n = int((rows["length"] > 0).sum())
        at, offset, final = pack(rows["length"].tolist()[:n], capacities, overhead, attention)
        used = np.bincount(at, weights=rows["length"].to_numpy()[:n], minlength=len(final)).astype(np.int64) if n else np.zeros(0, np.int64)
        empty = [None] * (len(rows) - n)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"],
                "piece": rows["piece"],
                "start": rows["start"],
                "length": rows["length"],
                "bin": [f"{key[0]}-{b}" for b in at] + empty,
                "capacity": pd.array([final[b] for b in at] + empty, "Int64"),
                "bin_offset": pd.array(offset + empty, "Int64"),
                "bin_used": pd.array([int(used[b]) for b in at] + empty, "Int64"),
            }
        )

    return pieces.groupBy("shard").applyInPandas(shard, SCHEMA)


def best_fit_packing(
    docs: DataFrame,
    vocabulary: str,
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document with its bin; starts, lengths and offsets count tokens."""
    return pack_lengths(encoded_lengths(docs, vocabulary, id_col, text_col).withColumnRenamed("n_tokens", "n"), capacities, overhead, attention)


def pack_lengths(
    lengths: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
    shard_tokens: int = SHARD_TOKENS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """The same for rows (doc_id, text_hash, n) of lengths already known."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    ship_package(lengths.sparkSession)
    longest = int(max(capacities))
    one = F.lit(1).cast("long")
    rows = checkpointed(lengths.groupBy("doc_id", "text_hash", "n").agg(F.count(one).alias("copies")))
    count = rows.agg(F.sum(F.col("n") * F.col("copies")), F.sum(F.greatest(F.ceil(F.col("n") / longest), one) * F.col("copies"))).first()
    shards = max(1, -(-(count[0] or 0) // shard_tokens), -(-(count[1] or 0) // shard_pieces))
    each = rows.select("doc_id", "text_hash", "n", F.explode(F.sequence(one, F.col("copies"))).alias("copy"))
    pieces = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / longest), F.lit(0).cast("long")))).alias("piece"))
    start = F.col("piece") * longest
    return pack_pieces(
        pieces.select(
            F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards)).alias("shard"),
            "doc_id",
            "text_hash",
            "piece",
            start.alias("start"),
            F.least(F.col("n") - start, F.lit(longest)).alias("length"),
        ),
        capacities,
        overhead,
        attention,
    )
