"""Inner products of all pairs of columns of a long table, from blocks instead of a join.

Rows (label, idx, value) are brought together by idx, where a pair of labels meets once.
A join would make a row for each pair and idx; here a task adds the products of the idx it
sees into one block of labels by labels, and gives out the block: as many rows as there are
pairs, however long the table.  More labels than ``BLOCK`` are dealt into blocks by a hash,
and pairs of blocks are keys of their own, so no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Labels of a block: a task holds six blocks of its square.
BLOCK = 1024
#: Tasks that share a pair of blocks, at most.
SLICES = 64
#: Cells of the dense rows that are multiplied at once.
CELLS = 1 << 22
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


class _Block:
    """Sums of one pair of blocks of labels."""

    def __init__(self) -> None:
        self.codes: tuple[dict, dict] = ({}, {})
        self.sums = np.zeros((len(_SUMS), 0, 0))

    def _grown(self) -> None:
        rows, columns = (len(c) for c in self.codes)
        if (rows, columns) != self.sums.shape[1:]:
            held = np.zeros((len(_SUMS), rows, columns))
            held[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
            self.sums = held

    def add(self, idx: np.ndarray, left: np.ndarray, labels: list, value: np.ndarray) -> None:
        """Rows of whole idx: ``left`` and ``~left`` say which side a label is on."""
        code = np.array([self.codes[0 if a else 1].setdefault(x, len(self.codes[0 if a else 1])) for a, x in zip(left.tolist(), labels)], np.int64)
        self._grown()
        _, place = np.unique(idx, return_inverse=True)
        step = max(1, CELLS // max(1, max(self.sums.shape[1:])))
        for start in range(0, int(place.max(initial=-1)) + 1, step):
            sides = []
            for side, width in ((left, self.sums.shape[1]), (~left, self.sums.shape[2])):
                own = side & (place >= start) & (place < start + step)
                there, x = (np.zeros((min(step, int(place.max()) + 1 - start), width)) for _ in range(2))
                there[place[own] - start, code[own]] = 1
                x[place[own] - start, code[own]] = value[own]
                sides.append((there, x))
            (ma, xa), (mb, xb) = sides
            self.sums += np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        names = [pa.array(list(c), kind) for c in self.codes]
        a, b = np.nonzero(self.sums[0])
        return pa.record_batch([names[0].take(pa.array(a)), names[1].take(pa.array(b)), *[pa.array(s[a, b]) for s in self.sums]], ["a", "b", *_SUMS])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by pair of blocks and idx."""
    held, key, kind, rest = None, None, None, None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        kind = batch.column(4).type
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        idx = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        ends = [*cuts.tolist(), batch.num_rows]
        # the last idx may go on in the next batch
        last = int(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (idx[1:] != idx[:-1])])[-1])
        for start, end in zip([0, *cuts.tolist()], ends):
            end = min(end, last)
            if start < end:
                if key != tuple(keys[start]):
                    if held is not None:
                        yield held.rows(kind)
                    held, key = _Block(), tuple(keys[start])
                part = batch.slice(start, end - start)
                held.add(idx[start:end], part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_pylist(), part.column(5).to_numpy(zero_copy_only=False))
        rest = batch.slice(last)
    if rest is not None and rest.num_rows:
        first = tuple(rest.column(i)[0].as_py() for i in (0, 1))
        if held is not None and key != first:
            yield held.rows(kind)
            held = None
        held = held or _Block()
        held.add(rest.column(2).to_numpy(zero_copy_only=False), rest.column(3).to_numpy(zero_copy_only=False), rest.column(4).to_pylist(), rest.column(5).to_numpy(zero_copy_only=False))
    if held is not None:
        yield held.rows(kind)


def inner_products(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, n, sa, sb, saa, sbb, sab: sums over the idx that two labels share, of rows (label, idx, value).

    Every pair of labels that share an idx comes once, in one of its two orders, and every
    label with itself.  A label has one value for an idx.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind = rows.schema["label"].dataType.simpleString()
    n_labels = rows.select("label").distinct().count()
    blocks = max(1, -(-n_labels // block))
    own = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    keyed = rows.select(own.alias("own"), "label", "idx", F.col("value").cast("double").alias("value"))
    # a label of block x is a left one for the pairs (x, y) with y >= x, and a right one for (y, x) with y <= x
    left = keyed.withColumn("hi", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1)))).select(F.col("own").alias("lo"), "hi", "idx", F.lit(True).alias("left"), "label", "value")
    right = keyed.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("own")))).select("lo", F.col("own").alias("hi"), "idx", F.lit(False).alias("left"), "label", "value")
    met = left.unionByName(right).repartition("lo", "hi", F.pmod(F.xxhash64("idx"), F.lit(SLICES))).sortWithinPartitions("lo", "hi", "idx")
    sums = met.mapInArrow(_blocks, f"a {kind}, b {kind}, " + ", ".join(f"{s} double" for s in _SUMS))
    once = sums.where("a <= b") if blocks == 1 else sums.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", *[F.when(F.col("a") <= F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("sa", "sb"), ("sb", "sa"), ("saa", "sbb"), ("sbb", "saa"))], "sab", (F.col("a") > F.col("b")).alias("swapped"))
    if blocks > 1:
        # within one block both orders of a pair come; across blocks one does
        once = once.withColumn("same", F.pmod(F.xxhash64("a"), F.lit(blocks)) == F.pmod(F.xxhash64("b"), F.lit(blocks))).where("NOT (same AND swapped)")
    return once.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def correlations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, r of rows (label, idx, value): Pearson's correlation over the idx that both have, in both orders.

    Null where one of the two doesn't vary.  Values are taken from their label's mean
    first, so that large means cost no digits.
    """
    means = rows.groupBy("label").agg(F.avg("value").alias("mean"), (F.max("value") == F.min("value")).alias("flat"))
    centred = rows.join(means.where("NOT flat"), "label").select("label", "idx", (F.col("value") - F.col("mean")).alias("value"))
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va, vb = F.col("saa") - sa * sa / n, F.col("sbb") - sb * sb / n
    r = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.greatest(F.least((F.col("sab") - sa * sb / n) / F.sqrt(va * vb), F.lit(1.0)), F.lit(-1.0)))
    half = inner_products(centred, block).where((va > 0) & (vb > 0)).select("a", "b", r.alias("r"))
    return half.unionByName(half.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
