"""Ranked lexical search by Fagin's threshold algorithm.

Documents are scored by the terms they share with an item (a query text), by term weights
and a saturated, length-normalised term frequency in whole numbers.  Terms are maximal runs
of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.

Each task indexes blocks of its documents: for each term the documents by descending impact
(what the term adds to a score), and forward the impacts of each document's terms.  An item's
lists are read round-robin, some entries at a time; every document that turns up gets its
whole score by look-ups in the forward index.  The impacts at which the lists stand sum to a
threshold that no document still unseen can pass, and when it is strictly less than the
tenth best score so far, the block is done.  Best scores are carried from block to block,
so later blocks stop early.  The best of all tasks are ranked in one window for each item.

Defined results
* null texts, and texts without terms, have none: such documents don't count and are never
  found, such items find nothing;
* every row is a document, whatever its id; equal scores go by ascending doc_id, nulls first;
  items with one item_id are ranked together, rows of one id and text once, of several texts by
  ``item_text``'s order; an empty table gives an empty result; extra columns are never read.

Scale: documents are read once and written as (doc_id, length, item terms, frequencies) to
the shared checkpoint folder, since weights need the corpus' counts first.  Only partial
sums, and ten rows an item and task, are shuffled.  Items are taken in blocks of ``ITEM_BYTES``
of text, which are broadcast; each block of items reads the documents once.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_checkpoint_dir, ship_package, small_batches, text_bytes

TOP = 10
#: Fixed values of the score.
B_PERCENT, K_TIMES_TEN, SCALE = 90, 8, 1_000_000_000
#: Most text of the items that one pass over the documents takes.
ITEM_BYTES = 1 << 20
#: Most cells (terms x documents) of one block of the forward index.
BLOCK_CELLS = 8 << 20
#: Entries that are read of each list before the next look-ups.
STEP = 32

_FOLD = bytes(32 if i < 128 and not chr(i).isalnum() else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of this weight and frequency adds to the score of a document of n terms."""
    m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_terms
    return weights * ((SCALE * tf) // (1000 * tf + K_TIMES_TEN * m))


def _forward(known):
    """Of each document its number of terms, and those of them that items have, with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(known.value)}
        for batch in small_batches(batches, 1):
            ids, lengths, held, counts, ends = [], [], [], [], [0]
            raw, offsets = text_bytes(batch.column(1))
            raw = raw.tobytes()
            for doc_id, start, end in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                found = terms_of(raw[start:end])
                if not found:
                    continue
                tf = Counter(found)
                here = tf.keys() & numbers.keys()
                ids.append(doc_id)
                lengths.append(len(found))
                held.extend([numbers[t] for t in here])
                counts.extend([tf[t] for t in here])
                ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)) for values, kind in ((held, pa.int32()), (counts, pa.int64()))]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The best documents of one item so far, by (descending score, ascending id with null first)."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if self.full:
            better = scores >= self.least
            scores, ids, null = scores[better], ids[better], null[better]
        if not len(scores):
            return
        scores, ids, null = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.null, null]
        order = np.lexsort((ids, ~null, -scores))[: self.top]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]

    @property
    def full(self) -> bool:
        return len(self.scores) == self.top

    @property
    def least(self) -> int:
        return int(self.scores[-1])


class Block:
    """Documents with the impacts of their terms: lists by descending impact, and forward by document."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.null = ids, null
        self.forward = np.zeros((len(ids), n_terms), np.int64)
        self.forward[document, term] = impact
        order = np.lexsort((document, -impact, term))
        self.documents, self.impacts = document[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, best: Best, step: int = STEP) -> int:
        """Add this block's documents to an item's best; how many documents were looked up."""
        begin, end = self.starts[terms], self.starts[terms + 1]
        fresh = np.ones(len(self.ids), bool)
        looked, depth = 0, 0
        while True:
            at = begin + depth
            # an exhausted list stands at nothing
            standing = np.where(at < end, self.impacts[np.minimum(at, max(len(self.impacts) - 1, 0))], 0) if len(self.impacts) else np.zeros(len(terms), np.int64)
            threshold = int(standing.sum())
            if threshold <= 0 or best.full and threshold < best.least:
                return looked
            seen = np.concatenate([self.documents[a:b] for a, b in zip(at.tolist(), np.minimum(at + step, end).tolist()) if a < b])
            seen = np.unique(seen[fresh[seen]])
            fresh[seen] = False
            looked += len(seen)
            scores = self.forward[seen][:, terms].sum(axis=1)
            found = scores > 0
            best.take(scores[found], self.ids[seen[found]], self.null[seen[found]])
            depth += step


def _ranked(asked, top: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = asked.value
        rows = max(1, BLOCK_CELLS // max(len(weights), 1))
        best = [Best(top) for _ in items]
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                terms, tfs = (part.column(i) for i in (2, 3))
                n = part.column(1).to_numpy(zero_copy_only=False)
                document = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                term, tf = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, tfs))
                ids, null = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False)
                block = Block(ids, null, document, term, impacts(tf, n[document], weights[term], n_docs, n_terms), len(weights))
                for (_, wanted), held in zip(items, best):
                    block.search(wanted, held, step)
        made = [(item, i, n, s) for (item, _), b in zip(items, best) for i, n, s in zip(b.ids.tolist(), b.null.tolist(), b.scores.tolist())]
        yield pa.record_batch(
            [pa.array([m[0] for m in made], pa.int64()), pa.array([None if m[2] else m[1] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64())],
            ["item", "doc_id", "score"],
        )

    return run


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, int | None, str]]]:
    """(number, item_id, text) of all items, by blocks of bounded text."""
    held, size = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        held.append((number, row["item_id"], row["text"]))
        size += len(row["text"].encode())
        if size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", step: int = STEP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``top`` documents of the highest scores above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = documents(docs, id_col, text_col)
    wanted = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")).distinct().orderBy("item_id", "text")
    out = spark.createDataFrame([], "item_id long, item long, doc_id long, score long")
    for block in _item_blocks(wanted):
        found = [(number, sorted(set(terms_of(text.encode())))) for number, _, text in block]
        vocabulary = sorted({t for _, ts in found for t in ts})
        place = f"{shared_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
        known = spark.sparkContext.broadcast(vocabulary)
        texts.mapInArrow(_forward(known), "doc_id long, n long, terms array<int>, tfs array<long>").write.parquet(place)
        forward = spark.read.parquet(place)
        n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        numbers = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros(len(vocabulary), np.int64)
        # at most a row for each term of this block of items
        for term, df in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = weight(n_docs, df)
        asked = spark.sparkContext.broadcast(([(number, np.array([numbers[t] for t in ts], np.int64)) for number, ts in found if ts], weights, n_docs, n_terms))
        ids = spark.createDataFrame([(number, item_id) for number, item_id, _ in block], "item long, item_id long")
        best = forward.mapInArrow(_ranked(asked, top, step), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        top_rows = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = out.unionByName(top_rows.join(F.broadcast(ids), "item").select("item_id", "item", "doc_id", "score"))
    # items of one id share a ranking
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "item")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
