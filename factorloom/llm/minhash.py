"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Each text gets a digest, a ProbMinHash signature of its weighted shingles
   (:mod:`shingles`) and one key for each band of registers.
2. Texts with equal digests are one node, named by their least doc_id.
3. Nodes that share a band key are candidates.  Every node is first held against one
   pivot of each of its buckets, drawn by a hash of key and node, so that a large bucket
   meets many pivots over the bands.  Each pair is verified on the texts: it is a link
   if its probability Jaccard similarity is the threshold or more.
4. Links make components.  In buckets that still hold several components, every pair
   of nodes of different components is compared inside the task, in blocks: the overlap
   of their shingle distributions, which the similarity can't exceed, goes first, then the
   similarity itself.  Pairs within one component would change nothing.  The components
   that those links join are the classes.

So every candidate pair of the banding is held against the threshold on its texts unless
its ends are in one class anyway; nothing is estimated there and no bucket is cut.  A pair
at a similarity of exactly the threshold shares no band with probability 5e-6.

Defined results
* null texts are empty; texts without words only match texts equal to them;
* rows with one doc_id and one text share a class; different texts of one doc_id have the
  classes of their texts, and those that occur under no lesser id share one; null ids have
  class null;
* one row for each row of the input, ties and repeated rows included;
* an empty table gives no rows; extra columns are never read.

Scale: signatures are map-only, and copies go no further than their digest.  Texts
of candidate pairs cross the network, and once per node and bucket in step 4; pairs are at
most one per node and band.  Step 4 gives links alone; a block holds at most ``BLOCK``
expected nodes and ``BLOCK_BYTES`` expected bytes of text, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, ship_package, small_batches, text_bytes
from .components import connected_components
from .shingles import TEXTS_AT_ONCE, band_keys, prob_minhash, probability_jaccard, weighted_shingles

THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Text bytes worked on at once, unless one text has more; the working arrays are 30 times that.
BATCH_BYTES = 2 << 20
#: Ids that are broadcast at most.
BROADCAST_IDS = 100_000
#: Nodes, and bytes of their texts, per block of a large bucket.
BLOCK = 4096
BLOCK_BYTES = 4 << 20

#: Copies of one text from which its rows are dealt over more parts, and how many.
MANY_COPIES = 100_000
SALTS = 64

SKETCH = "doc_id long, digest string, bands array<long>, n_bytes long"


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest of the text, band keys (none without words) and bytes of the text."""
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in small_batches(batches, 1, BATCH_BYTES):
            for at in range(0, big.num_rows, TEXTS_AT_ONCE):
                batch = big.slice(at, TEXTS_AT_ONCE)
                data, offsets = text_bytes(batch.column(1))
                text, shingle, weight = weighted_shingles(data, offsets)
                winner = prob_minhash(text, shingle, weight, batch.num_rows, bands * rows)
                keys = band_keys(winner, rows)
                some = np.zeros(batch.num_rows, bool)
                some[text] = True
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(offsets, offsets[1:], strict=False)], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1), pa.int64())),
                        pa.array(np.diff(offsets), pa.int64()),
                    ],
                    names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in small_batches(batches, 2, BATCH_BYTES):
            for at in range(0, big.num_rows, TEXTS_AT_ONCE):
                batch = big.slice(at, TEXTS_AT_ONCE)
                sides = []
                for column in (2, 3):
                    text, shingle, weight = weighted_shingles(*text_bytes(batch.column(column)))
                    sides.append((np.searchsorted(text, np.arange(batch.num_rows + 1)), shingle, weight))
                (i, sa, wa), (j, sb, wb) = sides
                like = [
                    probability_jaccard(sa[i[k] : i[k + 1]], wa[i[k] : i[k + 1]], sb[j[k] : j[k + 1]], wb[j[k] : j[k + 1]]) for k in range(batch.num_rows)
                ]
                keep = pa.array(np.array(like) >= threshold - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like).filter(keep)], ["a", "b", "similarity"])

    return run


def _narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the texts that aren't named, where those named are few, by count; else unchanged."""
    named = ids.distinct()
    if named.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(named), "doc_id", "left_semi")


def verified_links(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of the pairs whose texts' probability Jaccard is the threshold or more.

    The pairs are read three times, so they should be stored.
    """
    docs = _narrowed(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    texts = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return texts.mapInArrow(_verified(threshold), "a long, b long, similarity double")


def _across(threshold: float):
    """Links between nodes of different components in one block of a bucket.

    A pair is compared in the bucket of its first common band alone.  Components that a
    link joins count as one from then on.
    """
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        node, component, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        labels, label = np.unique(component, return_inverse=True)
        root = np.arange(len(labels))
        parts = _shingle_lists(table.column("text"))
        size = np.array([len(p[0]) for p in parts])
        ends = np.concatenate([[0], np.cumsum(size)])
        shingles, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        share = np.concatenate([p[1] / p[1].sum() for p in parts])
        mine = np.zeros(len(shingles))
        second = np.flatnonzero(side >= 0)
        found = []
        for i in np.flatnonzero(side <= 0):
            others = second[root[label[second]] != root[label[i]]]
            if side[i] == 0:
                others = others[(side[others] == 1) | (node[others] > node[i])]
            same = bands[others] == bands[i]
            others = others[same.any(axis=1) & (bands[i][same.argmax(axis=1)] == key)]
            if not len(others):
                continue
            own = slice(ends[i], ends[i + 1])
            mine[place[own]] = share[own]
            theirs = np.repeat(ends[others] - np.concatenate([[0], np.cumsum(size[others])[:-1]]), size[others]) + np.arange(size[others].sum())
            overlap = np.add.reduceat(np.minimum(mine[place[theirs]], share[theirs]), np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            mine[place[own]] = 0
            for j in others[overlap >= threshold - 1e-9].tolist():
                one, two = root[label[i]], root[label[j]]
                if one != two and probability_jaccard(*parts[i], *parts[j]) >= threshold - 1e-9:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    root[root == two] = one
        if not found:
            return empty
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _shingle_lists(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, weights) of each text, a bounded number of bytes at a time."""
    out = []
    batch = pa.RecordBatch.from_arrays([column.combine_chunks()], ["text"])
    for big in small_batches(iter([batch]), 0, BATCH_BYTES):
        for at in range(0, big.num_rows, TEXTS_AT_ONCE):
            part = big.slice(at, TEXTS_AT_ONCE)
            text, shingle, weight = weighted_shingles(*text_bytes(part.column(0)))
            cut = np.searchsorted(text, np.arange(part.num_rows + 1))
            out += [(shingle[i:j], weight[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    return out


def _bucket_blocks(members: DataFrame) -> DataFrame:
    """Give each bucket's rows to the cells of a triangle of blocks.

    ``side`` is 0 in cells on the diagonal, -1 for the cell's first block and 1 for its
    second.  A bucket of one block is one cell.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.select(
        "key",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"),
        "node",
        "component",
    )


def near_duplicate_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, copy_of, class_id: the least id with an equal text, and the least id of the class."""
    return _classes(docs, threshold, bands, rows, block, block_bytes, id_col, text_col).drop("digest")


def _classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The near-duplicate classes with the digest of each row's text."""
    docs = documents(docs, id_col, text_col)
    texts = docs.where("doc_id is not null")
    copies = texts.select("doc_id", F.sha2("text", 256).alias("digest"))

    # One row per distinct text; of a repeated id's texts each has a row under that id.
    drawn = sketches(texts, bands, rows).groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "n_bytes")).alias("x"))
    nodes = checkpointed(drawn.select(F.col("x.doc_id").alias("node"), "x.bands", "x.n_bytes"))

    # Only keys of two or more nodes go further than this aggregate and its join.
    keyed = nodes.select("node", "n_bytes", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("key", "node")).alias("pivot")).where("n > 1")
    buckets = checkpointed(keyed.join(shared, "key").select("key", "node", "n_bytes", "n", "pivot"))
    pairs = buckets.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = checkpointed(verified_links(checkpointed(pairs), texts, threshold))
    first = connected_components(links)

    # A bucket of two has had its only pair compared.
    named = first.withColumnRenamed("node", "m")
    members = buckets.where("n > 2").join(named, F.col("node") == F.col("m"), "left").select("key", "node", "n_bytes", F.coalesce("component", "node").alias("component"))
    several = (
        members.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("key", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).alias("blocks"))
    )
    cells = checkpointed(_bucket_blocks(members.join(several, "key")))
    wanted = _narrowed(texts, cells.select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", "node")
    full = cells.join(nodes, "node").join(wanted, "node").select("key", "i", "j", "side", "node", "component", "bands", "text")
    late = checkpointed(full.groupBy("key", "i", "j").applyInArrow(_across(threshold), "a long, b long"))
    named_a, named_b = first.select(F.col("node").alias("a"), F.col("component").alias("ca")), first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bridges = late.join(named_a, "a", "left").join(named_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(bridges).select(F.col("node").alias("component"), F.col("component").alias("joined"))

    groups = copies.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = checkpointed(
        groups.join(first, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(second, "component", "left")
        .select("digest", "n", F.col("node").alias("copy_of"), F.coalesce("joined", "component").alias("class_id"))
    )
    # Rows of large groups of copies are dealt over SALTS parts; such groups are at most one in MANY_COPIES rows.
    large = classes.where(F.col("n") > MANY_COPIES)
    parts = F.when(F.col("n") > MANY_COPIES, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = classes.select("digest", "copy_of", "class_id", F.explode(parts).alias("salt"))
    marked = copies.join(F.broadcast(large.select("digest", F.lit(True).alias("large"))), "digest", "left")
    salted = marked.withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("digest"))
    return salted.join(spread, ["digest", "salt"]).select("doc_id", "copy_of", "class_id", "digest").unionByName(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without all but the one with the least id of each class, all columns kept.

    Of the texts of one doc_id, those that belong to the class of a lesser id go, and of the
    others the one of the least digest stays; rows without an id stay.
    """
    own = _classes(docs, id_col=id_col, text_col=text_col, **settings).where("doc_id = class_id")
    chosen = own.groupBy(F.col("class_id").alias("__id")).agg(F.min("digest").alias("__chosen"))
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).withColumn("__digest", digest)
    met = (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (F.col("__digest") == F.col("__chosen"))
    kept = named.join(chosen, met, "left_semi").dropDuplicates([id_col, "__digest"])
    return kept.select(docs.columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
