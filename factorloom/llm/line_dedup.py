"""Line dedup that follows a corpus: lines that many documents share lose all their copies.

A line's key is the line without white space at both ends and with A-Z lower-cased.  A
:class:`LineStore` holds, for each key (by its digest of 128 bits), the exact number of
documents that have it.  Keys in at least ``min_docs`` documents are frequent; each shard
of keys has a cuckoo filter of its frequent ones.  Inserting documents adds to the counts,
deleting them subtracts; a key that thereby becomes frequent is added to its shard's
filter, one that ceases to be is removed from it.  Inserting documents and deleting them
again gives the counts and answers from before, and every update is a version of its own
that :meth:`LineStore.revert` goes back to.

:meth:`LineStore.deduplicate` holds every line against the filters, and the lines they
report against the exact counts, so no line is dropped or kept by a filter's error.

Defined results
* a null text is an empty one, and an empty text is one empty line; lines without a key of
  ``min_chars`` code points are always kept;
* every row is a document, whatever its id: repeated rows count, and are deduplicated, once each;
* other columns are carried if they are named, and never read otherwise; an empty table
  gives an empty result, and a store of it has no keys;
* deleting documents that were not inserted raises an error and leaves the store as it was.

Scale: counting shuffles one row of 24 bytes for each distinct line of each batch, summed
before the shuffle, so a line that is in every document is a row a batch.  Deduplication is
map-only while the frequent keys are at most ``exact_keys``: filters and exact keys are
broadcast then.  Beyond that the keys in at least 1 / ``exact_keys`` of all (document,
frequent key) pairs, of which there can't be more than ``exact_keys``, are broadcast, and
the others, none of which has many documents, are looked up by a shuffle of digests; the
filters are broadcast, against needless look-ups, as long as they have ``FILTER_BYTES`` at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, input_bytes, ship_package, small_batches
from .cuckoo import CuckooFilter, pairs

MIN_DOCS = 10
MIN_CHARS = 1
#: Stored bytes of text that a shard is made for.
SHARD_BYTES = 1 << 30
LEAST_SHARDS = 64
#: Most keys that are broadcast, at 16 bytes each.
EXACT_KEYS = 2_000_000
FILTER_BYTES = 64 << 20
_WHITE = b" \t\n\v\f\r"


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The digest of each line's key, None for a key that is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_WHITE).lower()
        short = len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars
        out.append(None if short else blake2b(key, digest_size=16).digest())
    return out


def _texts(batch: pa.RecordBatch, index: int) -> list[bytes]:
    return batch.column(index).cast(pa.large_binary()).to_pylist()


def _key_counts(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            found: Counter = Counter()
            for text in _texts(batch, 0):
                found.update({k for k in line_keys(text, min_chars) if k})
            yield pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"])

    return run


class _Keys:
    """Exact membership of digests in a sorted list."""

    def __init__(self, digests: bytes):
        held = pairs(digests)
        self.keys = held[np.lexsort((held[:, 1], held[:, 0]))]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        first, last = (np.searchsorted(self.keys[:, 0], keys[:, 0], side) for side in ("left", "right"))
        out = np.zeros(len(keys), bool)
        for step in range(int((last - first).max(initial=0))):
            at = np.minimum(first + step, last - 1)
            out |= (first < last) & (self.keys[at, 1] == keys[:, 1])
        return out


class _Looked:
    """What a task holds against its lines: filters by shard, and digests known to be frequent."""

    def __init__(self, filters: list[tuple[int, bytes]] | None, exact: bytes, shards: int):
        self.filters = None if filters is None else {shard: CuckooFilter.stored(raw) for shard, raw in filters}
        self.exact, self.shards = _Keys(exact), shards

    def reported(self, keys: np.ndarray) -> np.ndarray:
        """Which keys the filters report; all, if there are no filters."""
        if self.filters is None:
            return np.ones(len(keys), bool)
        shard, out = (keys[:, 1] >> np.uint64(32)) % np.uint64(self.shards), np.zeros(len(keys), bool)
        order = np.argsort(shard, kind="stable")
        for number, at in zip(*_runs(shard[order], order)):
            if int(number) in self.filters:
                out[at] = self.filters[int(number)].contains(keys[at])
        return out


def _runs(values: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    starts = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    return values[starts], np.split(carried, starts[1:]) if len(starts) else []


def _shard(key: str, shards: int):
    """The shard of a digest: bits that neither fingerprint nor bucket uses."""
    word = F.concat(*[F.substring(key, i, 1) for i in (16, 15, 14, 13)])
    return (F.conv(F.hex(word), 16, 10).cast("long") % shards).cast("int")


def _lines_of(batch: pa.RecordBatch, min_chars: int) -> tuple[list[bytes], list[list[bytes | None]], np.ndarray, np.ndarray]:
    """Texts, the digests of their lines, and of all lines that have one the digest and the text's place."""
    texts = _texts(batch, 0)
    lines = [line_keys(t, min_chars) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [sum(k is not None for k in ks) for ks in lines])
    return texts, lines, pairs(b"".join(k for ks in lines for k in ks if k)), owner


def _kept(text: bytes, keys: Sequence[bytes | None], drop: set[bytes]) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    left = [line for line, key in zip(lines, keys) if key is None or key not in drop]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _apply(looked, min_chars: int, listed: bool):
    """Texts without the lines that are known to be frequent; ``listed``: column 1 has more such digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Looked(*looked.value)
        for batch in small_batches(batches, 0):
            texts, lines, keys, _ = _lines_of(batch, min_chars)
            seen = np.zeros(len(keys), bool)
            at = np.flatnonzero(known.reported(keys))
            seen[at] = known.exact.contains(keys[at])
            drop = {keys[i].tobytes() for i in np.flatnonzero(seen)}
            more = batch.column(1).to_pylist() if listed else [None] * len(texts)
            done = [_kept(t, ks, drop.union(m) if m else drop) for t, ks, m in zip(texts, lines, more)]
            made = [pa.array([d[0] for d in done], pa.binary()).cast(pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))]
            yield pa.record_batch([*made, *batch.columns[1 + listed :]], ["text", "n_lines", "n_dropped", *batch.schema.names[1 + listed :]])

    return run


def _unsettled(looked, min_chars: int):
    """For each text the reported digests that aren't known to be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Looked(*looked.value)
        for batch in small_batches(batches, 0):
            _, _, keys, owner = _lines_of(batch, min_chars)
            at = np.flatnonzero(known.reported(keys))
            at = at[~known.exact.contains(keys[at])]
            found = sorted({(int(owner[i]), keys[i].tobytes()) for i in at})
            names = batch.column(1).to_pylist()
            yield pa.record_batch([pa.array([names[i] for i, _ in found], pa.string()), pa.array([k for _, k in found], pa.binary())], ["text_md5", "key"])

    return run


def _updated(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its keys' changes."""
    stored = rows["slots"].dropna()
    keys = rows[rows["key"].notna()]
    changed = lambda now, before: pairs(b"".join(keys.loc[(keys["now"] == now) & (keys["before"] == before), "key"]))
    held = CuckooFilter.stored(stored.iloc[0]) if len(stored) else None
    if held is not None:
        held.remove(changed(False, True))
    if held is None or not held.add(changed(True, False)):
        held = CuckooFilter.built(pairs(b"".join(keys.loc[keys["now"], "key"])))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n_keys": [len(held)], "slots": [held.raw()]})


class LineStore:
    """Counts and filters of the lines of a changing set of documents, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, exact_keys: int = EXACT_KEYS):
        """Open the store in ``folder``, or prepare a new one; ``shards`` follows the first documents if it isn't given."""
        self.spark, self.folder, self.exact_keys = spark, folder, exact_keys
        self.min_docs, self.min_chars, self.shards, self.version, self.last = min_docs, min_chars, shards, 0, 0
        try:
            log = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("entry")).first()
        except AnalysisException:
            log = None
        if log is not None:
            if (log["min_docs"], log["min_chars"]) != (min_docs, min_chars):
                raise ValueError(f"the store was made for min_docs={log['min_docs']}, min_chars={log['min_chars']}")
            self.version, self.last, self.shards = log["version"], log["entry"], log["shards"]

    def _commit(self, version: int, action: str) -> None:
        row = (self.last + 1, version, action, self.shards, self.min_docs, self.min_chars)
        self.spark.createDataFrame([row], "entry long, version long, action string, shards long, min_docs long, min_chars long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        self.version, self.last = version, self.last + 1

    def counts(self) -> DataFrame:
        """shard, key, n_docs: in how many documents each key is."""
        return self._table("counts", "shard int, key binary, n_docs long, was long").where("n_docs > 0").select("shard", "key", "n_docs")

    def filters(self) -> DataFrame:
        """shard, n_keys, slots: the filter of each shard's frequent keys."""
        return self._table("filters", "shard int, n_keys long, slots binary")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v{self.version}/{name}")

    def insert(self, docs: DataFrame, text_col: str = "text") -> None:
        self._update(docs, text_col, 1, "insert")

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        """Take out documents, which are given as they were inserted."""
        self._update(docs, text_col, -1, "delete")

    def revert(self) -> None:
        """Go back to the version before this one."""
        if not self.version:
            raise ValueError("there is no earlier version")
        entries = self.spark.read.parquet(f"{self.folder}/versions")
        made = entries.where((F.col("version") == self.version) & (F.col("action") != "revert")).agg(F.min("entry")).first()[0]
        before = entries.where(F.col("entry") < made).orderBy(F.desc("entry")).first()
        self._commit(before["version"] if before else 0, "revert")

    def _update(self, docs: DataFrame, text_col: str, sign: int, action: str) -> None:
        ship_package(self.spark)
        texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        if self.shards is None:
            # where Catalyst knows no size the bytes are counted
            size = input_bytes(texts) or texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            self.shards = 1 << max(LEAST_SHARDS.bit_length() - 1, (-(-size // SHARD_BYTES)).bit_length())
        place = f"{self.folder}/v{self.last + 1}"
        change = texts.mapInArrow(_key_counts(self.min_chars), "key binary, n long").groupBy("key").agg((sign * F.sum("n")).alias("change"))
        moved = change.select("key", F.lit(0).cast("long").alias("was"), "change")
        if self.version:
            old = self.counts().select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("change"))
            moved = old.unionByName(moved).groupBy("key").agg(F.sum("was").alias("was"), F.sum("change").alias("change"))
        moved.select(_shard("key", self.shards).alias("shard"), "key", (F.col("was") + F.col("change")).alias("n_docs"), "was").write.mode("overwrite").parquet(f"{place}/counts")
        written = self.spark.read.schema("shard int, key binary, n_docs long, was long").parquet(f"{place}/counts")
        if sign < 0 and written.where("n_docs < 0").limit(1).count():
            raise ValueError("documents are deleted that were not inserted")
        frequent = written.select("shard", "key", (F.col("n_docs") >= self.min_docs).alias("now"), (F.col("was") >= self.min_docs).alias("before")).where("now OR before")
        rows = frequent.withColumn("slots", F.lit(None).cast("binary")).unionByName(self.filters().select("shard", "slots"), allowMissingColumns=True)
        rows.groupBy("shard").applyInPandas(_updated, "shard int, n_keys long, slots binary").write.mode("overwrite").parquet(f"{place}/filters")
        self._commit(self.last + 1, action)

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, text without the lines whose keys are frequent, n_lines, n_dropped, and the carried columns."""
        ship_package(self.spark)
        own = ("doc_id", "text", "n_lines", "n_dropped")
        texts = documents(docs, id_col, text_col).select("text", F.col("doc_id"))
        if carry:
            # under numbers of their own, so that no name can clash
            texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)])
        held = self.filters().agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()
        filters = [(r["shard"], bytes(r["slots"])) for r in self.filters().select("shard", "slots").collect()] if held[1] <= FILTER_BYTES else None
        frequent = self.counts().where(F.col("n_docs") >= self.min_docs)
        known = frequent
        if held[0] > self.exact_keys:
            documents_of = frequent.agg(F.sum("n_docs")).first()[0]
            known = frequent.where(F.col("n_docs") > documents_of // self.exact_keys)
        exact = b"".join(known.select("key").toArrow().column(0).to_pylist())
        looked = self.spark.sparkContext.broadcast((filters, exact, self.shards or 1))
        schema = ", ".join(["text string, n_lines long, n_dropped long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:]]])
        if held[0] <= self.exact_keys:
            made = texts.mapInArrow(_apply(looked, self.min_chars, False), schema)
        else:
            named = texts.withColumn("text_md5", F.md5("text"))
            asked = named.select("text", "text_md5").mapInArrow(_unsettled(looked, self.min_chars), "text_md5 string, key binary").distinct()
            rest = asked.join(frequent.where(F.col("n_docs") <= documents_of // self.exact_keys).select("key"), "key").groupBy("text_md5").agg(F.collect_list("key").alias("listed"))
            made = named.join(rest, "text_md5", "left").select("text", "listed", *texts.columns[1:]).mapInArrow(_apply(looked, self.min_chars, True), schema)
        return made.select(*own, *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])


def dedup_digests(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", **store) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of documents that are all of a new store's."""
    lines = LineStore(docs.sparkSession, folder, **store)
    lines.insert(docs, text_col)
    return lines.deduplicate(docs, id_col, text_col).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
