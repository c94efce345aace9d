"""Quality by hierarchical empirical Bayes: document evidence and site posteriors.

1. Numbers that describe a text's surface (case, symbols, repetition, word and line
   shapes) are computed in one pass.
2. Boosted trees (:mod:`boosting`) turn them into a calibrated probability of good
   quality.  They are fitted on at most ``TRAINING_ROWS`` labelled rows, the ones with
   the least hashes of their ids; everything else uses all rows.
3. Grouped sums give each host and each path within a host the mean of its documents'
   probabilities.  Variances within and between sites, by the method of moments, give
   the strength of each prior; hosts shrink toward the global mean and paths toward
   their host, the more the fewer documents they have.
4. A document's posterior odds are its own odds times its path's prior odds over the
   global ones, with the document itself left out of its path's mean.

Defined results
* null or empty texts have no good words; they get what the trees give an empty text;
* null hosts and paths are sites of their own;
* without labels of both classes nothing can be fitted: all probabilities are 0.5 and
  everything is kept;
* fewer than ``FEW`` labelled rows are too few to calibrate on: the trees are fitted, and
  only their ridge and least leaf shrink them;
* repeated rows and ties stay; an empty table gives no rows; other columns are not read
  by the scoring and are carried through by the filter.

Scale: scoring shuffles no texts.  Sites are pre-aggregated in each task, so a host with a
third of all rows is a row per task; the table of sites is broadcast only if its counted
rows are at most ``BROADCAST_SITES``.  Beyond that, rows without texts are joined to their
sites, salted so that a hot site spreads, and the filter then shuffles texts once, evenly,
by id and hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import checkpointed, ship_package, small_batches, text_bytes
from .shingles import word_hashes

TRAINING_ROWS = 6000
FEW = 20
THRESHOLD = 0.5
BROADCAST_SITES = 20_000
N_FEATURES = 16
#: Parts of each site in the join of many sites.
SALTS = 32


def surface(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x N_FEATURES numbers from the bytes of texts end to end."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1).astype(np.float64)
    kind = _KINDS[data]
    counts = np.zeros((n, 8))
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    word, first = word_hashes(data, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words).astype(np.uint64)
    tagged = np.sort(owner << np.uint64(44) | word >> np.uint64(20))
    new = np.ones(len(tagged), bool)
    new[1:] = tagged[1:] != tagged[:-1]
    distinct = np.bincount((tagged[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    inner = first[:-1][words > 0]
    same[inner] = False
    again = np.bincount(owner.astype(np.int64), weights=same, minlength=n)
    ends = np.flatnonzero(data == 10)
    line = _line_repeats(data, offsets, ends)
    some_words = np.maximum(words, 1).astype(np.float64)
    return np.column_stack(
        [
            np.log1p(size),
            counts[:, _UPPER] / some,
            counts[:, _LOWER] / some,
            counts[:, _DIGIT] / some,
            counts[:, _SPACE] / some,
            counts[:, _STOP] / some,
            counts[:, _BANG] / some_words,
            counts[:, _SYMBOL] / some_words,
            counts[:, _OTHER] / some,
            np.log1p(words),
            size / some_words,
            distinct / some_words,
            again / some_words,
            line,
            counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1),
            counts[:, _STOP] / some_words,
        ]
    )


_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BANG, _SYMBOL, _OTHER = range(8)
_KINDS = np.full(256, _SYMBOL, np.uint8)
_KINDS[128:] = _OTHER
_KINDS[list(range(65, 91))] = _UPPER
_KINDS[list(range(97, 123))] = _LOWER
_KINDS[list(range(48, 58))] = _DIGIT
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[[ord(c) for c in ".,;:'\"()-"]] = _STOP
_KINDS[[ord(c) for c in "!?"]] = _BANG


def _line_repeats(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The share of each text's lines that occur in it before."""
    out = np.zeros(len(offsets) - 1)
    raw = data.tobytes()
    lines = np.searchsorted(ends, offsets)
    for k in np.flatnonzero(np.diff(lines) > 0):
        parts = raw[offsets[k] : offsets[k + 1]].split(b"\n")
        out[k] = 1 - len(set(parts)) / len(parts)
    return out


def described(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path and the text's numbers."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3, 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _vectors(batch.column(3))], ["doc_id", "host", "path", "numbers"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, numbers array<float>")


def _vectors(column: pa.Array) -> pa.Array:
    x = surface(*text_bytes(column)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.reshape(-1)))


def fit_document_model(rows: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> boosting.Model | None:
    """Trees fitted on at most ``most`` labelled rows; none without both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    sample = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most).select("numbers", "good").toPandas()
    y = sample["good"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack(sample["numbers"].to_numpy()).astype(np.float64)
    if len(y) < FEW:
        return boosting.fit(x, y, trees=40, least=0.2)
    return boosting.fit_calibrated(x, y, trees=40, least=0.2)


def _probability(model: boosting.Model | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else np.clip(model.probability(x), 1e-6, 1 - 1e-6)


def with_evidence(rows: DataFrame, model: boosting.Model | None) -> DataFrame:
    """doc_id, host, path, p: the document's own probability of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_probability(model, x))], ["doc_id", "host", "path", "p"])

    return rows.select("doc_id", "host", "path", "numbers").mapInArrow(run, "doc_id long, host string, path string, p double")


@dataclass(frozen=True)
class Priors:
    mean: float
    host_strength: float
    path_strength: float


def strengths(paths: DataFrame) -> Priors:
    """Global mean and prior strengths by the method of moments, from sums over sites.

    A strength is the variance within sites over the variance between them: how many
    documents a site needs for its own mean to count as much as its parent's.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    row = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum("paths").alias("paths"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("host_b"),
        F.sum(F.col("n") * F.col("n")).alias("host_nn"),
        F.sum("b").alias("path_b"),
        F.sum(F.col("nn") / F.col("n")).alias("path_nn"),
    ).first()
    n, s = row["n"] or 0, row["s"] or 0.0
    if not n:
        return Priors(0.5, 1.0, 1.0)
    within = max((row["q"] - row["path_b"]) / max(n - row["paths"], 1), 1e-9)

    def strength(between: float, groups: int, effective: float) -> float:
        variance = (between - groups * within) / effective if effective > 0 and groups > 0 else 0.0
        return within / variance if variance > within * 1e-6 else 1e6

    host = strength(row["host_b"] - s * s / n, row["hosts"] - 1, n - row["host_nn"] / n)
    path = strength(row["path_b"] - row["host_b"], row["paths"] - row["hosts"], n - row["path_nn"])
    return Priors(s / n, host, path)


def site_table(evidence: DataFrame) -> tuple[DataFrame, Priors]:
    """host, path, n, s, host_n, host_s of every path, and the priors."""
    paths = checkpointed(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")).withColumnRenamed("host", "h")
    table = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "s", "host_n", "host_s")
    return table, strengths(paths)


def few_sites(sites: DataFrame) -> bool:
    return sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES


def posteriors(evidence: DataFrame, sites: DataFrame, priors: Priors) -> DataFrame:
    """The rows of the evidence with p_host, p_path and p_posterior."""
    table = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "s", "host_n", "host_s")
    same = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    if few_sites(sites):
        joined = evidence.join(F.broadcast(table), same)
    else:
        spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = evidence.withColumn("own_salt", F.pmod(F.xxhash64(*evidence.columns), F.lit(SALTS)).cast("int"))
        joined = dealt.join(spread, same & (F.col("own_salt") == F.col("salt"))).drop("own_salt", "salt")
    own, mean = F.col("p"), F.lit(priors.mean)
    # The document itself is left out, so its evidence counts once.
    p_host = (F.col("host_s") - own + priors.host_strength * mean) / (F.col("host_n") - 1 + priors.host_strength)
    p_path = (F.col("s") - own + priors.path_strength * F.col("p_host")) / (F.col("n") - 1 + priors.path_strength)
    odds = lambda p: F.log(F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))))
    return (
        joined.withColumn("p_host", p_host)
        .withColumn("p_path", p_path)
        .withColumn("p_posterior", 1 / (1 + F.exp(-(odds(own) + odds(F.col("p_path")) - odds(mean)))))
        .drop("site_host", "site_path", "n", "s", "host_n", "host_s")
    )


def default_site(docs: DataFrame) -> tuple[Column, Column]:
    """The source as the host and its language section as the path."""
    return F.col("source"), F.col("lang")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, p_document, p_host, p_path, p_posterior, keep: one row for each document."""
    if host is None or path is None:
        host, path = default_site(docs)
    rows = checkpointed(described(docs, host, path))
    evidence = with_evidence(rows, fit_document_model(rows, labels, most))
    sites, priors = site_table(evidence)
    scored = posteriors(evidence, sites, priors)
    return scored.select("doc_id", F.col("p").alias("p_document"), "p_host", "p_path", "p_posterior", (F.col("p_posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """The documents whose posterior reaches the threshold, with their columns and whole rows.

    With few sites the texts are read a second time beside their numbers instead of being
    shuffled.  With many, texts and verdicts meet by id and a hash of the text: rows that
    are equal in both, in host and in path have one verdict.
    """
    if host is None or path is None:
        host, path = default_site(docs)
    rows = checkpointed(described(docs, host, path))
    model = fit_document_model(rows, labels, most)
    sites, priors = site_table(with_evidence(rows, model))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 2 << 20):
            x = surface(*text_bytes(batch.column(text))).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_probability(model, x))], [*batch.schema.names, "__p"])

    sited = docs.withColumn("__host", host.cast("string")).withColumn("__path", path.cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sited.schema)
    beside = sited.mapInArrow(run, f"{schema}, __p double")
    own = [F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__p").alias("p")]
    if few_sites(sites):
        return posteriors(beside.select(F.struct(*docs.columns).alias("row"), *own), sites, priors).where(F.col("p_posterior") >= threshold).select("row.*")
    keys = [F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash")]
    scored = posteriors(beside.select(*keys, *own), sites, priors).where(F.col("p_posterior") >= threshold)
    good = scored.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), F.col("host").alias("__s"), F.col("path").alias("__q")).distinct()
    keyed = sited.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    met = F.col("__hash") == F.col("__h")
    for left, right in (("doc_id", "__i"), ("__host", "__s"), ("__path", "__q")):
        met = met & F.col(left).eqNullSafe(F.col(right))
    return keyed.join(good, met, "left_semi").select(docs.columns)
