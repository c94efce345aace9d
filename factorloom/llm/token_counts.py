"""Token counts for every context limit from one exact histogram of encoded lengths.

Each document is encoded once with a byte-level vocabulary.  Documents are then
aggregated by encoded length, and suffix sums over the distinct lengths answer
totals, quantiles and truncated totals for any context limit:

    kept tokens at limit L = total - tokens_at_least(m) + L * docs_at_least(m)

where m is the least recorded length that is L or more.

Defined results
* null or empty texts have length 0 and count as documents of length 0;
* repeated rows and ties count once per row;
* an empty table gives an empty histogram, and every total is 0;
* other columns are never read, so their names can't clash;
* texts are encoded whole, however long: a run of white space beyond ``LONG_RUN``, which
  the pattern's engine can't hold, is given to the merges as the one piece it is.

Scale: the encoding is map-only; one shuffle moves a row per task and distinct
length.  A document of n tokens costs n tokens of input, so the number of distinct
lengths is at most the square root of twice the total; suffix sums run within
blocks of lengths and then over the block totals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, ship_package, small_batches

#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space characters in a row from which the pattern isn't asked for their piece.
LONG_RUN = 4096
#: Fixed value: Unicode's white space, which the pattern's \s means.
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")
#: Lengths per block of the two-level suffix sums.
BLOCK = 256
#: A vocabulary larger than this is refused, because it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return raw


@lru_cache(maxsize=4)
def make_encoder(raw: bytes):
    """An encoder from the lines "base64 token, rank" of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> list[int]:
    """The ids of a text under :data:`PATTERN`.

    A piece begins where a long run of white space does, since no other piece holds white
    space after its first character.  The run up to its last character is one piece, and
    the last one is left to what follows; at the end of the text the whole run is one.
    """
    if len(text) < LONG_RUN:
        return encoder.encode_ordinary(text)
    ids, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += encoder._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + encoder.encode_ordinary(text[at:])


def encoded_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens and text_hash, a 64-bit hash of the text."""
    spark = docs.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder(raw.value)  # kept by the worker process between tasks
        for batch in small_batches(batches, 1):
            lengths = [len(encode(encoder, text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "text_hash"])

    hashed = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, "doc_id long, n_tokens long, text_hash long")


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs: the exact number of documents of each length."""
    return lengths.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(hist: DataFrame) -> DataFrame:
    """Suffix sums over the histogram, with the answer at each recorded length as a limit."""
    cell = hist.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block")
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # One row per block of lengths: a few thousand for any corpus whose longest text fits a row.
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        cell.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(everything).alias("total_docs"),
            F.sum("t").over(everything).alias("total_tokens"),
        )
    )
    summed = cell.select(
        "block", "n_tokens", "n_docs", F.sum("n_docs").over(within).alias("d"), F.sum("tokens").over(within).alias("t")
    ).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return summed.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_at_least"),
        tokens_ge.alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_tokens"),
        (docs_ge - F.col("n_docs")).alias("docs_truncated"),
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: Iterable[int]) -> DataFrame:
    """context_limit, truncated_tokens, docs_truncated for a stated list of limits."""
    spark: SparkSession = table.sparkSession
    rows = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    joined = rows.join(table, table.n_tokens >= rows.context_limit, "left")
    nearest = joined.groupBy("context_limit").agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("m"), F.min_by("n_docs", "n_tokens").alias("n"), F.min("n_tokens").alias("at")
    )
    total = table.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
    beyond = F.col("m.docs_at_least") - F.when(F.col("at") == F.col("context_limit"), F.col("n")).otherwise(0)
    return nearest.join(F.broadcast(total)).select(  # one row beside a stated list
        "context_limit",
        F.coalesce(F.col("total_tokens") - F.col("m.tokens_at_least") + F.col("context_limit") * F.col("m.docs_at_least"), F.col("total_tokens")).alias("truncated_tokens"),
        F.coalesce(beyond, F.lit(0)).alias("docs_truncated"),
    )


def quantiles(table: DataFrame, probabilities: Iterable[float]) -> DataFrame:
    """probability, n_tokens: the least length that at least that share of documents doesn't exceed."""
    rows = table.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    return rows.join(table, table["quantile"] >= rows.probability - 1e-12, "left").groupBy("probability").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of :func:`limit_table` for the documents' encoded lengths.

    The histogram is read twice, so it is stored; the texts are encoded once.
    """
    return limit_table(checkpointed(histogram(encoded_lengths(docs, vocabulary, id_col, text_col))))
