"""A corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last return
the columns of ``documents``.

1. quality: documents that the quality classifier rejects go;
2. near duplicates: the document with the least id of each class stays;
3. repeats: byte strings of 100 that occur earlier are cut out of the texts;
4. personal data: selected spans are replaced by their kind;
5. packing: texts are packed, by their tokens, into sequences of permitted lengths.

A text that is cut or redacted gets its new length in ``n_chars``; a document whose text
is cut to nothing stays, with the empty text.

Defined results
* null texts count as empty ones: they are judged as such, are near duplicates of each
  other (those without an id stay), and become the empty text in stage 3;
* rows with one doc_id and one text are one document, and one of them stays; of different
  texts under one doc_id that no lesser id has, the one of the least digest stays; rows without an id stay;
* empty tables give empty results of the same columns; columns of other names are carried
  through the stages, whatever they are called, and the last stage leaves them out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import minhash, packing, pii, quality, suffix_dedup
from factorloom.llm.common import shared_checkpoint_dir
from factorloom.llm.queries import VOCABULARY


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return _sized(suffix_dedup.remove_repeats(docs, carry=carried), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(pii.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, VOCABULARY)


STAGES = [
    ("quality", quality_filter),
    ("near duplicates", near_duplicates),
    ("repeats", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]

#: The stages use fitted models and graph iterations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; stages meet in the shared checkpoint folder."""
    folder = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
