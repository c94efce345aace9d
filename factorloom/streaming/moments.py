"""Posterior moments as a stream over files of samples.

A chain, or many, writes its samples as rows (iter, idx, v), v being the row's values in
pattern order.  The stream folds them into count, sum and sum of squares for each element,
and into how often a pattern was the row's largest, so the posterior mean, deviation and
marker counts are there at any time without reading old samples again.

The folded sums are the stream's state, kept in its checkpoint.  Every batch writes the
elements that it changed to a folder of its number, which a batch that is repeated after a
failure overwrites, so a restart counts no sample twice and loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SAMPLES = "iter long, idx long, v array<double>"
STATE = "idx long, k int, n long, total double, squares double, top long"


def folded(samples: DataFrame) -> DataFrame:
    """Sums of ``STATE`` over rows (iter, idx, v), streamed or not; of equal largest values the first counts, and nulls don't."""
    largest = F.array_position("v", F.array_max("v")) - 1
    each = samples.select("idx", largest.alias("largest"), F.posexplode("v").alias("k", "x")).where("x IS NOT NULL")
    sums = each.groupBy("idx", "k").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"), F.sum(F.when(F.col("k") == F.col("largest"), 1).otherwise(0)).alias("top"))
    return sums.select(*[F.col(c.split()[0]) for c in STATE.split(", ")])


def fold(spark: SparkSession, samples: str, state: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the stream over the folder ``samples``; it takes what is there, keeps ``state`` up to date, and ends."""
    reader = spark.readStream.schema(SAMPLES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/batch={batch}")

    return folded(reader.parquet(samples)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The sums of every element as of the last batch that changed it."""
    rows = spark.read.schema(STATE + ", batch long").parquet(state)
    held = F.max_by(F.struct("n", "total", "squares", "top"), "batch").alias("s")
    return rows.groupBy("idx", "k").agg(held).select("idx", "k", "s.*")


def moments(spark: SparkSession, state: str) -> DataFrame:
    """idx, k, mean, sd, top: posterior mean and deviation, and the samples in which k was the largest of its row."""
    n, total = F.col("n"), F.col("total")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - total * total / n) / F.when(n > 1, n - 1)))
    return latest(spark, state).select("idx", "k", (total / n).alias("mean"), F.when(n > 1, sd).alias("sd"), "top")
