"""Consensus patterns: correlation (:mod:`gram`), clustering (:mod:`trees`) and weighted means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed
from . import gram, trees


def pattern_correlations(patterns: DataFrame) -> DataFrame:
    """a, b, r over rows (pattern, idx, value)."""
    return gram.correlations(patterns.select(F.col("pattern").alias("label"), "idx", "value"))


def cluster(correlations: DataFrame, cut: int, least: int, most: int) -> DataFrame:
    """pattern, cluster of rows (a, b, r): the complete-linkage tree on 1 - r, cut into clusters of bounded size.

    Patterns are numbered by their names, and clusters by their first pattern.
    """
    names = checkpointed(correlations.where("a = b").select(F.col("a").alias("pattern")))
    # one row per pattern
    numbered = checkpointed(names.select("pattern", (F.row_number().over(Window.orderBy("pattern")) - 1).cast("long").alias("idx")))
    ends = [numbered.select(F.col("pattern").alias(end), F.col("idx").alias(to)) for end, to in (("a", "x"), ("b", "y"))]
    distances = correlations.where("a < b").join(ends[0], "a").join(ends[1], "b").select("x", "y", (1 - F.col("r")).alias("d"))
    tree = trees.agglomerate(numbered, distances, "complete")
    return trees.bounded_clusters(checkpointed(tree), cut, least, most).join(numbered, "idx").select("pattern", "cluster")


def correlation_to_mean(clustered: DataFrame) -> DataFrame:
    """cluster, pattern, r: each pattern's correlation with its cluster's mean, to 3 digits."""
    mean = F.avg("value").over(Window.partitionBy("cluster", "idx"))
    return clustered.withColumn("mean", mean).groupBy("cluster", "pattern").agg(F.round(F.corr("value", "mean"), 3).alias("r"))


def consensus_patterns(clustered: DataFrame) -> DataFrame:
    """cluster, idx, value: means weighted by the cube of the correlation, scaled to maximum 1."""
    weight = correlation_to_mean(clustered).withColumn("w", F.pow("r", F.lit(3.0)))
    mean = clustered.join(weight, ["cluster", "pattern"]).groupBy("cluster", "idx").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return mean.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("cluster")))


def match_patterns(spark: SparkSession, patterns: DataFrame, cut: int, least: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consensus, correlations to the mean, clustered patterns) of rows (pattern, idx, value)."""
    found = checkpointed(pattern_correlations(patterns))
    if patterns.select("pattern").distinct().count() != found.where("a = b").count():
        raise ValueError("a pattern is constant, so it has no correlation")
    labels = checkpointed(cluster(found, cut, least, most))
    if not labels.limit(1).count():
        raise ValueError("no cluster of patterns is large enough; lower min_ns or cut")
    clustered = patterns.join(F.broadcast(labels), "pattern")  # a row per pattern
    return consensus_patterns(clustered), correlation_to_mean(clustered), clustered
