"""Dealing rows or columns into sets: evenly, by annotation, or as told."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keyed import digest, uniform
from ..runtime import checkpointed

SETS = "set_id int, pos int, idx long"


def uniform_sets(ids: DataFrame, n_sets: int, seed: int) -> DataFrame:
    """Every id in one set, floor(n / n_sets) to each and the rest to the last.

    The order is that of a digest of seed and id.  Places are counted within the 4,096
    buckets of its first three digits, and the buckets' sizes are summed beside them.
    """
    keyed = ids.select("idx", digest(seed, F.col("idx")).alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "idx")) - 1
    placed = keyed.withColumn("place", place).join(F.broadcast(sizes), "bucket")  # at most 4,096 rows
    size = F.greatest(F.floor(F.col("total") / n_sets), F.lit(1))
    dealt = placed.select("idx", F.least(F.floor((F.col("before") + F.col("place")) / size), F.lit(n_sets - 1)).cast("int").alias("set_id"))
    return dealt.select("set_id", (F.row_number().over(Window.partitionBy("set_id").orderBy("idx")) - 1).cast("int").alias("pos"), "idx")


def weighted_sets(annotation: DataFrame, weights: Mapping[str, float], n_sets: int, seed: int) -> DataFrame:
    """Sets of floor(n / n_sets) of the ids of a table (idx, name): groups (names) drawn by weight, ids of a group with replacement.

    Draw t of set s is decided by digests of (seed, s, t), so ids may repeat.  Members of a
    group are numbered within ranges of ids, whose sizes are summed beside them, so a group
    that holds most ids is no single task's.
    """
    spark = annotation.sparkSession
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and some must be positive")
    ranged = checkpointed(annotation.select("idx", "name").repartitionByRange("name", "idx").withColumn("part", F.spark_partition_id()))
    n = ranged.count()
    # a row for each group and range
    counts = ranged.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("name", "part", F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("name", "part").orderBy("idx")) - 1
    members = ranged.withColumn("inside", inside).join(before, ["name", "part"]).select("name", "idx", (F.col("before") + F.col("inside")).cast("long").alias("place"))
    total, upto, bounds = sum(weights.values()), 0.0, []
    for name in sorted(weights):
        bounds.append((name, upto / total, (upto + weights[name]) / total))
        upto += weights[name]
    last = max(i for i, (_, a, b) in enumerate(bounds) if b > a)
    chosen = None
    for i, (name, _, high) in reversed(list(enumerate(bounds))):
        chosen = F.lit(name) if i >= last else F.when(F.col("u") < high, F.lit(name)).otherwise(chosen)
    each = max(1, n // n_sets)
    tries = spark.range(n_sets).select(F.col("id").cast("int").alias("set_id"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("t"))
    drawn = tries.withColumn("u", uniform(seed, F.col("set_id"), F.col("t"), 0)).select("set_id", "t", chosen.alias("name"), uniform(seed, F.col("set_id"), F.col("t"), 1).alias("v"))
    sizes = counts.groupBy("name").agg(F.sum("n").alias("size"))
    placed = drawn.join(sizes, "name").withColumn("place", F.floor(F.col("v") * F.col("size")))
    rows = placed.join(members, ["name", "place"])
    return rows.select("set_id", (F.row_number().over(Window.partitionBy("set_id").orderBy("idx", "t")) - 1).cast("int").alias("pos"), "idx")


def explicit_sets(spark: SparkSession, sets: Sequence[Sequence], names: DataFrame | None = None) -> DataFrame:
    """The sets as given, by id or by the names of a table (idx, name); an unknown name is an error."""
    rows = [(s, pos, str(x)) for s, members in enumerate(sets) for pos, x in enumerate(members)]
    listed = spark.createDataFrame(rows, "set_id int, pos int, x string")
    if not any(isinstance(x, str) for members in sets for x in members):
        return listed.select("set_id", "pos", F.col("x").cast("long").alias("idx"))
    known = spark.createDataFrame([], "idx long, name string") if names is None else names.select("idx", "name")
    found = listed.join(known, listed.x == known.name, "left")
    unknown = found.where("idx is null").select("x").first()
    if unknown:
        raise ValueError(f"unknown name {unknown['x']}")
    return found.select("set_id", "pos", "idx")


def check_sizes(sets: DataFrame, n_patterns: int) -> None:
    least = sets.groupBy("set_id").count().agg(F.min("count")).first()[0]
    if least is None or least < n_patterns:
        raise ValueError("a set has fewer members than there are patterns")
