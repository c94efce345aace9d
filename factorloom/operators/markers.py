"""Pattern markers: which genes (or samples) stand closest to each target."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance
from ..runtime import checkpointed

#: Digits that scores keep before ranking, so that the last bits of sums can't order ties.
DIGITS = 9


def scores(a: DataFrame, p: DataFrame, lp: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """idx, name, lp, target, score: distances of each row, scaled to maximum 1, to each target.

    Rows of zeros have no direction; their score is null and they rank last.
    """
    tops = p.groupBy("k").agg(F.max("mean").alias("top")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "top"))), lambda s: s["top"]).alias("tops"))  # one row
    numbers = lambda: F.sequence(F.lit(0), F.size("tops") - 1)
    if lp is None:
        unit = lambda n: F.transform(numbers(), lambda k: F.when(k == n, 1.0).otherwise(0.0))
        listed = F.transform(numbers(), lambda n: F.struct(F.concat(F.lit("Pattern_"), (n + 1).cast("string")).alias("lp"), n.alias("target"), unit(n).alias("to")))
    else:
        if any(max(v) > 1 for v in lp.values()):
            raise ValueError("targets must have a maximum of at most 1")
        patterns = p.select("k").distinct().count()
        if any(len(v) != patterns for v in lp.values()):
            warnings.warn("a target's length isn't the number of patterns; missing entries count as 0", stacklevel=2)
        targets = [(k, n, [float(x) for x in list(v)[:patterns]] + [0.0] * (patterns - len(v))) for n, (k, v) in enumerate(lp.items())]
        listed = F.array(*[F.struct(F.lit(name).alias("lp"), F.lit(n).alias("target"), F.array(*[F.lit(x) for x in v]).alias("to")) for name, n, v in targets])
    rows = a.groupBy("idx").agg(F.first("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("mean").alias("x")))), lambda s: s["x"]).alias("v"))
    scaled = rows.join(F.broadcast(tops)).withColumn("v", F.zip_with("v", "tops", lambda x, s: x * s))
    unit_rows = scaled.withColumn("v", F.transform("v", lambda x: x / F.when(F.array_max("v") > 0, F.array_max("v"))))
    each = unit_rows.select("idx", "name", "v", F.explode(listed).alias("t"))
    return each.select("idx", "name", "t.lp", "t.target", F.round(distance(F.col("v"), F.col("t.to")), DIGITS).alias("score"))


def ranks(scored: DataFrame) -> DataFrame:
    """With rank: ascending within a target, the first row of equals first.

    Rows are dealt into ranges of (target, score, row) by sampled bounds; a rank is the place
    in the row's range and the sizes of the target's ranges before it, so no task orders a
    whole target.
    """
    order = [F.col("score").asc_nulls_last(), F.col("idx")]
    ranged = checkpointed(scored.repartitionByRange("lp", *order).withColumn("part", F.spark_partition_id()))
    # a row for each target and range
    sizes = ranged.groupBy("lp", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("lp", "part", F.coalesce(F.sum("n").over(Window.partitionBy("lp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("lp", "part").orderBy(*order)))
    return inside.join(before, ["lp", "part"]).withColumn("rank", (F.col("before") + F.col("inside")).cast("long")).drop("part", "before", "inside")


def pattern_markers(a: DataFrame, p: DataFrame, threshold: str = "all", lp: Mapping[str, Sequence[float]] | None = None, axis: int = 1) -> DataFrame:
    """idx, name, lp, score, rank, is_marker.

    ``all`` gives each row to the target it ranks best in, the first of equals.  ``cut``
    takes each target's rows up to the first that ranks better in another target; with
    no such row it takes all.  Axis 2 does the same for samples.
    """
    if axis not in (1, 2) or threshold not in ("all", "cut"):
        raise ValueError("axis must be 1 or 2, threshold all or cut")
    if axis == 2:
        a, p = p, a
    ranked = ranks(scores(a, p, lp))
    of_row = Window.partitionBy("idx")
    if threshold == "all":
        best = F.min(F.struct("rank", "target")).over(of_row)
        chosen = (F.col("target") == best["target"]) & F.col("score").isNotNull()
        out = ranked.withColumn("is_marker", chosen)
    else:
        least = ranked.withColumn("least", F.min("rank").over(of_row))
        cuts = least.groupBy("lp").agg(F.min(F.when(F.col("rank") > F.col("least"), F.col("rank"))).alias("cut"))  # one row per target
        marked = (F.col("cut").isNull() | (F.col("rank") < F.col("cut"))) & F.col("score").isNotNull()
        out = least.join(F.broadcast(cuts), "lp").withColumn("is_marker", marked)
    return out.select("idx", "name", "lp", "score", "rank", "is_marker")


def marker_lists(markers: DataFrame) -> DataFrame:
    """lp, names: the markers of each target in the order of rank; targets without any have none."""
    return markers.groupBy("lp").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_marker"), F.struct("rank", "name")))), lambda s: s["name"]).alias("names"))
