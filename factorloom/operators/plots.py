"""Tables behind the usual figures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, ship_package
from . import gram, trees

#: Up to so many genes or samples a tree is made from a table of their pairs.
MOST_PAIRED = 1_000
#: More are kept as vectors, if they have no more numbers than this.
MOST_NUMBERS = 4_096


def pattern_lines(p: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One line per pattern over samples, or over the mean of each group (idx, group).

    Without groups: pattern, x (the sample's place), name, y.  With groups: pattern, x,
    group, n, y, groups in their sorted order.
    """
    labelled = p.withColumn("pattern", F.concat(F.lit("Pattern_"), (F.col("k") + 1).cast("string")))
    if groups is None:
        return labelled.select("pattern", F.col("idx").alias("x"), "name", F.col("mean").alias("y"))
    means = labelled.join(groups, "idx").groupBy("pattern", "group").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("y"))
    return means.withColumn("x", (F.row_number().over(Window.partitionBy("pattern").orderBy("group")) - 1).cast("long")).select("pattern", "x", "group", "n", "y")


def residual_map(residuals: DataFrame, limit: float = 5.0) -> DataFrame:
    """Residuals with a colour value clamped to both limits."""
    return residuals.withColumn("shade", F.greatest(F.least("residual", F.lit(limit)), F.lit(-limit)))


def marker_heat_map(cell: DataFrame, markers: DataFrame) -> DataFrame:
    """Values of the marker genes by sample, scaled within each gene; gene_place and sample_place
    order both by average-linkage trees over the markers' cells."""
    own = cell.join(markers.where("is_marker").select(F.col("idx").alias("i")).distinct(), "i", "left_semi")
    genes = tree_order(own, "i").select(F.col("idx").alias("i"), F.col("place").alias("gene_place"))
    samples = tree_order(own, "j").select(F.col("idx").alias("j"), F.col("place").alias("sample_place"))
    chosen = markers.where("is_marker").select(F.col("idx").alias("i"), "name", "lp", "rank")
    gene = Window.partitionBy("lp", "i")
    spread = F.stddev_samp("value").over(gene)
    scaled = cell.join(chosen, "i").select("lp", "rank", "i", "name", "j", "value", ((F.col("value") - F.avg("value").over(gene)) / F.when(spread > 0, spread)).alias("scaled"))
    return scaled.join(genes, "i").join(samples, "j")


def tree_distances(cell: DataFrame, axis: str = "i") -> tuple[DataFrame, DataFrame]:
    """(leaves, distances): half of one minus the correlation of two rows (or columns, axis "j").

    Missing cells are zero; one whose values are all equal has correlation 0.
    """
    other = {"i": "j", "j": "i"}[axis]
    cell = checkpointed(cell.select(F.col(axis).alias("label"), F.col(other).alias("idx"), "value"))
    n = cell.select("idx").distinct().count()
    leaves = cell.groupBy("label").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    leaves = checkpointed(leaves.select(F.col("label").alias("idx"), "s", (F.col("q") - F.col("s") * F.col("s") / n).alias("v")))
    # a distance for each pair, by nature: the leaves are one array beside every leaf
    every = leaves.agg(F.collect_list(F.struct("idx", "s", "v")).alias("all"))
    one = leaves.select(F.col("idx").alias("x"), F.col("s").alias("sx"), F.col("v").alias("vx"))
    pairs = one.join(F.broadcast(every)).select("x", "sx", "vx", F.explode(F.filter("all", lambda l: l["idx"] > F.col("x"))).alias("l")).select("x", "sx", "vx", F.col("l.idx").alias("y"), F.col("l.s").alias("sy"), F.col("l.v").alias("vy"))
    met = gram.inner_products(cell).select(F.col("a").alias("x"), F.col("b").alias("y"), "sab")
    whole = F.sqrt(F.greatest("vx", F.lit(0.0))) * F.sqrt(F.greatest("vy", F.lit(0.0)))
    r = F.when(whole > 1e-12, (F.coalesce("sab", F.lit(0.0)) - F.col("sx") * F.col("sy") / n) / whole).otherwise(0.0)
    return leaves.select("idx"), pairs.join(met, ["x", "y"], "left").select("x", "y", ((1 - F.round(r, 12)) / 2).alias("d"))


def unit_vectors(cell: DataFrame, axis: str, width: int) -> DataFrame:
    """idx, v: rows (or columns, axis "j") less their means, at norm 1; zeros where all values are equal.  Their inner products are correlations."""
    ship_package(cell.sparkSession)
    other = {"i": "j", "j": "i"}[axis]
    places = cell.select(F.col(other).alias("o")).distinct().select("o", (F.row_number().over(Window.orderBy("o")) - 1).cast("int").alias("at"))  # ``width`` rows
    rows = cell.join(F.broadcast(places), F.col(other) == F.col("o")).groupBy(F.col(axis).alias("idx")).agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.iloc[start : start + 1_000]
                x = np.zeros((len(part), width))
                for row, at, value in zip(x, part["at"], part["value"], strict=True):
                    row[at] = value
                flat = x.max(axis=1) == x.min(axis=1)
                x -= x.mean(axis=1, keepdims=True)
                x /= np.where(flat, 1.0, np.sqrt((x * x).sum(axis=1)))[:, None]
                x[flat] = 0.0
                yield pd.DataFrame({"idx": part["idx"].to_numpy(), "v": list(x)})

    return rows.mapInPandas(unit, "idx long, v array<double>")


def tree_order(cell: DataFrame, axis: str = "i") -> DataFrame:
    """idx, place, height: rows (or columns, axis "j") in the order of an average-linkage tree, and the height of the join that each begins the right side of."""
    n_leaves, width = cell.agg(F.countDistinct(axis), F.countDistinct({"i": "j", "j": "i"}[axis])).first()
    if n_leaves > MOST_PAIRED and width <= MOST_NUMBERS:
        tree = trees.agglomerate_means(unit_vectors(cell, axis, width), width)
    else:
        tree = trees.agglomerate(*tree_distances(cell, axis), "average")
    return tree.select("idx", F.col("place").cast("int").alias("place"), "height")


def separators(markers: DataFrame) -> DataFrame:
    """lp, n, upto: markers of each target and the running total that separates them."""
    counts = markers.groupBy("lp").agg(F.count(F.when(F.col("is_marker"), 1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("lp").rowsBetween(Window.unboundedPreceding, 0)))  # one row per target


def set_bars(tests: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Bars of significant sets, largest first, with the line that marks the threshold."""
    return tests.where(F.col("padj") < threshold).withColumn("line", -10 * F.log10(F.lit(threshold))).orderBy(F.col("neg_log_padj").desc(), "gene_set")
