"""Matrix operators on long tables of cells (i, j, value) and factors (idx, k, mean, sd).

A missing cell is zero.  Products of factors are computed from their arrays: a factor
has a row per gene or sample and few patterns, so each side is folded to one row with an
array, and the equi-join on k becomes a product inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import default_sigma, z_score
from ..runtime import checkpointed, stored
from . import gram as inner

#: The smaller factor of a product is broadcast up to this many rows of arrays.
BROADCAST_ROWS = 200_000
#: A grid of at most so many times the cells is made rather than inferred.
GRID = 2


def transpose(cell: DataFrame) -> DataFrame:
    rest = [c for c in cell.columns if c not in ("i", "j")]
    return cell.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest)


def transpose_names(dims: DataFrame) -> DataFrame:
    """The names (axis, idx, name) of the transposed matrix."""
    return dims.select(F.when(F.col("axis") == "A", "P").otherwise("A").alias("axis"), "idx", "name")


def subset(cell: DataFrame, index: DataFrame, dim: int) -> DataFrame:
    """Rows (dim 1) or columns (2) in the order of ``index(pos, idx)``; repeats are kept."""
    axis = {1: "i", 2: "j"}[dim]
    rest = [c for c in cell.columns if c != axis]
    chosen = index.select(F.col("pos").cast("long").alias("__pos"), F.col("idx").alias(axis))
    return cell.join(chosen, axis).select(F.col("__pos").alias(axis), *rest).select(cell.columns)


def subset_names(dims: DataFrame, index: DataFrame, axis: str) -> DataFrame:
    """The names of a subset of one axis under their new places; the other axis as it was."""
    moved = dims.where(F.col("axis") == axis).join(index, "idx").select("axis", F.col("pos").cast("long").alias("idx"), "name")
    return moved.unionByName(dims.where(F.col("axis") != axis).select("axis", "idx", "name"))


def positive(cell: DataFrame) -> DataFrame:
    return cell.where("value > 0")


def with_sigma(cell: DataFrame, uncertainty: DataFrame | None = None) -> DataFrame:
    """Cells with sigma: the given one, or a tenth of the value and at least 0.1."""
    if uncertainty is None:
        return cell.withColumn("sigma", default_sigma(F.col("value")))
    return cell.join(uncertainty.select("i", "j", F.col("value").alias("sigma")), ["i", "j"], "left")


def log_normalize(cell: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """log1p of each value's share of its column, times the scale."""
    total = F.sum("value").over(Window.partitionBy("j"))
    return cell.withColumn("value", F.log1p(F.when(total == 0, F.lit(0.0)).otherwise(F.col("value") / total) * scale))


def validation(cell: DataFrame) -> DataFrame:
    """One row: missing, negative and total cells, dimensions, maximum, zeros' share, and warnings."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = cell.agg(
        zero(F.sum(F.when(F.col("value").isNull() | F.isnan("value"), 1))).cast("long").alias("n_missing"),
        zero(F.sum(F.when(F.col("value") < 0, 1))).cast("long").alias("n_negative"),
        zero(F.sum(F.when(F.col("value") > 0, 1))).cast("long").alias("n_positive"),
        F.countDistinct("i").alias("n_rows"),
        F.countDistinct("j").alias("n_cols"),
        F.max("value").alias("largest"),
    )
    grid = F.col("n_rows") * F.col("n_cols")
    return sums.withColumn("zero_share", 1 - F.col("n_positive") / grid).withColumns({"maybe_not_logged": F.col("largest") > 50, "maybe_sparse": F.col("zero_share") > 0.8})


def check(cell: DataFrame, n_patterns: int) -> dict:
    """Raise on cells or dimensions that can't be factorised; the counts otherwise."""
    row = validation(cell).first().asDict()
    if row["n_missing"]:
        raise ValueError(f"{row['n_missing']} missing values")
    if row["n_negative"]:
        raise ValueError(f"{row['n_negative']} negative values")
    if n_patterns >= min(row["n_rows"], row["n_cols"]):
        raise ValueError("n_patterns must be less than both dimensions")
    return row


def loaded(cell: DataFrame) -> tuple[DataFrame, dict]:
    """The cells as a table in the shared folder, and what was observed while they were written.

    Cells are checked by the pass that loads them: missing and negative ones raise.
    """
    seen = Observation("cells")
    value = F.col("value")
    zero = lambda c: F.coalesce(c, F.lit(0))
    kept = stored(
        cell.observe(
            seen,
            zero(F.sum(F.when(value.isNull() | F.isnan("value"), 1))).cast("long").alias("n_missing"),
            zero(F.sum(F.when(value < 0, 1))).cast("long").alias("n_negative"),
            zero(F.sum(F.when(value > 0, 1))).cast("long").alias("n_positive"),
            F.count(F.lit(1)).alias("n_cells"),
            F.max("value").alias("largest"),
            F.sum("value").alias("total"),
        )
    )
    told = seen.get
    for what in ("missing", "negative"):
        if told[f"n_{what}"]:
            raise ValueError(f"{told[f'n_{what}']} {what} values")
    return kept, told


def check_uncertainty(uncertainty: DataFrame, sparse: bool = False) -> dict:
    if sparse:
        raise ValueError("uncertainty can't be given in sparse mode")
    row = uncertainty.agg(F.count(F.when(F.col("value") < 0, 1)).alias("n_negative"), F.count(F.when(F.col("value") < 1e-5, 1)).alias("n_tiny"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing")).first().asDict()
    if row["n_negative"] or row["n_missing"]:
        raise ValueError("uncertainty must be given and not negative")
    return row


def moments(cell: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """min and max seeded with 0, sum and mean over the whole grid, mean of what is
    not zero, and the share of zeros.  Dimensions default to those that occur."""
    dims = [F.lit(n).cast("long") if n else F.countDistinct(c) for n, c in ((n_rows, "i"), (n_cols, "j"))]
    sums = cell.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("n_positive"), dims[0].alias("n_rows"), dims[1].alias("n_cols"))
    grid = F.col("n_rows") * F.col("n_cols")
    return sums.select(
        F.least("lo", F.lit(0.0)).alias("min"),
        F.greatest("hi", F.lit(0.0)).alias("max"),
        "total",
        (F.col("total") / grid).alias("mean"),
        (F.col("total") / F.when(F.col("n_positive") > 0, F.col("n_positive"))).alias("nonzero_mean"),
        (1 - F.col("n_positive") / grid).alias("sparsity"),
    )


# --- products ----------------------------------------------------------------


def folded(factor: DataFrame, value: str = "mean") -> DataFrame:
    """idx, v: each row's patterns as an array in the order of k."""
    return factor.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(value).alias("x")))), lambda s: s["x"]).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def product(a: DataFrame, p: DataFrame) -> DataFrame:
    """i, j, m: the dense product of two factors; every gene meets every sample by nature.

    The result is the grid, so nothing larger is made.  The samples are stored and counted,
    and broadcast if they are at most ``BROADCAST_ROWS``; else both sides are dealt in blocks.
    """
    left = folded(a).select(F.col("idx").alias("i"), F.col("v").alias("av"))
    right = checkpointed(folded(p).select(F.col("idx").alias("j"), F.col("v").alias("pv")))
    m = dot(F.col("av"), F.col("pv")).alias("m")
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        block = right.agg(F.collect_list(F.struct("j", "pv")).alias("all"))
        return left.join(F.broadcast(block)).select("i", "av", F.explode("all").alias("r")).select("i", F.col("r.j").alias("j"), dot(F.col("av"), F.col("r.pv")).alias("m"))
    blocks = -(-right.count() // BROADCAST_ROWS)
    dealt = right.withColumn("b", F.pmod(F.xxhash64("j"), F.lit(blocks)))
    spread = left.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return spread.join(dealt, "b").select("i", "j", m)


def product_at(cell: DataFrame, a: DataFrame, p: DataFrame) -> DataFrame:
    """The cells with m, the product at each; only cells that occur are computed."""
    left = folded(a).select(F.col("idx").alias("i"), F.col("v").alias("av"))
    right = folded(p).select(F.col("idx").alias("j"), F.col("v").alias("pv"))
    return cell.join(left, "i").join(right, "j").withColumn("m", dot(F.col("av"), F.col("pv"))).drop("av", "pv")


def reconstruct(a: DataFrame, p: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """The product, for all genes or the named ones (filtered before the product)."""
    return product(a if genes is None else a.where(F.col("name").isin(genes)), p)


def residuals(cell: DataFrame, a: DataFrame, p: DataFrame, uncertainty: DataFrame | None = None) -> DataFrame:
    """i, j, residual: (D - M) / S over the whole grid; cells that don't occur are zero."""
    grid = product(a, p).join(cell.select("i", "j", "value"), ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return with_sigma(grid, uncertainty).select("i", "j", ((F.col("value") - F.col("m")) / F.col("sigma")).alias("residual"))


def chi_square(cell: DataFrame, a: DataFrame, p: DataFrame, uncertainty: DataFrame | None = None) -> DataFrame:
    """One row: the sum of squared residuals.

    Under the default sigma a cell without value adds (m / 0.1)^2 (:func:`_statistic`).
    With given uncertainty the sum goes over the cells that have one.
    """
    if uncertainty is None:
        return chi_square_cells(cell, a, p)
    given = uncertainty.select("i", "j", F.col("value").alias("sigma")).join(cell.select("i", "j", "value"), ["i", "j"], "left")
    residual = (F.coalesce("value", F.lit(0.0)) - F.col("m")) / F.col("sigma")
    return product_at(given, a, p).agg(F.sum(residual * residual).alias("chisq"))


def gram(factor: DataFrame) -> DataFrame:
    """k, l, g: inner products of the patterns of one factor, from its rows' arrays."""
    rows = factor.groupBy("idx").agg(F.collect_list(F.struct("k", F.col("mean").alias("x"))).alias("v"))
    one = rows.select("v", F.explode("v").alias("a")).select("a", F.explode("v").alias("b"))
    return one.groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("g"))


def _statistic(cells: DataFrame, a: DataFrame, p: DataFrame, weight: float) -> DataFrame:
    """One row: squared residuals of positive cells (with sigma), and ``weight`` times the product's square over all others.

    Where the grid is at most ``GRID`` times the cells, the others are made and added up.
    Else their sum is that over the grid, from both factors' Gram matrices, less that over
    the cells; that difference keeps the grid's rounding error, which in a nearly full grid
    is all there is.
    """
    m = F.col("m")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    residual = (F.col("value") - m) / F.col("sigma")
    there = product_at(cells, a, p).agg(zero(residual * residual).alias("there"), zero(m * m).alias("squares"))
    n_rows, n_cols = (x.select("idx").distinct().count() for x in (a, p))
    if n_rows * n_cols <= GRID * cells.count():
        rest = product(a, p).join(cells.select("i", "j"), ["i", "j"], "left_anti").agg(zero(m * m).alias("rest"))
        absent = F.col("rest")
    else:
        rest = gram(a).join(gram(p).withColumnRenamed("g", "h"), ["k", "l"]).agg(zero(F.col("g") * F.col("h")).alias("rest"))
        absent = F.greatest(F.col("rest") - F.col("squares"), F.lit(0.0))
    return rest.join(F.broadcast(there)).select((F.col("there") + weight * absent).alias("chisq"))  # one row each


def chi_square_cells(cell: DataFrame, a: DataFrame, p: DataFrame) -> DataFrame:
    """:func:`chi_square` under the default sigma, which is 0.1 where a cell has no value."""
    return _statistic(with_sigma(positive(cell)), a, p, 100.0)


def chi_square_sparse(cell: DataFrame, a: DataFrame, p: DataFrame, beta: float = 100.0) -> DataFrame:
    """The sparse model's statistic: beta times ((d - m) / d)^2 where a cell isn't zero, m^2 elsewhere."""
    return _statistic(positive(cell).withColumn("sigma", F.col("value") / F.lit(beta**0.5)), a, p, beta)


# --- posteriors ---------------------------------------------------------------


def z_scores(factor: DataFrame) -> DataFrame:
    return factor.withColumn("z", z_score(F.col("mean"), F.col("sd")))


def binarized(factor: DataFrame, threshold: float = 3.0) -> DataFrame:
    return z_scores(factor).withColumn("on", F.when(F.col("z") > threshold, 1).otherwise(0))


def normalized(a: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P's patterns scaled to maximum 1 (or left, if zero), A's by the inverse."""
    norm = p.groupBy("k").agg(F.max("mean").alias("top")).select("k", F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")).alias("norm"))
    few = F.broadcast(norm)  # a row per pattern
    return a.join(few, "k").withColumn("mean", F.col("mean") * F.col("norm")).drop("norm"), p.join(few, "k").withColumn("mean", F.col("mean") / F.col("norm")).drop("norm")


def top_pattern(a: DataFrame) -> DataFrame:
    """idx, k: the pattern of each row's largest value, the first of equals."""
    return a.groupBy("idx").agg(F.max_by(F.col("k"), F.struct("mean", -F.col("k"))).alias("k"))


def pump(samples: DataFrame) -> DataFrame:
    """idx, k, n over sampled states (iter, idx, k, mean): how often each pattern is the largest."""
    return samples.groupBy("iter", "idx").agg(F.max_by(F.col("k"), F.struct("mean", -F.col("k"))).alias("k")).groupBy("idx", "k").agg(F.count(F.lit(1)).alias("n"))


def posterior(samples: DataFrame) -> DataFrame:
    """idx, k, mean, sd over sampled states; one state has no deviation."""
    return samples.groupBy("idx", "k").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"))


def correlations(factor: DataFrame) -> DataFrame:
    """k, l, r: Pearson correlations of the patterns of one factor; null where one doesn't vary."""
    found = inner.correlations(factor.select(F.col("k").alias("label"), "idx", F.col("mean").alias("value")))
    patterns = factor.groupBy("k").agg((F.max("mean") == F.min("mean")).alias("flat"))
    every = patterns.agg(F.sort_array(F.collect_set("k")).alias("all"))  # one row
    pairs = patterns.join(F.broadcast(every)).select("k", F.explode("all").alias("l"))
    return pairs.join(found.select(F.col("a").alias("k"), F.col("b").alias("l"), "r"), ["k", "l"], "left")


def tabulate(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def bind_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bind_columns(parts: list[DataFrame]) -> DataFrame:
    """Cells of matrices side by side; ``part`` numbers where a column comes from."""
    return bind_rows(*[c.withColumn("part", F.lit(n)) for n, c in enumerate(parts)])
