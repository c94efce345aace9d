"""Statistics of named sets of genes (or samples) against a factor.

``sets`` is a table (gene_set, name).  Permutations are drawn for each size of set, not for
each set, and as places among the genes: a permutation of a set of n genes is n rows, and
nothing is made of the genes that it doesn't hold.  A running sum over all genes has its
peak at a hit, so enrichment needs the hits' ranks alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.keyed import distinct_places
from ..runtime import checkpointed
from .matrix import z_scores


#: Ranges of the two-level counts of :func:`gene_probabilities`.
RANGES = 64


def members(factor: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the factor in each set."""
    return factor.join(sets.select("gene_set", "name").distinct(), "name")


def others(factor: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the factor in no set."""
    return factor.join(sets.select("name").distinct(), "name", "left_anti")


def set_means(factor: DataFrame, sets: DataFrame, value: str = "mean") -> DataFrame:
    """gene_set, k, mean: column means over the rows of each set."""
    return members(factor, sets).groupBy("gene_set", "k").agg(F.avg(value).alias("mean"))


def set_sizes(sets: DataFrame) -> DataFrame:
    """min, mean and max of the sets' sizes."""
    return sets.groupBy("gene_set").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min"), F.avg("n").alias("mean"), F.max("n").alias("max"))


def permuted_places(sizes: DataFrame, total: int, permutations: int, seed: int) -> DataFrame:
    """n, perm, place: for each distinct size n and permutation, n different places from 0 to total - 1.

    A size over the total draws all places.
    """
    tries = sizes.select(F.least(F.col("n"), F.lit(total)).cast("long").alias("m"), F.col("n").cast("long").alias("n")).distinct()
    each = tries.select("n", "m", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")).repartition("n", "perm")
    return each.select("n", "perm", F.explode(distinct_places(F.col("m"), total, seed, F.col("n"), F.col("perm"))).alias("place"))


def placed(factor: DataFrame) -> tuple[DataFrame, int]:
    """(idx, place) in the order of idx, and how many there are.

    Ids are numbered within ranges of ids that are as wide as there are ranges; the ranges'
    sizes are summed beside them.
    """
    ids = factor.select("idx").distinct()
    low, high, total = ids.agg(F.min("idx"), F.max("idx"), F.count(F.lit(1))).first()
    width = max(1, math.isqrt((high or 0) - (low or 0) + 1))
    ranged = ids.withColumn("part", F.floor((F.col("idx") - F.lit(low)) / width))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("idx")) - 1
    return ranged.withColumn("inside", inside).join(sizes, "part").select("idx", (F.col("before") + F.col("inside")).alias("place")), total


def set_statistics(factor: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """gene_set, k, up, down, activity, two_sided: mean z of a set against means of permuted rows.

    ``up`` is the share of permutations with a larger mean.  A permutation draws as many
    rows as the set lists, whether or not all of them occur.
    """
    z = checkpointed(z_scores(factor).select("idx", "name", "k", "z"))
    places, total = placed(z)
    actual = set_means(z, sets, "z").withColumnRenamed("mean", "actual")
    sizes = sets.groupBy("gene_set").agg(F.count(F.lit(1)).alias("n"))
    by_place = z.join(places, "idx").select("place", "k", "z")
    null = permuted_places(sizes, total, permutations, seed).join(by_place, "place").groupBy("n", "perm", "k").agg(F.avg("z").alias("null"))
    up = actual.join(sizes, "gene_set").join(null, ["n", "k"]).groupBy("gene_set", "k").agg((F.sum(F.when(F.round("actual", 12) < F.round("null", 12), 1).otherwise(0)) / permutations).alias("up"))
    return up.select(
        "gene_set",
        "k",
        "up",
        (1 - F.col("up")).alias("down"),
        (1 - 2 * F.col("up")).alias("activity"),
        F.greatest(F.least("up", 1 - F.col("up")), F.lit(1.0 / permutations)).alias("two_sided"),
    )


def gene_statistics(factor: DataFrame, members_of: DataFrame, statistics: DataFrame, weights: dict[int, float] | None = None, null_genes: bool = False) -> DataFrame:
    """idx, name, stat: each gene's z-scores weighted by how active the set is in each pattern.

    The weight of a pattern is -log(up) times its given weight.  Genes with z sums
    under 1e-6, and all genes if the weights sum to less, get 0.  A pattern with
    ``up`` 0 would weigh without bound; it counts as half a permutation's share.
    """
    least = F.when(F.col("up") > 0, F.col("up")).otherwise(F.lit(0.5e-3))
    given = F.lit(1.0) if weights is None else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("k")), F.lit(0.0))
    weight = statistics.select("k", (-F.log(least) * given).alias("w"))
    z = z_scores(factor)
    chosen = z.join(members_of.select("name").distinct(), "name", "left_anti" if null_genes else "left_semi")
    sums = chosen.join(F.broadcast(weight), "k").groupBy("idx", "name").agg(F.sum(F.col("z") * F.col("w")).alias("zw"), F.sum("w").alias("w"), F.sum("z").alias("z"))  # a row per pattern
    return sums.select("idx", "name", F.when((F.col("z") < 1e-6) | (F.col("w") < 1e-6), 0.0).otherwise(F.col("zw") / F.col("w") / F.col("z")).alias("stat"))


def gene_probabilities(factor: DataFrame, members_of: DataFrame, permutations: int = 500, weights: dict[int, float] | None = None, weigh_null: bool = False, seed: int = 1) -> DataFrame:
    """name, p: the share of genes outside the set with a larger statistic."""
    stats = set_statistics(factor, members_of, permutations, seed)
    own = gene_statistics(factor, members_of, stats, weights)
    null = gene_statistics(factor, members_of, stats, weights if weigh_null else None, null_genes=True)
    both = own.select("name", F.round("stat", 12).alias("stat"), F.lit(0).alias("is_null")).unionByName(null.select("name", F.round("stat", 12).alias("stat"), F.lit(1).alias("is_null")))
    counts = both.groupBy("stat").agg(F.sum("is_null").alias("n"), F.collect_list(F.when(F.col("is_null") == 0, F.col("name"))).alias("names"))
    # Sums within ranges of the statistic, and over the ranges.
    bounds = counts.agg(F.percentile_approx("stat", [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    ranged = counts.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("stat"))) if bounds else F.lit(0))
    beyond = Window.orderBy(F.col("part").desc())  # one row per range
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(beyond.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("beyond"), F.sum("all").over(beyond.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")
    )
    above = Window.partitionBy("part").orderBy(F.col("stat").desc()).rowsBetween(Window.unboundedPreceding, -1)
    share = ranged.withColumn("more", F.coalesce(F.sum("n").over(above), F.lit(0))).join(F.broadcast(sizes), "part")  # at most RANGES rows
    return share.select(F.explode("names").alias("name"), ((F.col("more") + F.col("beyond")) / F.col("total")).alias("p"))


def adjusted(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """With padj: Benjamini-Hochberg within each group, by windows."""
    by = by or []
    group = Window.partitionBy(*by)
    up = group.orderBy(F.col(p))
    scaled = tests.withColumn("__m", F.count(F.lit(1)).over(group)).withColumn("__r", F.count(F.lit(1)).over(up.rangeBetween(Window.unboundedPreceding, 0)))
    tail = group.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("padj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(tail))).drop("__m", "__r")


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(overlap: int, drawn: int, good: int, total: int) -> float:
    """P(at least ``overlap`` of ``drawn`` from ``total`` of which ``good`` count)."""
    terms = [log_choose(good, x) + log_choose(total - good, drawn - x) - log_choose(total, drawn) for x in range(max(overlap, drawn + good - total, 0), min(drawn, good) + 1)]
    return min(1.0, math.fsum(math.exp(t) for t in terms))


def overrepresentation(markers: DataFrame, sets: DataFrame, most: int = 2038) -> DataFrame:
    """lp, gene_set, overlap, size, n_markers, p, padj, neg_log_padj, ratio: markers of each
    pattern in each set, against draws from all rows.  Sets larger than ``most`` are left out."""
    markers = checkpointed(markers.select("lp", "name", "is_marker"))  # read four times
    universe = markers.select("name").distinct()
    total = universe.agg(F.count(F.lit(1)).alias("total"))
    known = sets.select("gene_set", "name").distinct().join(universe, "name", "left_semi")
    sizes = known.groupBy("gene_set").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= most)
    own = markers.where("is_marker").select("lp", "name")
    counts = own.groupBy("lp").agg(F.count(F.lit(1)).alias("n_markers"))
    hits = own.join(known, "name").groupBy("lp", "gene_set").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = counts.join(F.broadcast(total)).join(sizes)  # a row per pattern, beside one row, against the sets
    tests = pairs.join(hits, ["lp", "gene_set"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    scored = adjusted(tests.withColumn("p", special.hypergeometric_tail(F.col("overlap"), F.col("n_markers"), F.col("size"), F.col("total"))), by=["lp"])
    return scored.select("lp", "gene_set", "overlap", "size", "n_markers", "p", "padj", (-10 * F.log10("padj")).alias("neg_log_padj"), (F.col("overlap") / F.col("size")).alias("ratio"))


def _ranks(scored: DataFrame) -> DataFrame:
    """k, name, score, place (from 1, score descending, then name) and n_genes of each pattern's genes."""
    return scored.select(
        "k", "name", F.col("mean").alias("score"), F.row_number().over(Window.partitionBy("k").orderBy(F.col("mean").desc(), "name")).cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n_genes")
    )


def _peaks(hits: DataFrame, by: list[str]) -> DataFrame:
    """by, es, at, size: the largest rise of each group's running sum, from its hits (place, score, n_genes) alone.

    At its i-th hit the sum is the weight of i hits less (place - i) misses; it falls between hits.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    n, weight = F.count(F.lit(1)).over(group), F.sum(F.abs("score")).over(group)
    i = F.row_number().over(group.orderBy("place"))
    rise = F.when(weight > 0, F.sum(F.abs("score")).over(order) / weight).otherwise(i / n)
    run = F.round(rise - (F.col("place") - i) / F.greatest(F.col("n_genes") - n, F.lit(1)), 12)
    stepped = hits.select(*by, "place", run.alias("run"))
    return stepped.groupBy(*by).agg(F.greatest(F.max("run"), F.lit(0.0)).alias("es"), F.max_by("place", F.struct("run", -F.col("place"))).alias("at"), F.count(F.lit(1)).alias("size"))


def _hits(ranks: DataFrame, sets: DataFrame) -> DataFrame:
    return ranks.join(sets.select("gene_set", "name").distinct(), "name")


def enrichment_scores(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """k, gene_set, es, leading_edge, size: the largest rise of the running sum over genes in
    descending order of score, hits weighted by score (positive scores only)."""
    return _scores(_ranks(ranked), sets)


def _scores(ranks: DataFrame, sets: DataFrame) -> DataFrame:
    hits = _hits(ranks, sets)
    peak = _peaks(hits, ["k", "gene_set"])
    edge = hits.join(peak.select("k", "gene_set", "at"), ["k", "gene_set"]).where("place <= at")
    leading = edge.groupBy("k", "gene_set").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ",").alias("leading_edge"))
    return peak.drop("at").join(leading, ["k", "gene_set"], "left")


def enrichment(factor: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """k, gene_set, size, es, nes, p, padj, neg_log_padj, leading_edge: preranked enrichment
    with positive scores, against random sets of the same size."""
    ranks = checkpointed(_ranks(factor))
    total = ranks.select("name").distinct().count()
    real = checkpointed(_scores(ranks, sets))
    drawn = permuted_places(real.select(F.col("size").alias("n")), total, permutations, seed)
    null = _peaks(drawn.withColumn("place", F.col("place") + 1).join(ranks.select("k", "place", "score", "n_genes"), "place"), ["n", "perm", "k"])
    of_size = null.groupBy("n", "k").agg(F.array_sort(F.collect_list("es")).alias("nulls"))  # as many as permutations
    tests = real.join(of_size, (real.size == of_size.n) & (real.k == of_size.k)).select(
        real.k,
        "gene_set",
        "size",
        "es",
        "leading_edge",
        ((F.size(F.filter("nulls", lambda x: x >= F.col("es"))) + 1) / (permutations + 1)).alias("p"),
        (F.aggregate("nulls", F.lit(0.0), lambda a, x: a + x) / permutations).alias("center"),
    )
    scored = adjusted(tests, by=["k"])
    return scored.select("k", "gene_set", "size", "es", (F.col("es") / F.when(F.col("center") > 0, F.col("center"))).alias("nes"), "p", "padj", (-10 * F.log10("padj")).alias("neg_log_padj"), "leading_edge")


def significant(tests: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Rows for a bar chart: adjusted p under the threshold, largest first."""
    return tests.where(F.col("padj") < threshold).orderBy(F.col("neg_log_padj").desc(), "gene_set")
