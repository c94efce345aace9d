"""Agglomerative trees over a table of distances, in rounds of Spark jobs.

In a round every two clusters that are each other's nearest are joined, all at once, and
distances to the joined ones follow from those to their parts: the farthest pair (complete
linkage) or the mean over pairs (average linkage).  Neither brings a joined cluster nearer
to a third than its parts were, so joins of one round don't disturb each other, and the tree
is the one that joins the nearest pair of all again and again.  Pairs are ordered by distance
and then by the least members of both, so that in each round some pair is joined.

A tree is a table with a row per leaf: ``place``, its place from left to right (in each join
the cluster with the lesser least member is on the left), and ``height`` and ``round`` of the
join whose right side begins with it, null for the first leaf.  A subtree is a run of places,
and a cut is a set of rows, so clusters are running counts.

Distances shrink with the square of the clusters left; only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package, stored

TREE = "idx long, place long, height double, round int"
#: So few pairs of clusters (of 100 clusters, say) cost less in one task than in rounds.
LAST_PAIRS = 5_000
#: So few clusters with means are joined by one task, which holds the square of them.
LAST_MEANS = 1_024
#: Clusters of a block of means, and numbers in it at most: a task compares two blocks.
BLOCK, BLOCK_NUMBERS = 2_048, 1 << 22


#: What becomes of a cluster: its new name, how far its leaves move to the right, and the join that it is the right side of.
_MOVED = "c long, to long, shift long, at double, step int"


def _moved(tree: DataFrame, moved: DataFrame) -> DataFrame:
    """The tree after joins, of which each cluster has a row at most."""
    opened = (F.col("idx") == F.col("c")) & F.col("at").isNotNull()
    return tree.join(moved.drop("size"), F.col("cluster") == F.col("c"), "left").select(
        "idx",
        F.coalesce("to", "cluster").alias("cluster"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"),
        F.when(opened, F.col("at")).otherwise(F.col("height")).alias("height"),
        F.when(opened, F.col("step")).otherwise(F.col("round")).alias("round"),
    )


def _rest(method: str, number: int):
    """The task that ends a tree of few pairs, one join after another."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        d = {(x, y): v for x, y, v in zip(pairs["x"], pairs["y"], pairs["d"])}
        size = dict(zip(pairs["x"], pairs["nx"])) | dict(zip(pairs["y"], pairs["ny"]))
        out = {c: [c, c, 0, None, None] for c in size}
        own = {c: [c] for c in size}
        step = number
        while d:
            (a, b), height = min(d.items(), key=lambda e: (e[1], *e[0]))
            of = lambda c, k: d.pop((min(c, k), max(c, k)), None)
            del d[a, b]
            for k in [k for k in own if k not in (a, b)]:
                near = [(size[c], v) for c in (a, b) if (v := of(c, k)) is not None]
                if near:
                    d[min(a, k), max(a, k)] = max(v for _, v in near) if method == "complete" else sum(n * v for n, v in near) / sum(n for n, _ in near)
            out[b][3], out[b][4] = height, step
            for c in own[b]:
                out[c][2] += size[a]
            own[a] += own.pop(b)
            for c in own[a]:
                out[c][1] = a
            size[a] += size[b]
            step += 1
        rows = pd.DataFrame(list(out.values()), columns=["c", "to", "shift", "at", "step"])
        return rows.astype({"at": "float64", "step": "Int32"})

    return run


def agglomerate(leaves: DataFrame, distances: DataFrame, method: str = "complete", last_pairs: int = LAST_PAIRS) -> DataFrame:
    """The tree over ``leaves`` (idx); ``distances`` (x, y, d) has each pair at least once, in either order.

    Once ``last_pairs`` pairs of clusters are left, or fewer, one task joins them.

    Pairs without a distance are never joined directly; trees that stay apart lie side by side.
    """
    if method not in ("complete", "average"):
        raise ValueError("method must be complete or average")
    pair = (F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    left = stored(distances.where("x != y").groupBy(*pair).agg(F.min("d").alias("d")).select("x", "y", "d", F.lit(1).cast("long").alias("nx"), F.lit(1).cast("long").alias("ny")))
    tree = leaves.select(F.col("idx").cast("long").alias("idx")).distinct().select("idx", F.col("idx").alias("cluster"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("int").alias("round"))
    number = 0
    while pairs := left.count():
        number += 1
        if pairs <= last_pairs:
            tree = stored(_moved(tree, left.groupBy().applyInPandas(_rest(method, number), _MOVED)))
            break
        key = F.struct("d", "x", "y", "nx", "ny").alias("p")
        nearest = left.select(F.col("x").alias("c"), key).unionByName(left.select(F.col("y").alias("c"), key)).groupBy("c").agg(F.min("p").alias("p"))
        joins = stored(nearest.groupBy("p").count().where("count = 2").select("p.*"))
        size = F.col("nx") + F.col("ny")
        none = F.lit(None)
        moved = joins.select(F.col("x").alias("c"), F.col("x").alias("to"), size.alias("size"), F.lit(0).cast("long").alias("shift"), none.cast("double").alias("at"), none.cast("int").alias("step")).unionByName(
            joins.select(F.col("y").alias("c"), F.col("x").alias("to"), size.alias("size"), F.col("nx").alias("shift"), F.col("d").alias("at"), F.lit(number).alias("step"))
        )
        tree = stored(_moved(tree, moved))
        renamed = left
        for end in ("x", "y"):
            other = moved.select(F.col("c").alias(f"c{end}"), F.col("to").alias(f"to{end}"), F.col("size").alias(f"size{end}"))
            renamed = renamed.join(other, F.col(end) == F.col(f"c{end}"), "left")
        ends = renamed.select("d", (F.col("nx") * F.col("ny")).alias("w"), *[F.struct(F.coalesce(f"to{e}", e).alias("c"), F.coalesce(f"size{e}", f"n{e}").alias("n")).alias(e) for e in ("x", "y")])
        apart = ends.where("x.c != y.c").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        d = F.max("d") if method == "complete" else F.sum(F.col("w") * F.col("d")) / F.sum("w")
        left = stored(apart.agg(d.alias("d")).select(F.col("x.c").alias("x"), F.col("y.c").alias("y"), "d", F.col("x.n").alias("nx"), F.col("y.n").alias("ny")))
    # trees that stayed apart lie one behind the other: one row per tree
    sizes = tree.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("cluster", F.coalesce(F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return tree.join(before, "cluster").select("idx", (F.col("before") + F.col("place")).alias("place"), "height", "round")


# --- average linkage of unit vectors ------------------------------------------------


def _far(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (1 - np.round(left @ right.T, 12)) / 2


def _means(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["v"].to_numpy()) / rows["n"].to_numpy()[:, None]


def _nearest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """c, d, other: the nearest cluster of each one of two blocks in the other block; of equals the least."""
    rows = rows.sort_values("c")
    sides = [rows[rows["left"]], rows[~rows["left"]]]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"c": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64"), "other": pd.Series(dtype="int64")})
    d = _far(*(_means(x) for x in sides))
    names = [x["c"].to_numpy() for x in sides]
    d[names[0][:, None] == names[1][None, :]] = np.inf
    out = []
    for own, others, far in ((*names, d), (*names[::-1], d.T)) if key[0] != key[1] else ((*names, d),):
        at = far.argmin(axis=1)
        out.append(pd.DataFrame({"c": own, "d": far[np.arange(len(own)), at], "other": others[at]}))
    out = pd.concat(out)
    return out[np.isfinite(out["d"])]


def _rest_of_means(number: int):
    """The task that ends a tree of few clusters, one join after another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c").reset_index(drop=True)
        names, size, means = rows["c"].to_numpy(), rows["n"].to_numpy().astype(float), _means(rows)
        d = _far(means, means)
        d[np.tril_indices(len(d))] = np.inf
        own = [[k] for k in range(len(d))]
        to, shift, at, step = names.copy(), np.zeros(len(d), np.int64), np.full(len(d), np.nan), [None] * len(d)
        for n in range(len(d) - 1):
            a, b = divmod(int(d.argmin()), len(d))
            at[b], step[b] = d[a, b], number + n
            k = np.arange(len(d))
            ka, kb = (np.minimum(k, a), np.maximum(k, a)), (np.minimum(k, b), np.maximum(k, b))
            near = np.isfinite(d[ka]) & np.isfinite(d[kb])
            ka, kb = tuple(x[near] for x in ka), tuple(x[near] for x in kb)
            d[ka] = (size[a] * d[ka] + size[b] * d[kb]) / (size[a] + size[b])
            d[b, :] = d[:, b] = np.inf
            shift[own[b]] += int(size[a])
            own[a] += own[b]
            to[own[a]] = names[a]
            size[a] += size[b]
        return pd.DataFrame({"c": names, "to": to, "shift": shift, "at": at, "step": pd.Series(step, dtype="Int32")})

    return run


def agglomerate_means(vectors: DataFrame, width: int, last: int = LAST_MEANS, block: int = BLOCK) -> DataFrame:
    """The average-linkage tree of ``vectors`` (idx, v: ``width`` doubles of norm 1, or 0) under half of one minus the inner product.

    A mean over pairs of inner products is the inner product of means, so clusters are kept
    by sums of their vectors, and no table of pairs is made: a round looks for every
    cluster's nearest in pairs of blocks.  Inner products count to 12 digits.  Leaves at
    distance 0 are equal to each other and joined in the first round, the lesser one first.
    """
    ship_package(vectors.sparkSession)
    block = max(1, min(block, BLOCK_NUMBERS // width))
    whole = stored(vectors.select(F.col("idx").cast("long").alias("c"), F.lit(1).cast("long").alias("n"), "v"))
    tree = whole.select(F.col("c").alias("idx"), F.col("c").alias("cluster"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("int").alias("round"))
    none, number = F.lit(None), 0
    while (left := whole.count()) > 1:
        number += 1
        if left <= last:
            tree = _moved(tree, whole.groupBy().applyInPandas(_rest_of_means(number), _MOVED))
            break
        blocks = -(-left // block)
        dealt = whole.withColumn("own", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
        met = dealt.withColumn("hi", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1)))).select(F.col("own").alias("lo"), "hi", F.lit(True).alias("left"), "c", "n", "v").unionByName(
            dealt.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("own")))).select("lo", F.col("own").alias("hi"), F.lit(False).alias("left"), "c", "n", "v")
        )
        found = met.groupBy("lo", "hi").applyInPandas(_nearest, "c long, d double, other long")
        nearest = stored(found.groupBy("c").agg(F.min(F.struct("d", "other")).alias("p")).select("c", "p.d", "p.other"))
        equal = nearest.where("d = 0 AND other < c").select("c", F.col("other").alias("to"), "d") if number == 1 else None
        if equal is not None and equal.limit(1).count():
            rank = F.row_number().over(Window.partitionBy("to").orderBy("c")).cast("long")
            moved = stored(equal.select("c", "to", rank.alias("shift"), F.col("d").alias("at"), F.lit(number).alias("step")))
            joined = moved.groupBy(F.col("to").alias("c")).agg(F.count(F.lit(1)).alias("more"))
            grown = (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")
            whole = stored(whole.join(moved.select("c"), "c", "left_anti").join(joined, "c", "left").select("c", grown, F.transform("v", lambda x: x * (1 + F.coalesce("more", F.lit(0)))).alias("v")))
        else:
            back = nearest.select(F.col("c").alias("other"), F.col("other").alias("c"))
            pairs = stored(nearest.where("c < other").join(back, ["c", "other"]).join(whole.select("c", "n"), "c"))
            moved = pairs.select(F.col("other").alias("c"), F.col("c").alias("to"), F.col("n").alias("shift"), F.col("d").alias("at"), F.lit(number).alias("step"))
            second = moved.join(whole, "c").select(F.col("to").alias("c"), F.col("n").alias("m"), F.col("v").alias("w"))
            both = F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + y))
            whole = stored(whole.join(moved.select("c"), "c", "left_anti").join(second, "c", "left").select("c", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), both.alias("v")))
        # members keep their places but for those of the right side, whose first leaf gets the join
        tree = stored(_moved(tree, moved.withColumn("size", none)))
    return tree.select("idx", "place", "height", "round")


def _labelled(rows: DataFrame, starts, within: list[str]) -> DataFrame:
    """``rows`` with label, the least idx of each run of places that begins at ``starts``."""
    order = Window.partitionBy(*within).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    return run.withColumn("label", F.min("idx").over(Window.partitionBy(*within, "run"))).drop("run")


def cut(tree: DataFrame, k: int) -> DataFrame:
    """idx, place, height, round, label: the tree cut into ``k`` clusters, each labelled by its least member.

    One row per leaf is ordered in one task; a tree has a distance for each pair of leaves.
    """
    top = tree.where("height IS NOT NULL").orderBy(F.desc("height"), F.desc("round"), F.desc("idx")).limit(max(0, k - 1)).select("idx", F.lit(True).alias("cut"))
    marked = tree.join(top, "idx", "left")
    starts = F.coalesce("cut", F.lit(False)) | F.col("height").isNull()
    return _labelled(marked, starts, []).select("idx", "place", "height", "round", "label")


def bounded_clusters(tree: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """idx, cluster: clusters of ``least`` to ``most`` members where splitting allows, numbered by their least members.

    The tree is cut into ``k``; small clusters are dropped; large ones are split at their
    highest join again and again, and pieces that are too small are dropped, unless both
    are, when the cluster stays whole.
    """
    of = Window.partitionBy("label")
    sized = cut(tree, k).withColumn("size", F.count(F.lit(1)).over(of)).where(F.col("size") >= least)
    rows = stored(sized.withColumn("whole", F.col("size") <= most))
    while rows.where("NOT whole").limit(1).count():
        inner = F.when(F.col("place") > F.min("place").over(of), F.struct("height", "round", "idx", "place"))
        split = rows.where("NOT whole").withColumn("at", F.max(inner).over(of)["place"])
        piece = F.when(F.col("place") >= F.col("at"), 1).otherwise(0)
        parts = split.withColumn("piece", piece).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label", "piece"))).withColumn("largest", F.max("n").over(of))
        kept = parts.where("n >= {0} OR largest < {0}".format(int(least)))
        stays = F.col("largest") < least
        named = kept.withColumn("to", F.when(stays, F.col("label")).otherwise(F.min("idx").over(Window.partitionBy("label", "piece"))))
        done = named.select("idx", "place", "height", "round", F.col("to").alias("label"), F.when(stays, F.col("size")).otherwise(F.col("n")).alias("size"), (stays | (F.col("n") <= most)).alias("whole"))
        rows = stored(rows.where("whole").unionByName(done))
    # one row per cluster is ordered in one task
    numbers = rows.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("cluster"))
    return rows.join(numbers, "label").select("idx", "cluster")
