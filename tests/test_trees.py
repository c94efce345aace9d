import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import consensus, gram, matrix, plots, trees


def table(spark, x, label="i"):
    """Rows (label, idx, value) of a labels x idx array, without its missing values."""
    rows = [(int(a), int(b), float(x[a, b])) for a, b in np.argwhere(~np.isnan(x))]
    return spark.createDataFrame(rows, f"{label} long, idx long, value double").repartition(5)


@pytest.mark.parametrize("block", [1024, 5, 2])
def test_inner_products_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(gram, "CELLS", 40)
    rng = np.random.default_rng(block)
    x = np.where(rng.random((13, 60)) < 0.6, rng.normal(size=(13, 60)), np.nan)
    made = {(r.a, r.b): tuple(r)[2:] for r in gram.inner_products(table(spark, x, "label"), block).collect()}
    assert set(made) == {(a, b) for a in range(13) for b in range(a, 13)}
    for (a, b), got in made.items():
        both = ~np.isnan(x[a]) & ~np.isnan(x[b])
        u, v = x[a][both], x[b][both]
        assert np.allclose(got, (len(u), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()))


def test_correlations_match_and_spare_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (6, 300))
    x[4] = 7.0
    made = {(r.a, r.b): r.r for r in gram.correlations(table(spark, x, "label")).collect()}
    want = np.corrcoef(np.delete(x, 4, 0))
    at = {0: 0, 1: 1, 2: 2, 3: 3, 5: 4}
    assert set(made) == {(a, b) for a in at for b in at}
    assert all(abs(made[a, b] - want[at[a], at[b]]) < 1e-9 for a, b in made)
    factor = table(spark, x, "k").withColumnRenamed("value", "mean").withColumn("k", F.col("k").cast("int"))
    found = {(r.k, r.l): r.r for r in matrix.correlations(factor).collect()}
    assert len(found) == 36 and found[4, 4] is None and found[0, 4] is None and abs(found[0, 5] - want[0, 4]) < 1e-9
    plan = gram.inner_products(table(spark, x, "label"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def plain_tree(d, method):
    """Joins of the nearest pair again and again: (left members in order, right members in order, height)."""
    clusters = {i: [i] for i in range(len(d))}
    joins = []
    while len(clusters) > 1:
        far = lambda a, b: max(d[i, j] for i in clusters[a] for j in clusters[b]) if method == "complete" else np.mean([d[i, j] for i in clusters[a] for j in clusters[b]])
        h, a, b = min((far(a, b), a, b) for a in clusters for b in clusters if a < b)
        joins.append((h, a, b))
        clusters[a] = clusters[a] + clusters.pop(b)
    return clusters[0], joins


def pairs(spark, d):
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if (i + j) % 2 == (i < j) or i == j], "x long, y long, d double")


def leaves(spark, n):
    return spark.range(n).withColumnRenamed("id", "idx")


@pytest.mark.parametrize("method", ["complete", "average"])
@pytest.mark.parametrize("n,last_pairs", [(1, 0), (17, 0), (17, 60), (17, 5000)])
def test_trees_against_joining_one_by_one(spark, method, n, last_pairs):
    x = np.random.default_rng(n).normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order, joins = plain_tree(d, method)
    made = trees.agglomerate(leaves(spark, n), pairs(spark, d), method, last_pairs).orderBy("place").collect()
    assert [r.idx for r in made] == order and [r.place for r in made] == list(range(n))
    heights = {b: h for h, _, b in joins}
    assert all((r.height is None) == (r.idx == 0) and (r.idx == 0 or abs(r.height - heights[r.idx]) < 1e-9) for r in made)


def test_trees_that_stay_apart_and_ties(spark):
    d = spark.createDataFrame([(0, 3, 1.0), (1, 2, 1.0), (4, 4, 0.0)], "x long, y long, d double")
    for last_pairs in (0, 9):
        made = trees.agglomerate(leaves(spark, 5), d, last_pairs=last_pairs).orderBy("place").collect()
        assert [r.idx for r in made] == [0, 3, 1, 2, 4] and [r.height for r in made] == [None, 1.0, None, 1.0, None]
    even = np.ones((6, 6)) - np.eye(6)
    assert [r.idx for r in trees.agglomerate(leaves(spark, 6), pairs(spark, even)).orderBy("place").collect()] == list(range(6))
    with pytest.raises(ValueError):
        trees.agglomerate(leaves(spark, 2), d, "single")


def groups(made, key="pattern"):
    out = {}
    for r in made.collect():
        out.setdefault(r.cluster, []).append(r[key])
    return [sorted(out[c]) for c in sorted(out)]


def as_table(spark, r):
    return spark.createDataFrame([(i, j, float(r[i, j])) for i in range(len(r)) for j in range(len(r))], "a long, b long, r double")


def test_clusters(spark):
    r = np.eye(6)
    for group in ((0, 1, 2), (3, 4)):
        for i in group:
            for j in group:
                r[i, j] = 1.0 if i == j else 0.9
    found = lambda *bounds: groups(consensus.cluster(as_table(spark, r), *bounds))
    assert found(3, 2, 6) == [[0, 1, 2], [3, 4]]
    assert found(3, 1, 2) == [[0, 1], [2], [3, 4], [5]]
    assert found(3, 3, 2) == [[0, 1, 2]]
    assert found(3, 4, 9) == []
    flat = spark.createDataFrame([("a", i, 1.0) for i in range(4)] + [("b", i, float(i)) for i in range(4)], "pattern string, idx long, value double")
    with pytest.raises(ValueError, match="constant"):
        consensus.match_patterns(spark, flat, 1, 1, 3)


def test_clusters_are_split_where_they_join_last(spark):
    x = np.array([0.00, 0.03, 0.05, 0.40, 0.41, 0.46, 0.47, 0.90])
    r = 1 - np.abs(x[:, None] - x[None])
    assert groups(consensus.cluster(as_table(spark, r), 3, 2, 9)) == [[0, 1, 2], [3, 4, 5, 6]]
    assert groups(consensus.cluster(as_table(spark, r), 3, 2, 3)) == [[0, 1, 2], [3, 4], [5, 6]]
    assert groups(consensus.cluster(as_table(spark, r), 1, 2, 3)) == [[0, 1, 2], [3, 4], [5, 6]]


def test_order_of_genes_without_values_in_common(spark):
    cell = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 2, 3.0), (2, 0, 2.0), (2, 1, 4.0), (3, 2, 1.0)], "i long, j long, value double")
    made = plots.tree_order(cell).orderBy("place").collect()
    assert [r.idx for r in made] == [0, 2, 1, 3] and made[1].height == 0.0 and made[3].height == 0.0


@pytest.mark.parametrize("last, block", [(1, 7), (30, 64), (1000, 64)])
def test_trees_of_means_are_those_of_pairs(spark, last, block):
    rng = np.random.default_rng(5)
    x = rng.random((60, 8)) * (rng.random((60, 8)) < 0.8)
    x[40:50] = x[:10]  # copies
    x[50:53] = x[3]
    x[53] = 2.5  # no direction
    cell = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v > 0], "i long, j long, value double")
    want = {r.idx: (r.place, r.height) for r in trees.agglomerate(*plots.tree_distances(cell), "average").collect()}
    got = {r.idx: (r.place, r.height) for r in trees.agglomerate_means(plots.unit_vectors(cell, "i", 8), 8, last, block).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == v[1] or abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())


def test_order_of_many_samples_needs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(plots, "tree_distances", None)
    cell = spark.range(60_000).selectExpr("id % 5 AS i", "id div 5 AS j", "CAST(1 + (id div 5 % 30 + 3) * (id % 5 + 1) % 17 AS DOUBLE) AS value")
    made = plots.tree_order(cell, "j")
    assert made.count() == 12_000 and made.selectExpr("count(DISTINCT place)", "min(place)", "max(place)").first() == (12_000, 0, 11_999)
