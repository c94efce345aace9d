import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalars
from factorloom.model import Params, Result, build_report
from factorloom.operators import consensus, factorize, genesets, manova, markers, matrix, subsets
from factorloom.plans import registry
from factorloom.sources import matrix_files
from factorloom.streaming import progress

SF = "/root/testdata/sf0.001"


def factor(spark, rows, prefix):
    rows = np.asarray(rows, float)
    return spark.createDataFrame([(i, f"{prefix}{i + 1}", k, float(v)) for i, r in enumerate(rows) for k, v in enumerate(r)], "idx long, name string, k int, mean double")


def lists(frame):
    return {r.lp: r.names for r in markers.marker_lists(frame).collect()}


# --- registered queries ----------------------------------------------------------


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "lineitem part supplier".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(map(str, db.sql("SELECT " + ", ".join(f'"{c}"' for c in names) + " FROM want").fetchall()))


def test_a_query_returns_the_whole_reconstruction(spark):
    assert registry.QUERIES["reconstruction_whole"](spark, SF).select("i").distinct().count() == 25


def test_plans_push_filters_and_prune_columns(spark):
    plan = registry.QUERIES["reconstruction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(p_brand, [Brand#" in plan
    scan = registry.QUERIES["normalized_patterns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" in scan.split("ReadSchema")[1] and "l_extendedprice" not in scan.split("ReadSchema")[1]


# --- markers ----------------------------------------------------------------------


def plain_markers(a, p, threshold, targets=None):
    """Marker places by target, with loops; rows of zeros mark nothing."""
    k = a.shape[1]
    targets = np.eye(k) if targets is None else np.asarray(targets, float)
    scaled = a * p.max(axis=0)
    top = scaled.max(axis=1, keepdims=True)
    rows = [i for i in range(len(a)) if top[i] > 0]
    score = {(i, t): round(float(np.sqrt(((scaled[i] / top[i] - x) ** 2).sum())), 9) for i in rows for t, x in enumerate(targets)}
    rank = {}
    for t in range(len(targets)):
        for place, i in enumerate(sorted(rows, key=lambda i: (score[i, t], i))):
            rank[i, t] = place + 1
    out = []
    for t in range(len(targets)):
        order = sorted(rows, key=lambda i: rank[i, t])
        if threshold == "all":
            out.append([i for i in order if min(range(len(targets)), key=lambda x: (rank[i, x], x)) == t])
        else:
            own = []
            for i in order:
                if rank[i, t] > min(rank[i, x] for x in range(len(targets))):
                    break
                own.append(i)
            out.append(own)
    return out


@pytest.mark.parametrize("threshold", ["all", "cut"])
@pytest.mark.parametrize("seed", range(4))
def test_markers_against_plain_loops(spark, threshold, seed):
    rng = np.random.default_rng(seed)
    a, p = rng.integers(0, 4, (14, 4)).astype(float), rng.integers(1, 5, (9, 4)).astype(float)
    a[3] = 0  # no direction
    a[8:10] = a[6:8]  # ties
    got = lists(markers.pattern_markers(factor(spark, a, "g"), factor(spark, p, "s"), threshold))
    assert got == {f"Pattern_{t + 1}": [f"g{i + 1}" for i in own] for t, own in enumerate(plain_markers(a, p, threshold))}
    two = [[1, 1, 0.5, 0], [0, 0, 0, 1]]
    got = lists(markers.pattern_markers(factor(spark, a, "g"), factor(spark, p, "s"), threshold, lp={"x": two[0], "y": two[1]}))
    assert [got["x"], got["y"]] == [[f"g{i + 1}" for i in own] for own in plain_markers(a, p, threshold, two)]
    swapped = lists(markers.pattern_markers(factor(spark, a, "g"), factor(spark, p, "s"), threshold, axis=2))
    assert swapped == {f"Pattern_{t + 1}": [f"s{i + 1}" for i in own] for t, own in enumerate(plain_markers(p, a, threshold))}


def test_marker_arguments(spark):
    a = factor(spark, np.eye(3), "g")
    with pytest.warns(UserWarning):
        markers.pattern_markers(a, a, lp={"short": [1, 0]})
    with pytest.raises(ValueError):
        markers.pattern_markers(a, a, lp={"two": [2, 0, 0]})
    with pytest.raises(ValueError):
        markers.pattern_markers(a, a, axis=3)


# --- statistics -------------------------------------------------------------------


def test_enrichment_finds_a_planted_set(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(1, 1, (200, 2))
    x[:6, 0] += 8
    a = factor(spark, x, "g").withColumn("sd", F.lit(0.5))
    sets = spark.createDataFrame([("planted", f"g{i}") for i in range(1, 7)] + [("other", f"g{i}") for i in range(50, 60)] + [("absent", "zz")], "gene_set string, name string")
    rows = {(r.k, r.gene_set): r for r in genesets.enrichment(a, sets, 200).collect()}
    assert rows[0, "planted"].padj < 0.05 and rows[0, "other"].padj > 0.05 and (0, "absent") not in rows
    assert rows[0, "planted"].leading_edge.count(",") == 5 and rows[0, "planted"].size == 6
    # the running sum, in plain Python
    order = sorted(range(200), key=lambda i: (-x[i, 1], f"g{i + 1}"))
    hits, total, run, best = set(range(49, 59)), sum(x[49:59, 1]), 0.0, 0.0
    for i in order:
        run += x[i, 1] / total if i in hits else -1 / 190
        best = max(best, run)
    assert abs(rows[1, "other"].es - best) < 1e-9
    stats = {(r.gene_set, r.k): r for r in genesets.set_statistics(a, sets.where("gene_set != 'absent'"), 300, 3).collect()}
    assert stats["planted", 0].up == 0 and stats["planted", 0].two_sided == 1 / 300 and stats["planted", 0].activity == 1
    assert genesets.set_statistics(a.repartition(7), sets, 50, 3).orderBy("gene_set", "k").collect() == genesets.set_statistics(a, sets, 50, 3).orderBy("gene_set", "k").collect()
    own = sets.where("gene_set = 'planted'")
    p = {r.name: r.p for r in genesets.gene_probabilities(a, own, 100).collect()}
    assert len(p) == 6 and all(0 <= v <= 1 for v in p.values())
    assert genesets.significant(genesets.enrichment(a, sets, 50)).count() >= 1


def test_no_plan_pairs_genes_with_sets(spark):
    a = factor(spark, np.random.default_rng(1).gamma(1, 1, (40, 2)), "g").withColumn("sd", F.lit(0.5))
    sets = spark.createDataFrame([("s", f"g{i}") for i in range(1, 7)] + [("t", f"g{i}") for i in range(5, 25)], "gene_set string, name string")
    for out in (genesets.set_statistics(a, sets, 20), genesets.enrichment_scores(a, sets), genesets.enrichment(a, sets, 20)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hypergeometric_and_adjustment(spark):
    for total, good, drawn in ((10, 4, 3), (60, 20, 15)):
        for k in range(drawn + 1):
            exact = sum(math.comb(good, x) * math.comb(total - good, drawn - x) for x in range(k, min(good, drawn) + 1)) / math.comb(total, drawn)
            assert abs(genesets.hypergeometric_tail(k, drawn, good, total) - exact) < 1e-9
    p = [0.01, 0.02, 0.02, 0.5, 1.0]
    want = [min(min(q * 5 / sum(r <= q for r in p) for q in p if q >= v), 1) for v in p]
    got = genesets.adjusted(spark.createDataFrame([(x,) for x in p], "p double")).orderBy("p").collect()
    assert np.allclose([r.padj for r in got], want)


def test_manova_against_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    y = np.column_stack([rng.integers(0, 4, 60) + (x > 0), rng.integers(0, 3, 60)]).astype(float)
    centred, resid = y - y.mean(0), None
    b = (x - x.mean()) @ centred / ((x - x.mean()) ** 2).sum()
    fit = np.outer(x - x.mean(), b)
    resid = centred - fit
    h, e = fit.T @ fit, resid.T @ resid
    want = np.trace(h @ np.linalg.inv(h + e))
    samples = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(y)], "idx long, u double, v double")
    row = manova.manova(samples, factor(spark, x[:, None], "s"), "u", "v").first()
    assert abs(row.pillai - want) < 1e-9 and 0 < row.p < 1
    assert abs(manova.beta_tail(0.3, 1, 4) - 0.7**4) < 1e-12 
    grid = (np.arange(200_000) + 0.5) / 200_000
    density = grid**1.5 * (1 - grid) ** 2.5
    assert abs(manova.beta_tail(0.8, 2.5, 3.5) - density[grid > 0.8].sum() / density.sum()) < 1e-6


# --- sets and runs ----------------------------------------------------------------


def planted(seed=0, rows=30, cols=16):
    rng = np.random.default_rng(seed)
    return rng.exponential(1, (rows, 3)) @ rng.exponential(1, (3, cols))


def test_sets(spark):
    ids = spark.range(10).withColumnRenamed("id", "idx")
    a = subsets.uniform_sets(ids, 3, 7).orderBy("set_id", "pos").collect()
    assert [sum(r.set_id == s for r in a) for s in range(3)] == [3, 3, 4] and sorted(r.idx for r in a) == list(range(10))
    assert subsets.uniform_sets(ids.repartition(5), 3, 7).orderBy("set_id", "pos").collect() == a
    w = subsets.weighted_sets(spark.createDataFrame(list(enumerate("xxxxxxyyyyyy")), "idx long, name string"), {"x": 1, "y": 0}, 2, 1).collect()
    assert len(w) == 12 and all(r.idx < 6 for r in w)
    e = subsets.explicit_sets(spark, (("b", "a"), ("c",)), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, name string")).orderBy("set_id", "pos").collect()
    assert [(r.set_id, r.pos, r.idx) for r in e] == [(0, 0, 1), (0, 1, 0), (1, 0, 2)]
    with pytest.raises(ValueError):
        subsets.explicit_sets(spark, (("q",),), spark.createDataFrame([(0, "a")], "idx long, name string"))
    with pytest.raises(ValueError):
        subsets.check_sizes(subsets.uniform_sets(ids, 5, 1), 3)


@pytest.mark.parametrize("sparse", [False, True])
def test_standard_run(spark, sparse):
    data = planted()
    cell = factorize.from_numpy(spark, data)
    params = Params(3, n_iterations=60, seed=3, sparse=sparse, output_frequency=20, n_snapshots=2, pump=True)
    out = factorize.factorize(cell, params)
    a, p = out.feature_loadings.toPandas(), out.sample_factors.toPandas()
    assert (len(a), len(p)) == (90, 48) and not a["mean"].isna().any() and (a["mean"] >= 0).all()
    m = np.zeros((30, 3)), np.zeros((16, 3))
    for t, x in zip(m, (a, p), strict=True):
        t[x["idx"], x["k"]] = x["mean"]
    want = (((data - m[0] @ m[1].T) / np.maximum(0.1 * data, 0.1)) ** 2).sum()
    assert abs(out.mean_chisq - want) < 1e-6 * want
    assert out.trace.count() == 6 and out.metadata["pump"].agg(F.sum("n")).first()[0] == 30 * 60
    assert out.metadata["snapshots"].select("phase", "iter").distinct().count() == 2
    again = factorize.factorize(cell.repartition(7), params)
    assert again.factors.orderBy("axis", "idx", "k").collect() == out.factors.orderBy("axis", "idx", "k").collect()
    with pytest.warns(UserWarning):
        assert out.subsets is None
    flipped = factorize.factorize(matrix.transpose(cell), params, transpose=True)
    assert flipped.factors.orderBy("axis", "idx", "k").collect() == out.factors.orderBy("axis", "idx", "k").collect()


def test_sparse_run_beyond_the_dense_limit(spark):
    rng = np.random.default_rng(0)
    rows, cols = 30_000, 10_000
    assert rows * cols > factorize.MOST_CELLS
    cell = spark.createDataFrame(pd.DataFrame({"i": np.arange(rows), "j": rng.integers(0, cols, rows), "value": rng.integers(1, 9, rows).astype(float)}))
    params = Params(2, n_iterations=4, seed=3, sparse=True)
    out = factorize.factorize(cell, params, shape=(rows, cols))
    assert out.feature_loadings.count() == rows * 2 and out.sample_factors.count() == cols * 2 and out.mean_chisq > 0
    small = factorize.from_numpy(spark, planted(4) * (rng.random((30, 16)) < 0.3))
    a, p = (factor(spark, rng.random((n, 3)), "x") for n in (30, 16))
    assert np.isclose(matrix.chi_square_cells(small, a, p).first()[0], matrix.chi_square(small, a, p).first()[0], rtol=1e-9)
    residual = matrix.residuals(small, a, p).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert np.isclose(matrix.chi_square(small, a, p).first()[0], residual, rtol=1e-9)
    sigma = small.withColumn("value", 0.3 + F.col("value"))
    residual = matrix.residuals(small, a, p, sigma).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert np.isclose(matrix.chi_square(small, a, p, sigma).first()[0], residual, rtol=1e-9)
    plan = matrix.chi_square(small, a, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Inner", "", 1) and "Cartesian" not in plan
    with pytest.raises(Exception, match="too large"):
        factorize.factorize(cell, params.with_(sparse=False), shape=(rows, cols)).factors.count()


@pytest.mark.parametrize("mode", ["genome-wide", "single-cell"])
def test_two_stage_run(spark, mode):
    cell = factorize.from_numpy(spark, planted(1))
    out = factorize.factorize(cell, Params(3, n_iterations=50, seed=4, distributed=mode, n_sets=3, min_ns=1))
    k = out.params.n_patterns
    assert out.feature_loadings.count() == 30 * k and out.sample_factors.count() == 16 * k and out.mean_chisq > 0
    shared = out.sample_factors if mode == "genome-wide" else out.feature_loadings
    top = shared.groupBy("k").agg(F.max("mean").alias("m")).collect()
    assert all(abs(r.m - 1) < 1e-9 for r in top)  # the consensus, not zeros
    assert out.subsets.count() == (30 if mode == "genome-wide" else 16) and out.unmatched_patterns.count() > 0


def test_explicit_sets_fixed_patterns_and_errors(spark):
    data = planted(2)
    cell = factorize.from_numpy(spark, data)
    sets = tuple(tuple(range(s, s + 10)) for s in (0, 10, 20))
    p = factor(spark, np.random.default_rng(0).random((16, 4)), "s").select("idx", "k", "mean")
    params = Params(4, n_iterations=20, seed=4, distributed="genome-wide", n_sets=3, explicit_sets=sets, cut=9)
    out = factorize.factorize(cell, params, fixed_patterns=p)
    assert [sorted(r.idx for r in out.subsets.where(F.col("set_id") == s).collect()) for s in range(3)] == [list(s) for s in sets]
    assert {(r.idx, r.k): r["mean"] for r in out.sample_factors.collect()} == {(r.idx, r.k): r["mean"] for r in p.collect()}
    kept = factorize.factorize(cell, Params(4, n_iterations=20, seed=4, fixed="P"), fixed_patterns=p)
    assert {(r.idx, r.k): r["mean"] for r in kept.sample_factors.collect()} == {(r.idx, r.k): r["mean"] for r in p.collect()} and kept.mean_chisq > 0
    for bad, kw in (
        (cell.withColumn("value", -F.col("value")), {}),
        (cell.withColumn("value", F.when(F.col("i") > 0, F.col("value"))), {}),
        (cell, {"uncertainty": cell.withColumn("value", F.lit(-1.0))}),
    ):
        with pytest.raises(ValueError):
            factorize.factorize(bad, Params(3, n_iterations=5, seed=1), **kw)
    with pytest.raises(ValueError):
        factorize.factorize(cell, Params(16, n_iterations=5, seed=1))
    with pytest.raises(ValueError):
        factorize.factorize(cell, Params(3, n_iterations=5, seed=1, sparse=True), uncertainty=cell)
    part = factorize.factorize(cell, Params(3, n_iterations=10, seed=1, subset_indices=(3, 1, 3, 9, 8), subset_dim=1))
    assert part.feature_loadings.count() == 15 and part.metadata["total_updates"] > 0 and part.metadata["total_seconds"] > 0 and part.metadata["average_batch"]["A"] > 0


def test_names_follow_the_transpose_and_the_subset(spark):
    cell = factorize.from_numpy(spark, planted(2))
    dims = spark.createDataFrame([("A", i, f"gene{i}") for i in range(30)] + [("P", j, f"sample{j}") for j in range(16)], "axis string, idx long, name string")
    names = lambda frame: [r.name for r in frame.where("k = 0").orderBy("idx").collect()]
    part = factorize.factorize(cell, Params(3, n_iterations=4, seed=1, subset_indices=(9, 3, 11, 5, 7), subset_dim=1), dims=dims)
    assert names(part.feature_loadings) == ["gene8", "gene2", "gene10", "gene4", "gene6"] and names(part.sample_factors) == [f"sample{j}" for j in range(16)]
    part = factorize.factorize(cell, Params(3, n_iterations=4, seed=1, subset_indices=(2, 16, 2, 9), subset_dim=2))
    assert names(part.sample_factors) == ["Sample_2", "Sample_16", "Sample_2", "Sample_9"]
    flipped = factorize.factorize(cell, Params(3, n_iterations=4, seed=1, subset_indices=(5, 1, 2, 3), subset_dim=1), dims=dims, transpose=True)
    assert names(flipped.feature_loadings) == ["sample4", "sample0", "sample1", "sample2"] and names(flipped.sample_factors) == [f"gene{i}" for i in range(30)]
    own = factorize.factorize(cell, Params(3, n_iterations=4, seed=1, subset_indices=(30, 1, 2, 3), subset_dim=1, gene_names=tuple(f"n{i}" for i in range(30))), dims=dims)
    assert names(own.feature_loadings) == ["n29", "n0", "n1", "n2"]
    with pytest.raises(ValueError):
        factorize.factorize(cell, Params(3, n_iterations=4, seed=1, subset_indices=(31, 1, 2, 3), subset_dim=1))
    with pytest.raises(ValueError):
        factorize.factorize(cell, Params(3, n_iterations=4, seed=1, gene_names=("x",)))


def test_two_stage_run_continues_from_its_checkpoints(spark, tmp_path):
    cell = factorize.from_numpy(spark, planted(7))
    params = Params(3, n_iterations=30, seed=9, distributed="genome-wide", n_sets=3, min_ns=1)
    key = lambda out: out.factors.orderBy("axis", "idx", "k").collect()
    straight = key(factorize.factorize(cell, params))
    folder = str(tmp_path / "states")
    assert key(factorize.factorize(cell, params.with_(checkpoint_interval=13, checkpoint_path=folder))) == straight
    import shutil

    shutil.rmtree(f"{folder}/stage2/stop-000005")  # lost before its last stop
    shutil.rmtree(f"{folder}/stage2/stop-000004")
    assert key(factorize.factorize(cell, params.with_(checkpoint_interval=13, checkpoint_path=folder))) == straight


def test_checkpointed_run_equals_a_straight_one(spark, tmp_path):
    cell = factorize.from_numpy(spark, planted(3))
    params = Params(3, n_iterations=30, seed=9, output_frequency=10)
    straight = factorize.factorize(cell, params).factors.orderBy("axis", "idx", "k").collect()
    folder = str(tmp_path / "states")
    stopped = factorize.factorize(cell, params.with_(checkpoint_interval=13, checkpoint_path=folder))
    assert stopped.factors.orderBy("axis", "idx", "k").collect() == straight
    query = progress.follow(spark, folder).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*) FROM followed WHERE kind = 'state'").first()[0] == 4


# --- files ------------------------------------------------------------------------


def test_files(spark, tmp_path):
    data = np.array([[1.5, 0, 3e-2], [0, 2, 7]])
    want = {(i, j): data[i, j] for i in range(2) for j in range(3)}
    (tmp_path / "m.csv").write_text('"","a","b","c"\n"g1",1.5,0,3e-2\n"g2",0,2,7E0\n')
    (tmp_path / "n.csv").write_text("a,b,c\n1.5,0,0.03\n0,2,7\n")
    (tmp_path / "m.tsv").write_text("\ta\tb\tc\ng1\t1.5\t0\t0.03\ng2\t0\t2\t7\n")
    (tmp_path / "m.gct").write_text("#1.2\n2\t3\nNAME\tDescription\ta\tb\tc\ng1\tx\t1.5\t0\t0.03\ng2\ty\t0\t2\t7\n")
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 3 4\n1 1 1.5\n1 3 0.03\n2 2 2\n2 3 7\n")
    for name in ("m.csv", "n.csv", "m.tsv", "m.gct", "m.mtx"):
        cells, dims, shape = matrix_files.read_matrix(spark, str(tmp_path / name))
        got = {(r.i, r.j): r.value for r in cells.collect()}
        assert {k: got.get(k, 0.0) for k in want} == want, name
        info = matrix_files.file_info(spark, str(tmp_path / name))
        assert tuple(info["dimensions"]) == (2, 3)
        assert info["col_names"] == ([] if name == "m.mtx" else ["a", "b", "c"]) and info["row_names"] == (["g1", "g2"] if name in ("m.csv", "m.tsv", "m.gct") else [])
    assert matrix_files.supported("x.y/z.mtx") and not matrix_files.supported("x.rds") and not matrix_files.supported("a.b/c")
    (tmp_path / "bad.csv").write_text("a,b\n1,NA\n")
    with pytest.raises(Exception, match="not a number"):
        matrix_files.read_matrix(spark, str(tmp_path / "bad.csv"))[0].collect()
    wide = spark.createDataFrame([("g2", 0.0, 2.0), ("g1", 1.5, 0.0)], "gene string, a double, b double")
    cells, dims = matrix_files.from_wide(wide, "gene")
    assert {(r.i, r.j): r.value for r in cells.collect()} == {(0, 0): 1.5, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 2.0} and dims.count() == 4
    both = matrix_files.bind_parts([cells, cells], [2, 2])
    assert both.agg(F.max("j")).first()[0] == 3
    matrix_files.write_matrix(cells, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns == ["row", "Col1", "Col2"]
    triplets = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "r int, c int, x double")
    assert matrix_files.from_triplets(triplets, "r", "c", "x").first().value == 3


def test_results_round_trip(spark, tmp_path):
    out = factorize.factorize(factorize.from_numpy(spark, planted(5)), Params(3, n_iterations=10, seed=1, output_frequency=5, gene_names=tuple(f"n{i}" for i in range(30))))
    key = lambda r: [(x.axis, x.idx, x.name, x.k, round(x["mean"], 12), round(x.sd, 12)) for x in r.factors.orderBy("axis", "idx", "k").collect()]
    for write, read, folder in ((matrix_files.write_csv, matrix_files.read_csv, "c"), (matrix_files.write_parquet, matrix_files.read_parquet, "p")):
        write(out, str(tmp_path / folder))
        back = read(spark, str(tmp_path / folder))
        assert key(back) == key(out) and back.params == out.params and abs(back.mean_chisq - out.mean_chisq) < 1e-9 and back.trace.count() == 4
    assert isinstance(back, Result) and "factorloom" in build_report() and "patterns" in repr(out.params) + repr(out)


def test_column_functions(spark):
    row = spark.range(1).select(
        scalars.udf(scalars.normal_cdf)(F.lit(0.5), F.lit(0.0), F.lit(1.0)).alias("n"),
        scalars.one_hot(3, F.lit(1)).alias("h"),
        scalars.distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d"),
        scalars.neg_log10(F.lit(0.01)).alias("l"),
        scalars.trimmed(F.lit(' "x"\r')).alias("t"),
    ).first()
    assert abs(row.n - 0.69146) < 1e-5 and row.h == [0, 1, 0] and row.d == 5 and abs(row.l - 20) < 1e-9 and row.t == "x"


def test_the_rest_stands_without_the_optional_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "factorloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.split(".")[-1] == "llm" or ".llm." in f"{n}." for n in names), path


# --- loading ---------------------------------------------------------------------


def test_cells_are_checked_by_the_pass_that_loads_them(spark):
    cell = factorize.from_numpy(spark, [[1.0, 0.0], [2.5, 60.0]])
    kept, told = matrix.loaded(cell)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, cell.collect()))
    assert (told["n_positive"], told["n_cells"], told["largest"], told["total"]) == (3, 4, 60.0, 63.5)
    for bad, what in ((-1.0, "1 negative"), (None, "1 missing"), (float("nan"), "1 missing")):
        with pytest.raises(ValueError, match=what):
            matrix.loaded(cell.unionByName(spark.createDataFrame([(5, 5, bad)], "i long, j long, value double")))
    empty, told = matrix.loaded(cell.limit(0))
    assert empty.count() == 0 and told["n_cells"] == 0


def test_ranks_of_a_target_in_many_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{t}", i, None if i % 50 == 7 else float(rng.integers(0, 40))) for t in range(3) for i in range(400)]
    scored = spark.createDataFrame(rows, "lp string, idx long, score double").repartition(9)
    made = {(r.lp, r.idx): r["rank"] for r in markers.ranks(scored).collect()}
    for t in range(3):
        order = sorted((r for r in rows if r[0] == f"t{t}"), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        assert [made[r[0], r[1]] for r in order] == list(range(1, 401))


@pytest.mark.parametrize("seed", [1, 2])
def test_statistic_of_a_full_grid_of_large_values(spark, seed):
    rng = np.random.default_rng(seed)
    a, p = rng.random((25, 2)) * 5e6, rng.random((7, 2))
    m = a @ p.T
    data = m * (1 + 0.01 * rng.standard_normal(m.shape))
    cell, sides = factorize.from_numpy(spark, data), (factor(spark, a, "g"), factor(spark, p, "s"))
    want = 100 * ((1 - m / data) ** 2).sum()
    assert abs(matrix.chi_square(cell, *sides).first()[0] / want - 1) < 1e-9
    assert abs(matrix.chi_square_sparse(cell, *sides).first()[0] / want - 1) < 1e-9
    holed = np.where(rng.random(data.shape) < 0.2, 0.0, data)
    found = matrix.residuals(factorize.from_numpy(spark, holed), *sides).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert abs(matrix.chi_square(factorize.from_numpy(spark, holed), *sides).first()[0] / found - 1) < 1e-9
