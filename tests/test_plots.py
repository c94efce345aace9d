import numpy as np

from factorloom.operators import matrix, plots


def test_tables_behind_figures(spark):
    p = spark.createDataFrame([(i, f"s{i}", k, float(i + k)) for i in range(4) for k in range(2)], "idx long, name string, k int, mean double")
    lines = plots.pattern_lines(p).collect()
    assert len(lines) == 8 and {r.pattern for r in lines} == {"Pattern_1", "Pattern_2"}
    groups = spark.createDataFrame([(0, "b"), (1, "b"), (2, "a"), (3, "a")], "idx long, group string")
    by = {(r.pattern, r.group): (r.x, r.n, r.y) for r in plots.pattern_lines(p, groups).collect()}
    assert by["Pattern_1", "a"] == (0, 2, 2.5) and by["Pattern_2", "b"] == (1, 2, 1.5)
    cell = spark.createDataFrame([(i, j, float(i * j)) for i in range(3) for j in range(3)], "i long, j long, value double")
    marks = spark.createDataFrame([(1, "g1", "Pattern_1", 0.1, 1, True), (2, "g2", "Pattern_2", 0.1, 1, True), (0, "g0", "Pattern_2", 0.5, 2, False)], "idx long, name string, lp string, score double, rank long, is_marker boolean")
    heat = plots.marker_heat_map(cell, marks).toPandas()
    assert len(heat) == 6 and np.allclose(heat[heat.name == "g2"].sort_values("j").scaled, [-1, 0, 1])
    assert {(r.lp, r.upto) for r in plots.separators(marks).collect()} == {("Pattern_1", 1), ("Pattern_2", 2)}
    shade = plots.residual_map(spark.createDataFrame([(9.0,), (-7.0,), (1.0,)], "residual double")).collect()
    assert [r.shade for r in shade] == [5, -5, 1]
    bars = plots.set_bars(spark.createDataFrame([("a", 0.01, 20.0), ("b", 0.2, 7.0), ("c", 0.001, 30.0)], "gene_set string, padj double, neg_log_padj double")).collect()
    assert [r.gene_set for r in bars] == ["c", "a"] and abs(bars[0].line - 13.0103) < 1e-4
    dims = spark.createDataFrame([("A", 0, "x"), ("A", 1, "y"), ("P", 0, "s")], "axis string, idx long, name string")
    index = spark.createDataFrame([(0, 1), (1, 1)], "pos long, idx long")
    assert sorted((r.axis, r.idx, r.name) for r in matrix.subset_names(dims, index, "A").collect()) == [("A", 0, "y"), ("A", 1, "y"), ("P", 0, "s")]
