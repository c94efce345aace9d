from types import SimpleNamespace

import numpy as np
import pandas as pd

from factorloom.model import Params
from factorloom.operators import blocks, factorize
from factorloom.operators.kernel import Cells, SparseRows


def planted():
    rng = np.random.default_rng(7)
    a, p = np.zeros((60, 3)), np.zeros((40, 3))
    for k in range(3):
        a[20 * k : 20 * k + 20, k], p[13 * k : 13 * k + 14, k] = 2 + rng.random(20), 1 + rng.random(14)
    return a @ p.T


def test_a_sparse_chain_in_blocks(spark, monkeypatch):
    data = planted()
    cell = factorize.from_numpy(spark, data)
    params = Params(3, n_iterations=40, seed=3, sparse=True, output_frequency=20, n_snapshots=2, pump=True)
    whole = factorize.factorize(cell, params)
    monkeypatch.setattr(factorize, "MOST_TOGETHER", 10)
    monkeypatch.setattr(factorize, "run_sets", None)  # no task gets the whole set
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 300)
    monkeypatch.setattr(blocks, "BLOCK_COLUMNS", 15)
    out = factorize.factorize(cell, params)
    assert out.feature_loadings.count() == 180 and out.sample_factors.count() == 120
    assert out.trace.count() == whole.trace.count() and out.metadata["pump"].agg({"n": "sum"}).first()[0] == 60 * 40
    assert out.metadata["snapshots"].count() == whole.metadata["snapshots"].count()
    last = [r.trace.where("phase = 'sampling' AND iter = 40").first().chisq for r in (out, whole)]
    assert out.mean_chisq < 2 * whole.mean_chisq + 100 and last[0] < 2 * last[1] + 100
    again = factorize.factorize(cell.repartition(7), params)
    assert again.factors.orderBy("axis", "idx", "k").collect() == out.factors.orderBy("axis", "idx", "k").collect()


def test_a_group_of_blocks_gives_one_sum_a_column():
    data = planted() * (np.random.default_rng(3).random((60, 40)) < 0.4)
    params, firsts, width = Params(3, n_iterations=10, seed=3, sparse=True), [0, 10, 25, 45], 15
    ends = [*firsts[1:], 60]
    states = [blocks._Part(a, b - a, params, 0.01, 100.0, 5.0, [b]) for a, b in zip(firsts, ends)]
    cells = []
    for a, b in zip(firsts, ends):
        i, j = np.nonzero(data[a:b])
        cells.append(("cells", a, blocks._packed(a, b - a)(pd.DataFrame({"i": i + a, "j": j, "value": data[a:b][i, j]}))))
    whole = np.random.default_rng(4).random((40, 3))
    todo = {"norm": None, "snapshot": None, "chisq": ("sampling", 1), "share": 5.0, "heat": 1.0, "blocks": 3, "width": width}
    out = list(blocks._row_step(params, SimpleNamespace(value=whole), todo)(7, iter([(7, x) for x in [*states, *cells]])))
    parts = [(c, x) for c, x in out if isinstance(x, tuple) and x[0] == "part"]
    assert [(c, x[1]) for c, x in parts] == [(0, 7), (1, 7), (2, 7)]  # one for each block of columns, however many blocks of rows
    a = np.concatenate([x.side.matrix for _, x in out if isinstance(x, blocks._Part)])
    assert a.any() and a.shape == (60, 3)
    b, g = SparseRows(Cells.of(data).transposed()).coefficients(a)
    for c, x in parts:
        near, more, atoms = blocks._summed([x[1:]], len(b[c * width : (c + 1) * width]), 3)
        assert np.allclose(near, b[c * width : (c + 1) * width]) and np.allclose(more, g[c * width : (c + 1) * width])
        assert atoms == sum(x.side.atoms for x in states)
    told = [x[2]["chisq"] for _, x in out if isinstance(x, tuple) and x[0] == "told"]
    assert np.isclose(sum(told), SparseRows(Cells.of(data)).base)  # of the zero factors they began with


def test_as_many_groups_as_blocks_of_columns(spark, monkeypatch):
    cell = factorize.from_numpy(spark, planted())
    params = Params(3, n_iterations=3, seed=3, sparse=True)
    monkeypatch.setattr(factorize, "MOST_TOGETHER", 10)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 300)
    monkeypatch.setattr(blocks, "BLOCK_COLUMNS", 15)
    monkeypatch.setattr(blocks, "GROUPS", 3)
    taken = []
    monkeypatch.setattr(blocks, "_column_step", lambda params, todo, own=blocks._column_step: taken.append(1) or own(params, todo))
    out = factorize.factorize(cell, params)
    assert len(taken) == 7 and out.factors.count() == 300
    assert out.metadata["n_genes"] == 60 and out.sample_factors.where("mean > 0").count() > 0
