import math
import pickle
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from factorloom.functions import scalars
from factorloom.model import Params
from factorloom.operators import kernel
from factorloom.operators.kernel import Cells, Chain, DenseRows, Side, SparseRows


def planted(seed=0, rows=25, cols=20, k=3):
    rng = np.random.default_rng(seed)
    a = rng.exponential(1, (rows, k)) * (rng.random((rows, k)) < 0.5)
    p = rng.exponential(1, (cols, k)) * (rng.random((cols, k)) < 0.6)
    return a @ p.T


def run(data, n=150, fixed=None, sigma=None, **kw):
    params = Params(3, n_iterations=n, seed=kw.pop("seed", 5), output_frequency=50, **kw)
    return Chain(data, params, (params.seed, 1, 0), sigma, fixed).run()


@pytest.mark.parametrize("sparse", [False, True])
def test_first_statistic(sparse):
    d = np.fromfunction(lambda i, j: i + j + 1, (25, 50))
    chain = Chain(d, Params(3, n_iterations=10, seed=1, sparse=sparse), (1,))
    assert math.isclose(chain.chisq(), 100 * d.size)


def plain_chisq(chain, data, sparse, sigma=None):
    m = chain.a.matrix @ chain.p.matrix.T
    if sparse:
        sigma = np.where(data > 0, 0.1 * data, 0.1)
    return (((data - m) / (np.maximum(0.1 * data, 0.1) if sigma is None else sigma)) ** 2).sum()


@pytest.mark.parametrize("sparse", [False, True])
def test_invariants_and_fit(sparse):
    data = planted()
    chain = run(data, 400, sparse=sparse)
    for side in (chain.a, chain.p):
        mass = np.zeros(side.matrix.shape)
        for row in range(len(mass)):
            n = side.count[row]
            assert (side.mass[row, :n] > 0).all() and not side.mass[row, n:].any() and np.isinf(side.place[row, n:]).all()
            assert (side.place[row, :n] >= 0).all() and (side.place[row, :n] <= side.patterns).all()
            np.add.at(mass[row], side._bins(side.place[row, :n]), side.mass[row, :n])
        assert np.abs(mass - side.matrix).max() < 1e-9 and (side.matrix >= 0).all()
    product = chain.a.matrix @ chain.p.matrix.T
    start = Chain(data, chain.params, (0,)).chisq()
    assert chain.chisq() < 0.2 * start and np.corrcoef(product.ravel(), data.ravel())[0, 1] > 0.9
    assert math.isclose(chain.chisq(), plain_chisq(chain, data, sparse), rel_tol=1e-9)
    assert chain.result().batch[0] > 5 and chain.result().seconds > 0


def test_coefficients_against_plain_sums():
    rng = np.random.default_rng(4)
    d = rng.integers(1, 15, (40, 30)) * (rng.random((40, 30)) < 0.5).astype(float)
    d[7] = 0
    v = rng.uniform(0, 10, (30, 4))
    for rows, sigma in ((DenseRows(d, np.maximum(0.1 * d, 0.1)), np.maximum(0.1 * d, 0.1)), (SparseRows(Cells.of(d)), np.where(d > 0, 0.1 * d, 0.1))):
        b, g = rows.coefficients(v)
        for r in range(40):
            w = 1 / sigma[r] ** 2
            assert np.allclose(b[r], (w * d[r]) @ v) and np.allclose(g[r], (v.T * w) @ v)
        assert np.isclose(rows.base, (d**2 / sigma**2).sum())


def lone_side(rows=2000, patterns=3, alpha=0.4):
    return Side(rows, patterns, alpha, 1.0, 100.0)


def test_atoms_without_data_follow_the_prior():
    """Masses are exponential and places even; moves and exchanges keep the atoms and their mass."""
    rng = np.random.default_rng(3)
    side = lone_side()
    b, g = np.zeros((2000, 3)), np.zeros((2000, 3, 3))
    for _ in range(30):
        side.births_and_deaths(rng, b, g)
    masses = side.mass[side.mass > 0]
    assert len(masses) > 500 and abs(masses.mean() * side.rate - 1) < 0.1
    before, total = side.count.copy(), side.mass.sum()
    for _ in range(20):
        side.moves(rng, b, g)
        side.exchanges(rng, b, g)
    assert (side.count == before).all() and math.isclose(side.mass.sum(), total, rel_tol=1e-9)
    at = side.place[np.isfinite(side.place)]
    assert abs(np.mean(at) - 1.5) < 0.1 and abs((at < 1).mean() - 1 / 3) < 0.05


def test_birth_and_death_rates():
    rng = np.random.default_rng(5)
    side = lone_side(rows=40_000, alpha=0.1)
    b, g = np.full((40_000, 3), 0.0), np.zeros((40_000, 3, 3))
    side.births_and_deaths(rng, b, g)
    assert abs(side.count.mean() - 0.3 / 1.3) < 0.01  # alpha K / (1 + alpha K)
    # where mass is unwelcome, an atom dies as often as a death is tried
    side = lone_side(rows=40_000, alpha=0.1)
    side.count[:], side.place[:, 0], side.mass[:, 0] = 1, 1.5, 2.0
    side.matrix[:, 1] = 2.0
    side.births_and_deaths(rng, np.full((40_000, 3), -1e6), np.full((40_000, 3, 3), 1.0))
    assert abs((side.count == 0).mean() - 1 / 1.3) < 0.01 and not side.matrix[side.count == 0].any()


def test_one_element_has_its_conditional_distribution():
    """Rebirths leave a lone atom's mass with the truncated normal that the coefficients say."""
    rng = np.random.default_rng(6)
    n = 20_000
    side = lone_side(rows=n, patterns=1, alpha=1e-9)
    side.count[:], side.place[:, 0], side.mass[:, 0] = 1, 0.5, 1.0
    side.matrix[:, 0] = 1.0
    b, g = np.full((n, 1), 8.0), np.full((n, 1, 1), 4.0)
    for _ in range(6):
        side.births_and_deaths(rng, b, g)
    mean = (8.0 - side.rate) / 4
    assert abs(side.matrix.mean() - mean) < 0.02 and abs(side.matrix.std() - 0.5) < 0.02


def test_exchange_and_move_follow_the_likelihood():
    rng = np.random.default_rng(7)
    n = 4000
    side = lone_side(rows=n, patterns=2, alpha=1e-9)
    side.count[:] = 2
    side.place[:, :2], side.mass[:, :2] = [0.5, 1.5], [1.0, 3.0]
    side.matrix[:] = [1.0, 3.0]
    truth = np.array([2.5, 1.5])
    g = np.broadcast_to(np.eye(2) * 400, (n, 2, 2)).copy()
    b = np.broadcast_to(400 * truth, (n, 2)).copy()
    for _ in range(8):
        side.exchanges(rng, b, g)
    assert np.allclose(side.matrix.sum(axis=1), 4) and np.abs(side.matrix.mean(axis=0) - truth).max() < 0.02
    one = lone_side(rows=n, patterns=2, alpha=1e-9)
    one.count[:], one.place[:, 0], one.mass[:, 0] = 1, 0.5, 2.0
    one.matrix[:, 0] = 2.0
    for _ in range(40):
        one.moves(rng, np.broadcast_to([0.0, 800.0], (n, 2)).copy(), g)
    assert (one.matrix[:, 1] == 2).all()


def test_draws():
    rng = np.random.default_rng(7)
    u = rng.random(20_000)
    x, valid = kernel.truncated_normal(u, np.full(20_000, 0.3), np.ones(20_000), 0.0, 1.0)
    assert valid.all() and x.min() >= 0 and x.max() <= 1 and abs(x.mean() - 0.4839) < 0.01
    for mean, low, high in ((10.0, -5.0, 0.0), (-10.0, 0.0, 5.0)):
        assert not kernel.truncated_normal(u[:5], np.full(5, mean), np.ones(5), low, high)[1].any()
    edge = np.array([-1.6448, -1.6450])  # 95 % of the mass lies below 0
    assert kernel.truncated_normal(np.array([0.5, 0.5]), edge, np.ones(2), 0.0, 9.0)[1].tolist() == [True, False]
    for z in (-4.0, -0.3, 1.7):
        p = scalars.normal_cdf(z)
        got = kernel.truncated_normal(np.array([p]), np.zeros(1), np.ones(1), -50.0, 50.0)[0][0]
        assert abs(got - z) < 1e-4
    g = kernel.truncated_gamma(u, np.full(20_000, 2.0), 1.0)
    top = scalars.gamma_cdf(2.0, 2)
    assert 0 <= g.min() and g.max() <= 2
    for q in (0.1, 0.5, 0.9):
        assert abs((g <= scalars.gamma_quantile(q * top, 2)).mean() - q) < 0.02


def test_same_seed_same_chain_and_resumed_chain():
    data = planted(1)
    whole = run(data, 60)
    again = run(data, 60)
    assert whole.trace == again.trace and (whole.a.matrix == again.a.matrix).all()
    assert run(data, 60, seed=6).trace != whole.trace
    for sparse in (False, True):
        straight = run(data, 60, sparse=sparse).result()
        chain = Chain(data, Params(3, n_iterations=60, seed=5, output_frequency=50, sparse=sparse), (5, 1, 0))
        while chain.phase != "done":
            blob = pickle.dumps(chain)
            assert len(blob) < 60_000  # the state without the data
            chain = pickle.loads(blob).attach(data).run(17)
        assert (chain.result().a_mean == straight.a_mean).all() and chain.result().trace == straight.trace


@pytest.mark.parametrize("side", ["A", "P"])
def test_fixed_side_is_kept_and_helps(side):
    data = planted(2)
    free = run(data, 200)
    given = free.result().a_mean if side == "A" else free.result().p_mean
    good = Chain(data, Params(3, n_iterations=60, seed=5, fixed=side), (1,), None, given).run()
    back = good.result()
    assert (given == (back.a_mean if side == "A" else back.p_mean)).all()
    noise = np.random.default_rng(0).permutation(given.ravel()).reshape(given.shape)
    bad = Chain(data, Params(3, n_iterations=60, seed=5, fixed=side), (1,), None, noise).run()
    assert good.chisq() < bad.chisq()


def test_pump_snapshots_and_normalisation():
    chain = run(planted(3), 40, pump=True, n_snapshots=4, snapshot_phase="all")
    r = chain.result()
    assert (r.pump.sum(axis=1) == 40).all() and len(r.snapshots) == 8
    assert r.p_mean.max() <= 1 + 1e-9 and (r.a_sd >= 0).all()
    zero = Chain(planted(3), Params(3, n_iterations=40, seed=5, output_frequency=0), (1,)).run()
    assert not zero.trace


def test_uncertainty_changes_the_statistic():
    data = planted(4)
    assert Chain(data, Params(3, n_iterations=1, seed=1), (1,), np.ones(data.shape)).chisq() == pytest.approx((data**2).sum())


def test_scalar_functions():
    assert [round(f, 3) for f in (scalars.gamma_pdf(0.5, 1), scalars.gamma_cdf(0.5, 1), scalars.gamma_quantile(0.5, 1))] == [0.607, 0.393, 0.693]
    assert abs(scalars.normal_pdf(0.5) - 0.35207) < 1e-5 and scalars.normal_quantile(0.5) == 0 and abs(scalars.normal_cdf(0.5) - 0.69146) < 1e-5
    for shape in (0.5, 2, 9.5):
        for p in (0.01, 0.4, 0.99):
            assert abs(scalars.gamma_cdf(scalars.gamma_quantile(p, shape, 3.0), shape, 3.0) - p) < 1e-9
    assert scalars.hours(3725) == "01:02:05" and scalars.percent_complete(5, 5, 10) == 100
    assert scalars.which_max(np.array([1, 3, 3])) == 1 and scalars.is_zero(np.zeros(2)) and scalars.dot_difference(np.ones(2), np.ones(2), np.zeros(2)) == 2
    with pytest.raises(ValueError):
        scalars.normal_quantile(2)


def test_params():
    with pytest.raises(TypeError):
        Params()
    p = Params(5, distributed="none", n_sets=5)
    assert p.distributed is None and (p.cut, p.min_ns, p.max_ns) == (5, 3, 8)
    assert p.with_(alpha=0.5).alpha_p == 0.5 and p.with_(n_patterns=3).cut == 3 and p.with_(cut=9).cut == 9
    assert Params.from_json(Params(3, seed=1, explicit_sets=((1, 2), (3, 4)), n_sets=2).to_json()) == Params(3, seed=1, explicit_sets=((1, 2), (3, 4)), n_sets=2)
    for bad in ({"n_patterns": 0}, {"n_patterns": 2, "alpha_a": -1}, {"n_patterns": 2, "distributed": "x"}, {"n_patterns": 2, "fixed": "Q"}, {"n_patterns": 2, "explicit_sets": ((1,),)}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(TypeError):
        p.with_(nothing=1)


def test_sparse_chain_from_cells_makes_no_grid():
    data = planted(6)
    data[3] = 0.0
    params = Params(3, n_iterations=30, seed=5, sparse=True)
    i, j = np.nonzero(data)
    mixed = np.random.default_rng(1).permutation(len(i))
    cells = Cells(i[mixed], j[mixed], data[i, j][mixed], data.shape)
    one, two = Chain(data, params, (5,)).run().result(), Chain(cells, params, (5,)).run().result()
    assert (one.a_mean == two.a_mean).all() and (one.p_mean == two.p_mean).all() and one.trace == two.trace
    large = Cells(np.array([7, 2_999_999]), np.array([999_999, 0]), np.array([2.0, 3.0]), (3_000_000, 1_000_000))
    assert Chain(large, params, (1,)).chisq() == 200


def test_a_sets_rows_stay_numbers():
    from factorloom.operators import factorize

    n = 30_000
    cells = pd.DataFrame({"set_id": 0, "idx": np.repeat(np.arange(4), n), "cross": np.tile(np.arange(n), 4), "value": np.ones(4 * n)})
    beside = pd.DataFrame({"set_id": [], "idx": [], "k": [], "mean": [], "state": []})
    task = factorize._chain(Params(3, n_iterations=1, seed=1), 1, n, False, False, False)
    tracemalloc.start()
    out = task((0,), cells, beside)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3 * (n + 4) + 5 and list(out.columns) == factorize._NAMES
    assert peak < 1_500 * n
    assert out["k"].isna().sum() == 5 and out["mean"].isna().sum() == 2 and out["chisq"].notna().sum() == 2


def test_rounds_in_pieces_give_what_whole_rounds_give(monkeypatch):
    n, k = 1_001, 3
    rng = np.random.default_rng(4)
    v = rng.exponential(1, (25, k))
    g = np.broadcast_to(v.T @ v, (n, k, k)) * rng.uniform(0, 9, (n, 1, 1))
    b = (g @ rng.exponential(1, (n, k, 1)))[:, :, 0]
    b[:50], g[:50] = 0.0, 0.0  # rows without information
    states = []
    for together in (64, 2_000):
        monkeypatch.setattr(kernel, "TOGETHER", together)
        s, draws = lone_side(n), np.random.default_rng(7)
        for heat in np.linspace(0.02, 1, 40):
            s.sweep(draws, 3 * n, b, g, heat)
        states.append((s.matrix, s.count, s.place, s.mass, s.proposals, draws.random()))
    assert states[0][1].max() > 4 and all(np.array_equal(x, y) for x, y in zip(*states, strict=True))
    d, w = rng.exponential(1, (n, 25)), rng.exponential(1, (n, 25))
    whole = DenseRows(d, w).coefficients(v)
    monkeypatch.setattr(kernel, "TOGETHER", 64)
    for rows in (DenseRows(d, w), DenseRows(d.T.copy(), w.T.copy()).transposed()):
        for x, y in zip(whole, rows.coefficients(v), strict=True):
            assert np.allclose(x, y, rtol=1e-12, atol=0)


def test_a_wide_chain_keeps_the_grid_once_and_its_rounds_small():
    n = 150_000
    chain = Chain(np.full((4, n), 2.0), Params(3, n_iterations=5, seed=1), (1,))
    assert np.shares_memory(chain.data[0].weight, chain.data[1].weight)
    chain.run(2)
    b, g = chain.data[1].coefficients(chain.a.matrix)
    tracemalloc.start()
    for step in (chain.p.births_and_deaths, chain.p.moves, chain.p.exchanges):
        step(chain.rng, b, g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * n  # 50 of them are the round's draws


@pytest.mark.parametrize("name, x, y", [("_NORMAL", "_GRID", "_CDF"), ("_NORMAL_INVERSE", "_CDF", "_GRID"), ("_GAMMA_INVERSE", "_GAMMA_CDF", "_GAMMA_GRID")])
def test_interpolation_is_that_of_numpy(name, x, y):
    x, y = getattr(kernel, x), getattr(kernel, y)
    rng = np.random.default_rng(2)
    near = np.concatenate([x, np.nextafter(x, -np.inf), np.nextafter(x, np.inf)])
    for v in (near, rng.uniform(x[0] - 0.1, x[-1] + 0.1, 200_000), rng.uniform(x[0], x[-1], 200_000) ** 9 / max(1, x[-1]) ** 8, np.full(3, x[-1] + 1), np.array([])):
        assert np.array_equal(getattr(kernel, name)(v), np.interp(v, x, y))
