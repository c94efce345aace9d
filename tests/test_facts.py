"""Rules that hold or don't: the sampler's invariants and distributions, parameters and results."""

import pickle
import warnings

import numpy as np
from pyspark.sql import functions as F

from factorloom.functions import scalars
from factorloom.model import Params, build_report
from factorloom.operators import factorize, kernel
from factorloom.sources import matrix_files


def assert_all(facts):
    assert facts and [name for name, holds in facts.items() if not holds] == []


def test_formats():
    told = {x: matrix_files.file_format(x) if matrix_files.supported(x) else "" for x in ("m.csv", "a.b/m.tsv", "m.gct", "m.mtx", "m.rds", "m.csv/x", "csv", "m.CSV", "m.h5ad")}
    assert told == {"m.csv": "csv", "a.b/m.tsv": "tsv", "m.gct": "gct", "m.mtx": "mtx", "m.rds": "", "m.csv/x": "", "csv": "", "m.CSV": "", "m.h5ad": ""}


def test_temperatures():
    assert [round(kernel.heat("equilibration", k, 50), 6) for k in range(1, 51)] == [min(1.0, 0.04 * k) if k < 25 else 1.0 for k in range(1, 51)]
    assert kernel.heat("sampling", 1, 50) == 1.0


def _data() -> np.ndarray:
    rng = np.random.default_rng(0)
    return rng.exponential(1, (25, 3)) @ rng.exponential(1, (3, 20))


def _invariants() -> dict[str, bool]:
    data, out = _data(), {}
    for sparse in (False, True):
        name = "sparse" if sparse else "dense"
        params = Params(3, n_iterations=200, seed=5, sparse=sparse)
        chain = kernel.Chain(data, params, (5,))
        first = chain.chisq()
        chain.run()
        masses, places, slots = True, True, True
        for side in (chain.a, chain.p):
            total = np.zeros(side.matrix.shape)
            for r, n in enumerate(side.count):
                np.add.at(total[r], side._bins(side.place[r, :n]), side.mass[r, :n])
                places &= bool(((side.place[r, :n] >= 0) & (side.place[r, :n] <= side.patterns)).all())
                slots &= bool((side.mass[r, :n] > 0).all() and not side.mass[r, n:].any() and np.isinf(side.place[r, n:]).all())
            masses &= bool(np.abs(total - side.matrix).max() < 1e-9 and (side.matrix >= 0).all())
        out |= {f"{name}: masses make the elements": masses, f"{name}: places lie on the line": places, f"{name}: free slots are empty": slots}
        out[f"{name}: the statistic falls"] = chain.chisq() < first / 4
        batch = chain.result().batch
        out[f"{name}: a round proposes at most once in a row"] = 1 < batch[0] <= 25 and 1 < batch[1] <= 20
        again = kernel.Chain(data, params, (5,))
        while again.phase != "done":
            again = pickle.loads(pickle.dumps(again)).attach(data).run(37)
        out[f"{name}: a resumed chain equals a straight one"] = bool((again.result().a_mean == chain.result().a_mean).all())
        out[f"{name}: another seed gives another chain"] = bool((kernel.Chain(data, params, (6,)).run().result().a_mean != chain.result().a_mean).any())
    return out


def test_sampler_invariants():
    assert_all(_invariants())


def _near(x: float, want: float, by: float) -> bool:
    return abs(x - want) < by


def _proposals() -> dict[str, bool]:
    rng, n, out = np.random.default_rng(5), 40_000, {}

    def side(patterns: int, alpha: float, places: tuple[float, ...] = (), masses: tuple[float, ...] = ()) -> kernel.Side:
        s = kernel.Side(n, patterns, alpha, 1.0, 100.0)
        s.count[:] = len(places)
        s.place[:, : len(places)], s.mass[:, : len(places)] = places, masses
        for p, m in zip(places, masses, strict=True):
            s.matrix[:, int(p)] += m
        return s

    def born(s: kernel.Side, b: np.ndarray | float, g: np.ndarray, rounds: int = 1) -> kernel.Side:
        k = s.patterns
        for _ in range(rounds):
            s.births_and_deaths(rng, np.broadcast_to(b, (n, k)).copy(), np.broadcast_to(g, (n, k, k)).copy())
        return s

    s = born(side(3, 0.1), 0.0, np.zeros((3, 3)))
    out["births come at alpha times the rate of deaths"] = _near(s.count.mean(), 0.3 / 1.3, 0.01)
    out["without data masses are exponential"] = _near(s.mass[s.mass > 0].mean() * s.rate, 1, 0.05)
    out["births are even over the line"] = _near((s.place[np.isfinite(s.place)] < 1).mean(), 1 / 3, 0.02)
    s = born(side(3, 0.1, (1.5,), (2.0,)), -1e6, np.ones((3, 3)))
    out["unwelcome atoms die"] = _near((s.count == 0).mean(), 1 / 1.3, 0.01) and not s.matrix[s.count == 0].any()
    s = born(side(1, 1e-9, (0.5,), (1.0,)), 8.0, np.full((1, 1), 4.0), 6)
    out["rebirths follow the conditional distribution"] = _near(s.matrix.mean(), (8 - s.rate) / 4, 0.02) and _near(s.matrix.std(), 0.5, 0.02)
    two = np.eye(2) * 400
    s = side(2, 1e-9, (0.5, 1.5), (1.0, 3.0))
    for _ in range(8):
        s.exchanges(rng, np.broadcast_to([1000.0, 600.0], (n, 2)).copy(), np.broadcast_to(two, (n, 2, 2)).copy())
    out["exchanges keep the mass of both"] = bool(np.allclose(s.matrix.sum(axis=1), 4))
    out["exchanges follow the likelihood"] = _near(s.matrix[:, 0].mean(), 2.5, 0.02)
    s = side(2, 1e-9, (0.3, 0.7), (1.0, 3.0))
    s.exchanges(rng, np.zeros((n, 2)), np.broadcast_to(two, (n, 2, 2)).copy())
    out["an exchange in one bin keeps the element"] = bool(np.allclose(s.matrix[:, 0], 4) and s.mass[:, 0].std() > 0.5)
    s = side(2, 1e-9, (0.5,), (2.0,))
    for _ in range(40):
        s.moves(rng, np.broadcast_to([0.0, 800.0], (n, 2)).copy(), np.broadcast_to(two, (n, 2, 2)).copy())
    out["moves go where the likelihood likes it"] = bool((s.matrix[:, 1] == 2).all())
    s = side(1, 1e-9, (0.2, 0.5, 0.9), (1.0, 1.0, 1.0))
    s.moves(rng, np.zeros((n, 1)), np.ones((n, 1, 1)))
    out["moves stay between the neighbours"] = bool((np.diff(s.place[:, :3], axis=1) > 0).all())
    return out


def test_proposal_distributions():
    assert_all(_proposals())


def _numbers() -> dict[str, bool]:
    rng = np.random.default_rng(np.random.SeedSequence([42, 1, 0]))
    u, few, many, e = rng.random(100_000), rng.poisson(3.0, 100_000), rng.poisson(80.0, 100_000), -np.log1p(-rng.random(100_000)) / 2
    again = np.random.default_rng(np.random.SeedSequence([42, 1, 0])).random(100_000)
    other = np.random.default_rng(np.random.SeedSequence([42, 1, 1])).random(100_000)
    return {
        "uniform": _near(u.mean(), 0.5, 0.005) and _near(u.var(), 1 / 12, 0.002) and u.min() >= 0 and u.max() < 1,
        "poisson of a small mean": _near(few.mean(), 3, 0.05) and _near(few.var(), 3, 0.1),
        "poisson of a large mean": _near(many.mean(), 80, 0.3) and _near(many.var(), 80, 2),
        "exponential": _near(e.mean(), 0.5, 0.01) and _near(e.var(), 0.25, 0.01),
        "one seed, one stream": bool((u == again).all()),
        "sets have streams of their own": abs(np.corrcoef(u, other)[0, 1]) < 0.02,
        "progress ends at 100": scalars.percent_complete(7, 7, 30) == 100 and 0 < scalars.percent_complete(3, 7, 30) < 100,
    }


def test_random_numbers():
    assert_all(_numbers())


def _refused(**settings) -> bool:
    try:
        Params(**settings)
    except (ValueError, TypeError):
        return True
    return False


def test_parameter_rules():
    p = Params(5, seed=1)
    ways = p.with_(n_sets=2, explicit_sets=((1,), (2,)))
    unknown = False
    try:
        p.with_(nothing=1)
    except TypeError:
        unknown = True
    labelled = p.with_annotation(["x", "y"], {"x": 1.0})
    sets = p.with_distributed(6, 4)
    facts = {
        "defaults": (p.n_iterations, p.alpha_a, p.alpha_p, p.max_gibbs_mass_a, p.sparse, p.n_sets, p.cut, p.min_ns, p.max_ns, p.fixed, p.pump) == (50_000, 0.01, 0.01, 100.0, False, 4, 5, 2, 6, "N", False),
        "none is no mode": Params(2, distributed="none").distributed is None,
        "patterns are required": _refused(),
        "positive counts": all(_refused(**{"n_patterns": 3, k: 0}) for k in ("n_iterations", "alpha_a", "seed", "n_sets", "cut", "min_ns")) and _refused(n_patterns=0),
        "known modes": _refused(n_patterns=3, distributed="x"),
        "known sides": _refused(n_patterns=3, fixed="Q"),
        "known snapshot phases": _refused(n_patterns=3, snapshot_phase="x"),
        "larger sets than the least": _refused(n_patterns=3, min_ns=3, max_ns=3),
        "as many explicit sets as sets": _refused(n_patterns=3, explicit_sets=((1,),)),
        "names or indices, not both": _refused(n_patterns=3, n_sets=2, explicit_sets=((1,), ("x",))),
        "weights of known groups": _refused(n_patterns=3, sampling_annotation=("x",), sampling_weight={"y": 1.0}),
        "alpha sets both sides": (p.with_(alpha=0.5).alpha_a, p.with_(alpha=0.5).alpha_p) == (0.5, 0.5),
        "largest mass sets both sides": (p.with_(max_gibbs_mass=7).max_gibbs_mass_a, p.with_(max_gibbs_mass=7).max_gibbs_mass_p) == (7, 7),
        "fewer patterns lower the cut": p.with_(n_patterns=3).cut == 3,
        "distributed settings": (sets.n_sets, sets.cut, sets.min_ns, sets.max_ns) == (6, 4, 3, 9),
        "annotation": (labelled.sampling_annotation, dict(labelled.sampling_weight)) == (("x", "y"), {"x": 1.0}) and labelled.get("seed") == 1,
        "unknown settings": unknown,
        "text and back": Params.from_json(ways.to_json()) == ways,
        "shown": "patterns 5" in repr(p) and "seed 1" in repr(p),
    }
    assert_all(facts)


def test_result_accessors(spark):
    m = factorize.from_numpy(spark, np.random.default_rng(0).gamma(2, 40, (25, 7)))
    params = Params(2, n_iterations=10, seed=3, output_frequency=0)
    out = factorize.factorize(m, params, n_iterations=12)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        nothing = [out.subsets, out.unmatched_patterns, out.clustered_patterns, out.correlation_to_mean]

    def refused(cell, p, **kw):
        try:
            factorize.factorize(cell, p, **kw)
        except ValueError:
            return True
        return False

    older = [factorize.single_cell(m, params.with_(n_sets=2, min_ns=1), fixed_patterns=_ones(spark, 25)), factorize.genome_wide(m, params.with_(n_sets=2, min_ns=1), fixed_patterns=_ones(spark, 7))]
    facts = {
        "loadings": out.feature_loadings.count() == 50,
        "factors": out.sample_factors.count() == 14,
        "older names": out.amplitude_matrix.count() == 50 and out.pattern_matrix.count() == 14,
        "statistic": out.mean_chisq > 0,
        "version": out.version.count(".") >= 1,
        "parameters": out.params.n_iterations == 12 and out.params.seed == 3,
        "shown": "25 genes x 7 samples, 2 patterns" in repr(out),
        "only distributed runs have sets": nothing == [None] * 4 and len(told) == 4 and older[0].subsets.count() == 7,
        "older entries": older[0].params.distributed == "single-cell" and older[1].params.distributed == "genome-wide",
        "overrides": factorize.factorize(m, params, single_cell=True, n_sets=2, min_ns=1, fixed_patterns=_ones(spark, 25)).params.distributed == "single-cell",
        "refuses negative values": refused(m.withColumn("value", -F.col("value")), params),
        "refuses too many patterns": refused(m, params.with_(n_patterns=7)),
        "refuses uncertainty in sparse mode": refused(m, params.with_(sparse=True), uncertainty=m),
        "report": all(x in build_report() for x in ("factorloom", "spark", "numpy", "arrow")),
    }
    assert_all(facts)


def _ones(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("mean", 1.0 + F.col("idx") % 3 + F.col("k"))
