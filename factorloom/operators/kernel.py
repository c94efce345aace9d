"""The sampler of one chain: point masses, all rows of a side stepping together, NumPy only.

Both factors are sums of point masses, atoms.  A row of a factor has a line of K bins of
length one, and a matrix element is the mass in its bin.

Given the other side, rows don't know of each other: the likelihood is a product over rows,
and so is the prior, since a Poisson process is independent on the rows' lines.  A row's part
of it needs two coefficients, taken once for each sweep over a side,

    b_k = sum_j w_j d_j v_jk        G_kl = sum_j w_j v_jk v_jl

(weights w, data d, the other side's patterns v), since the log-likelihood of a row a is
a.b - a.G.a / 2 and a constant.  So a sweep is made of rounds; a round proposes one change in
every row and decides all of them in one set of array expressions whose size doesn't depend
on the columns.  No two proposals of a round touch the same row, so none waits for another.
A round's numbers are drawn at once; then ``TOGETHER`` rows at a time are decided, so that
what is made of them stays in a core's cache.  Rows don't meet, so this changes no result.

A round is of one kind: birth or death (half of them), move, or exchange (a quarter each).
On a row's line of K bins with n atoms a death is tried with probability n / (n + alpha K) and
else a birth, so that for each bin births are tried at alpha times the rate of an atom's
deaths; an empty line counts as one atom, so that it isn't filled at once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.scalars import normal_cdf

# Fixed values of the model.
#: Masses under this are none, and so is information under it.
EPSILON = 1e-5
#: Where so much of a truncated normal's mass lies on one side of its interval, nothing is drawn.
TAIL = 0.95
#: Equilibration's temperature rises to 1 over the first half: iteration * RISE / iterations.
RISE = 2.0
#: Updates of a side in an iteration are Poisson with the number of atoms, or this if that is less.
LEAST_UPDATES = 10
#: Rows that one set of array expressions takes.
TOGETHER = 16_384
#: Under so many rows a call costs more than its work.
FEW = 2_048


def heat(phase: str, iteration: int, iterations: int) -> float:
    return min(1.0, RISE * iteration / iterations) if phase == "equilibration" else 1.0


# --- draws -------------------------------------------------------------------


class Interpolation:
    """``np.interp`` between fixed points with the same values, faster for many arguments.

    The range is cut into equal steps.  Where a step holds one point or none, a table and one
    comparison give an argument's place; the others are left to ``np.interp``.
    """

    STEPS = 1 << 16
    MANY = (1 << 16) - 1  # more than there are points

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        with np.errstate(divide="ignore", invalid="ignore"):
            self.slope = np.append(np.diff(y) / np.diff(x), 0.0)
        self.scale = self.STEPS / (x[-1] - x[0])
        held = np.bincount(self._step(x), minlength=self.STEPS + 2)
        #: Points in the steps before.
        self.before = np.where(held > 1, self.MANY, np.cumsum(held) - held).astype(np.uint16)

    def _step(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.x[0]) * self.scale).astype(np.int64)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        if len(v) < FEW:
            return np.interp(v, self.x, self.y)
        low, high = self.x[0], self.x[-1]
        inside = np.flatnonzero((v > low) & (v < high))
        if len(inside) == len(v):
            return self._inside(v)
        out = np.where(v <= low, self.y[0], np.where(v >= high, self.y[-1], v))
        if len(inside):
            out[inside] = self._inside(v[inside])
        return out

    def _inside(self, v: np.ndarray) -> np.ndarray:
        before = self.before.take(self._step(v), mode="clip")
        at = before.astype(np.int64)
        at -= v < self.x.take(at, mode="clip")
        out = v - self.x.take(at, mode="clip")
        out *= self.slope.take(at, mode="clip")
        out += self.y.take(at, mode="clip")
        many = np.flatnonzero(before == self.MANY)
        if len(many):
            out[many] = np.interp(v[many], self.x, self.y)
        return out


#: The normal distribution on a grid, error under 1e-8, for interpolation both ways.
_GRID = np.linspace(-8.3, 8.3, (1 << 15) + 1)
_CDF = np.array([normal_cdf(z) for z in _GRID])
_NORMAL, _NORMAL_INVERSE = Interpolation(_GRID, _CDF), Interpolation(_CDF, _GRID)
#: The gamma distribution of shape 2, scale 1, on a grid.
_GAMMA_GRID = np.concatenate([[0.0], np.geomspace(1e-6, 40.0, 1 << 13)])
_GAMMA_CDF = -np.expm1(-_GAMMA_GRID) - _GAMMA_GRID * np.exp(-_GAMMA_GRID)
_GAMMA_INVERSE = Interpolation(_GAMMA_CDF, _GAMMA_GRID)


def truncated_normal(u: np.ndarray, mean: np.ndarray, sd: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Draws on [low, high] by inversion of ``u``, and which of them are valid (see ``TAIL``)."""
    a, b = _NORMAL((low - mean) / sd), _NORMAL((high - mean) / sd)
    x = mean + sd * _NORMAL_INVERSE(a + (b - a) * u)
    return np.minimum(np.maximum(x, low), high), (a <= TAIL) & (b >= 1 - TAIL)


def truncated_gamma(u: np.ndarray, high: np.ndarray, scale: float) -> np.ndarray:
    """Draws of shape 2 on [0, high] by inversion of ``u``."""
    y = high / scale
    top = -np.expm1(-y) - y * np.exp(-y)
    return np.minimum(_GAMMA_INVERSE(u * top) * scale, high)


# --- pieces ------------------------------------------------------------------


def _pieces(n: int) -> list[slice]:
    """0 to n in pieces of ``TOGETHER``; the last one is longer, since a product of few rows may round in another way."""
    starts = list(range(0, max(n - TOGETHER + 1, 1), TOGETHER))
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _near(rows: np.ndarray) -> np.ndarray | slice:
    """Ascending rows as a slice where none is left out, since reading a slice copies nothing."""
    first, end = int(rows[0]), int(rows[-1]) + 1
    return slice(first, end) if end - first == len(rows) else rows


def _row_sums(x: np.ndarray) -> np.ndarray:
    """``x.sum(axis=1)``; short rows are added column by column, which is their order there too."""
    if x.shape[1] >= 8:
        return x.sum(axis=1)
    total = x[:, 0].copy()
    for c in range(1, x.shape[1]):
        total += x[:, c]
    return total


# --- likelihood --------------------------------------------------------------


class DenseRows:
    """Coefficients of every row under normal errors of given size."""

    def __init__(self, data: np.ndarray, sigma: np.ndarray) -> None:
        self.shape = data.shape
        self.weight = 1 / sigma**2
        self.weighted = self.weight * data
        #: The statistic of the zero factors.
        self.base = float((self.weighted * data).sum())

    def coefficients(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = self.shape[0], v.shape[1]
        x, y = np.triu_indices(k)
        # even numbers of lines, since a product's last odd one may round in another way
        lines, pairs = (np.zeros((m + m % 2, len(v))) for m in (k, len(x)))
        lines[:k] = v.T
        for out, one, two in zip(pairs, x, y):
            np.multiply(lines[one], lines[two], out=out)
        b, g = np.empty((n, k)), np.empty((n, k, k))
        for rows in _pieces(n):
            if rows.stop < n:
                b[rows] = (lines @ self.weighted[rows].T)[:k].T
                part = pairs @ self.weight[rows].T
            else:
                b[rows] = self.weighted[rows] @ v
                part = (self.weight[rows] @ pairs[: len(x)].T).T
            own = g[rows]
            for column, one, two in zip(part, x, y):
                own[:, one, two] = column
                own[:, two, one] = column
        return b, g

    def transposed(self) -> DenseRows:
        """The other side's, which shares the arrays."""
        other = object.__new__(DenseRows)
        other.shape, other.base = self.shape[::-1], self.base
        other.weight, other.weighted = self.weight.T, self.weighted.T
        return other


class SparseRows:
    """The same for mostly zero data, from the cells that aren't: sigma is a tenth of a
    value, and 0.1 at zeros, whose part comes from the other side's Gram matrix."""

    BETA = 100.0

    def __init__(self, cells: Cells) -> None:
        self.shape = cells.shape
        starts = np.flatnonzero(np.diff(cells.rows, prepend=-1))
        self.some, self.starts = cells.rows[starts], starts
        self.cols, self.inverse, self.more = cells.cols, 1 / cells.values, 1 / cells.values**2 - 1
        self.base = self.BETA * len(cells.values)

    def coefficients(self, v: np.ndarray, gram: np.ndarray | float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``gram`` is the whole other side's, where ``v`` is a part of it."""
        k = v.shape[1]
        b = np.zeros((self.shape[0], k))
        g = np.empty((self.shape[0], k, k))
        g[:] = v.T @ v if gram is None else gram
        if len(self.cols):
            near = np.ascontiguousarray(v.T)[:, self.cols]  # patterns x cells, so that sums run along memory
            b[self.some] = np.add.reduceat(near * self.inverse, self.starts, axis=1).T
            weighted = near * self.more
            for x in range(k):
                part = np.add.reduceat(near[: x + 1] * weighted[x], self.starts, axis=1).T
                g[self.some, x, : x + 1] += part
                g[self.some, :x, x] += part[:, :x]
        return self.BETA * b, self.BETA * g


class Cells:
    """A matrix by its positive cells, in the order of rows; of a repeated cell the last counts."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
        order = np.lexsort((cols, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        last = np.ones(len(rows), bool)
        last[:-1] = (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])
        keep = last & (values > 0)
        self.rows, self.cols, self.values, self.shape = rows[keep], cols[keep], values[keep], shape

    @staticmethod
    def of(grid: np.ndarray) -> Cells:
        rows, cols = np.nonzero(grid > 0)
        return Cells(rows, cols, grid[rows, cols], grid.shape)

    def transposed(self) -> Cells:
        return Cells(self.cols, self.rows, self.values, self.shape[::-1])


# --- one side ----------------------------------------------------------------


class Side:
    """One factor as atoms, and the rounds that change it.

    A row's atoms are the first ``count`` slots of its row in ``place`` and ``mass``, in
    no order; free slots have place inf and mass 0.
    """

    def __init__(self, rows: int, patterns: int, alpha: float, nonzero_mean: float, max_gibbs_mass: float) -> None:
        self.patterns = patterns
        self.matrix = np.zeros((rows, patterns))
        self.count = np.zeros(rows, np.int64)
        self.place = np.full((rows, 4), np.inf)
        self.mass = np.zeros((rows, 4))
        self.line_rate = alpha * patterns
        self.rate = alpha * math.sqrt(patterns / nonzero_mean)
        self.max_mass = max_gibbs_mass / self.rate
        self.rounds = self.proposals = 0

    @property
    def atoms(self) -> int:
        return int(self.count.sum())

    def sweep(self, rng: np.random.Generator, steps: int, b: np.ndarray, g: np.ndarray, heat: float) -> None:
        """About ``steps`` proposals, and at least one of birth or death in each row."""
        if heat != 1.0:
            b, g = b * heat, g * heat
        shares = steps / max(len(self.count), 1) * np.array([0.5, 0.25, 0.25])
        shares[0] = max(shares[0], 1.0)
        rounds = (shares + rng.random(3)).astype(int).tolist()
        kinds = [0] * rounds[0] + [1] * rounds[1] + [2] * rounds[2]
        for kind in rng.permutation(kinds).tolist() if len(kinds) > 1 else kinds:
            (self.births_and_deaths, self.moves, self.exchanges)[kind](rng, b, g)
            self.rounds += 1

    def _between(self, rows: np.ndarray, one: np.ndarray, two: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood's derivative along mass that passes from ``two`` to ``one``, and its information."""
        k = self.patterns
        own = g[rows]
        slope = b[rows] - (own @ self.matrix[rows][:, :, None])[:, :, 0]
        at = np.arange(len(rows)) * k
        first, second = at + one, at + two
        s = own.take(first * k + one) + own.take(second * k + two) - 2 * own.take(first * k + two)
        return slope.take(first) - slope.take(second), s

    def _lines(self, rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """Slot by slot the places of the rows' atoms, and which rows have so many."""
        near, least = _near(rows), int(n.min())
        for c in range(int(n.max())):
            if c < least or len(rows) < FEW:
                yield slice(None), self.place[near, c]
            else:
                at = np.flatnonzero(n > c)
                yield at, self.place[rows[at], c]

    def _bins(self, place: np.ndarray) -> np.ndarray:
        return np.minimum(place.astype(np.int64), self.patterns - 1)

    def _add(self, rows: np.ndarray, bins: np.ndarray, change: np.ndarray) -> None:
        cell = rows * self.patterns + bins
        self.matrix.put(cell, np.maximum(self.matrix.take(cell) + change, 0.0))

    def _slots(self, rows: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Where the rows' slots are in the flat ``place`` and ``mass``."""
        return rows * self.mass.shape[1] + slot

    def births_and_deaths(self, rng: np.random.Generator, b: np.ndarray, g: np.ndarray) -> None:
        """New atoms take a mass from their conditional distribution.  Dying ones are drawn
        anew without their mass, and come back by the likelihood's gain."""
        n, line = self.count, self.line_rate
        dying = rng.random(len(n)) * (np.maximum(n, 1) + line) >= line
        rows = np.flatnonzero(~dying | (n > 0))
        if not len(rows):
            return
        self.proposals += len(rows)
        dying, u = dying[rows], rng.random((3, len(rows)))
        b, g = np.ascontiguousarray(b), np.ascontiguousarray(g)
        for part in _pieces(len(rows)):
            self._births_and_deaths(rows[part], dying[part], u[:, part], b, g)

    def _births_and_deaths(self, rows: np.ndarray, dying: np.ndarray, u: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
        near = _near(rows)
        n = self.count[near]
        slot = np.where(dying, (u[0] * n).astype(np.int64), n)
        if slot.max() >= self.mass.shape[1]:
            self._widen()
        held = self._slots(rows, slot)
        old = self.mass.take(held)  # 0 in a free slot
        place = np.where(dying, self.place.take(held), u[0] * self.patterns)
        bins = self._bins(place)
        cell = rows * self.patterns + bins
        own = g.reshape(-1, self.patterns).take(cell, axis=0)
        s = own.take(np.arange(len(rows)) * self.patterns + bins)
        slope = b.take(cell) - _row_sums(own * self.matrix[near]) + old * s
        # Without the other side's pattern or information only the prior speaks.
        informed = s > EPSILON
        safe = np.where(informed, s, 1.0)
        fresh, valid = truncated_normal(u[1], (slope - self.rate) / safe, 1 / np.sqrt(safe), 0.0, self.max_mass)
        if not informed.all():
            prior = np.where(dying, old, -np.log1p(-u[1]) / self.rate)
            fresh = np.where(informed, fresh, np.where(s > 0, old, prior))
        fresh = np.where(informed & ~valid, old, fresh)
        gain = fresh * (slope - s * fresh / 2)
        stays = (fresh >= EPSILON) & (~dying | (np.log(np.maximum(u[2], 1e-300)) < gain))
        new = np.where(stays, fresh, 0.0)
        self._add(rows, bins, new - old)
        kept = held[stays]
        self.mass.put(kept, new[stays])
        self.place.put(kept, place[stays])
        self.count[rows[stays & ~dying]] += 1
        gone = ~stays & dying
        if gone.any():
            self._erase(rows[gone], slot[gone])

    def _erase(self, rows: np.ndarray, slot: np.ndarray) -> None:
        self.count[rows] -= 1
        last = self.count[rows]
        for held, free in ((self.mass, 0.0), (self.place, np.inf)):
            held[rows, slot] = held[rows, last]
            held[rows, last] = free

    def _widen(self) -> None:
        self.mass = np.concatenate([self.mass, np.zeros_like(self.mass)], axis=1)
        self.place = np.concatenate([self.place, np.full_like(self.place, np.inf)], axis=1)

    def moves(self, rng: np.random.Generator, b: np.ndarray, g: np.ndarray) -> None:
        """An atom goes to an even place between its neighbours; another bin has to be liked."""
        rows = np.flatnonzero(self.count > 0)
        if not len(rows):
            return
        self.proposals += len(rows)
        u = rng.random((3, len(rows)))
        for part in _pieces(len(rows)):
            self._moves(rows[part], u[:, part], b, g)

    def _moves(self, rows: np.ndarray, u: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
        n = self.count[_near(rows)]
        held = self._slots(rows, (u[0] * n).astype(np.int64))
        here = self.place.take(held)
        left, right = np.zeros(len(rows)), np.full(len(rows), float(self.patterns))
        for at, line in self._lines(rows, n):
            than = here[at]
            left[at] = np.maximum(left[at], np.where(line < than, line, 0.0))
            right[at] = np.minimum(right[at], np.where(line > than, line, np.inf))
        there = left + (right - left) * u[1]
        one, two = self._bins(here), self._bins(there)
        goes = one == two
        across = np.flatnonzero(~goes)
        if len(across):
            far, one, two, mass = rows[across], one[across], two[across], self.mass.take(held[across])
            slope, s = self._between(far, one, two, b, g)
            gain = mass * (-slope - s * mass / 2)
            liked = np.log(np.maximum(u[2, across], 1e-300)) < gain
            goes[across] = liked
            self._add(far[liked], one[liked], -mass[liked])
            self._add(far[liked], two[liked], mass[liked])
        self.place.put(held[goes], there[goes])

    def exchanges(self, rng: np.random.Generator, b: np.ndarray, g: np.ndarray) -> None:
        """Mass passes between an atom and its right neighbour, the first one for the last.

        Between bins the amount comes from its conditional distribution; in one bin, where
        the likelihood doesn't change, the first atom's share is drawn anew.
        """
        rows = np.flatnonzero(self.count > 1)
        if not len(rows):
            return
        self.proposals += len(rows)
        u = rng.random((2, len(rows)))
        for part in _pieces(len(rows)):
            self._exchanges(rows[part], u[:, part], b, g)

    def _exchanges(self, rows: np.ndarray, u: np.ndarray, b: np.ndarray, g: np.ndarray) -> None:
        n = self.count[_near(rows)]
        held = self._slots(rows, (u[0] * n).astype(np.int64))
        here = self.place.take(held)
        first, ahead = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lowest, closest = np.full(len(rows), np.inf), np.full(len(rows), np.inf)
        for c, (at, line) in enumerate(self._lines(rows, n)):
            less = lowest[at]
            first[at] = np.where(line < less, c, first[at])
            lowest[at] = np.minimum(line, less)
            line, less = np.where(line > here[at], line, np.inf), closest[at]
            ahead[at] = np.where(line < less, c, ahead[at])
            closest[at] = np.minimum(line, less)
        last = np.isinf(closest)
        beside = self._slots(rows, np.where(last, first, ahead))
        one, two = self._bins(here), self._bins(np.where(last, lowest, closest))
        m1, m2 = self.mass.take(held), self.mass.take(beside)
        apart = one != two
        change, goes = np.zeros(len(rows)), np.ones(len(rows), bool)
        same, across = np.flatnonzero(~apart), np.flatnonzero(apart)
        change[same] = truncated_gamma(u[1, same], m1[same] + m2[same], 1 / self.rate) - m1[same]
        if len(across):
            far, i, j = rows[across], one[across], two[across]
            slope, s = self._between(far, i, j, b, g)
            informed = s > EPSILON
            safe = np.where(informed, s, 1.0)
            change[across], valid = truncated_normal(u[1, across], slope / safe, 1 / np.sqrt(safe), -m1[across], m2[across])
            goes[across] = informed & valid
        goes &= (m1 + change > EPSILON) & (m2 - change > EPSILON)
        self.mass.put(held[goes], (m1 + change)[goes])
        self.mass.put(beside[goes], (m2 - change)[goes])
        goes &= apart
        self._add(rows[goes], one[goes], change[goes])
        self._add(rows[goes], two[goes], -change[goes])


# --- the chain ---------------------------------------------------------------


@dataclass
class ChainResult:
    a_mean: np.ndarray
    a_sd: np.ndarray
    p_mean: np.ndarray
    p_sd: np.ndarray
    trace: list[tuple[str, int, float, int, int]]
    snapshots: list[tuple[str, int, np.ndarray, np.ndarray]]
    pump: np.ndarray
    updates: int
    seconds: float
    #: Mean number of proposals decided at once, by side.
    batch: tuple[float, float]


class Chain:
    """Alternating sweeps over both sides.

    Its state without the data can be pickled; :meth:`attach` gives the data back.  In
    sparse mode the data may be given as cells, and nothing of the grid's size is made.
    """

    def __init__(self, data: np.ndarray | Cells, params, seed: tuple[int, ...], sigma: np.ndarray | None = None, fixed: np.ndarray | None = None) -> None:
        self.params = params
        if params.sparse and not isinstance(data, Cells):
            data = Cells.of(data)
        positive = data.values if params.sparse else data[data > 0]
        total = positive.sum() if params.sparse else data.sum()
        mean = float(total / len(positive)) if len(positive) else 1.0
        self.rng = np.random.default_rng(np.random.SeedSequence(list(seed)))
        self.a = Side(data.shape[0], params.n_patterns, params.alpha_a, mean, params.max_gibbs_mass_a)
        self.p = Side(data.shape[1], params.n_patterns, params.alpha_p, mean, params.max_gibbs_mass_p)
        if fixed is not None:
            (self.a if params.fixed == "A" else self.p).matrix[:] = fixed
        self.sums = [np.zeros(m.shape) for m in (self.a.matrix, self.a.matrix, self.p.matrix, self.p.matrix)]
        self.pump = np.zeros(self.a.matrix.shape, np.int64)
        self.samples = 0
        self.phase, self.iteration, self.updates, self.seconds = "equilibration", 0, 0, 0.0
        self.trace: list[tuple[str, int, float, int, int]] = []
        self.snapshots: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        self.attach(data, sigma)

    def attach(self, data: np.ndarray | Cells, sigma: np.ndarray | None = None) -> Chain:
        if self.params.sparse:
            data = data if isinstance(data, Cells) else Cells.of(data)
            self.data = [SparseRows(data), SparseRows(data.transposed())]
        else:
            sigma = np.maximum(0.1 * data, 0.1) if sigma is None else sigma
            rows = DenseRows(data, sigma)
            self.data = [rows, rows.transposed()]
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "data"}

    def chisq(self) -> float:
        """The statistic of the current factors, from the coefficients of the rows."""
        b, g = self.data[0].coefficients(self.p.matrix)
        a = self.a.matrix
        return self.data[0].base - 2 * float((a * b).sum()) + float(((g @ a[:, :, None])[:, :, 0] * a).sum())

    def step(self) -> None:
        """One iteration, and what is recorded of it."""
        p = self.params
        self.iteration += 1
        warmth = heat(self.phase, self.iteration, p.n_iterations)
        for name, side, other, rows in (("A", self.a, self.p, self.data[0]), ("P", self.p, self.a, self.data[1])):
            steps = int(self.rng.poisson(max(side.atoms, LEAST_UPDATES)))
            self.updates += steps
            if p.fixed != name:
                side.sweep(self.rng, steps, *rows.coefficients(other.matrix), warmth)
        if self.phase == "sampling":
            self.collect()
        if p.output_frequency and (self.iteration % p.output_frequency == 0 or self.iteration == p.n_iterations):
            self.trace.append((self.phase, self.iteration, self.chisq(), self.a.atoms, self.p.atoms))
        if p.n_snapshots and p.snapshot_phase in (self.phase, "all") and self.iteration % max(1, p.n_iterations // p.n_snapshots) == 0:
            self.snapshots.append((self.phase, self.iteration, self.a.matrix.copy(), self.p.matrix.copy()))
        if self.iteration == p.n_iterations:
            self.phase, self.iteration = ("sampling", 0) if self.phase == "equilibration" else ("done", 0)

    def collect(self) -> None:
        """Add the state, its patterns scaled to maximum 1 in P, to the running sums."""
        a, p = self.a.matrix, self.p.matrix
        norm = None
        if self.params.fixed == "N":
            norm = np.array([x.max() for x in p.T])
            norm[norm == 0] = 1.0
        for (total, squares), x, scaled in ((self.sums[:2], a, np.multiply), (self.sums[2:], p, np.divide)):
            scale = None if norm is None else np.tile(norm, min(len(x), 2 * TOGETHER))
            for rows in _pieces(len(x)):
                y = x[rows].reshape(-1)
                y = y if scale is None else scaled(y, scale[: len(y)])
                y = y.reshape(-1, x.shape[1])
                total[rows] += y
                squares[rows] += y * y
        self.samples += 1
        if self.params.pump and norm is not None:
            self.pump[np.arange(len(a)), (a * norm).argmax(axis=1)] += 1

    def run(self, until: int | None = None) -> Chain:
        """To the end, or for so many iterations."""
        left, began = until, time.monotonic()
        while self.phase != "done" and (left is None or left > 0):
            self.step()
            left = None if left is None else left - 1
        self.seconds += time.monotonic() - began
        return self

    def result(self) -> ChainResult:
        n = max(self.samples, 1)

        def stats(total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return total / n, np.sqrt(np.maximum(0, squares - total**2 / n) / (n - 1)) if n > 1 else np.full(total.shape, np.nan)

        a, p = stats(*self.sums[:2]), stats(*self.sums[2:])
        if self.params.fixed == "A":
            a = self.a.matrix.copy(), np.zeros(self.a.matrix.shape)
        if self.params.fixed == "P":
            p = self.p.matrix.copy(), np.zeros(self.p.matrix.shape)
        batch = tuple(side.proposals / max(side.rounds, 1) for side in (self.a, self.p))
        return ChainResult(*a, *p, self.trace, self.snapshots, self.pump, self.updates, self.seconds, batch)
