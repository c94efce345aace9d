"""One sparse chain over more cells than a task holds: blocks of rows and blocks of columns.

Given the other side rows don't know of each other (:mod:`kernel`), so a sweep over genes
runs in blocks of rows, each with its own cells.  Blocks are dealt in their order to at most
``GROUPS`` groups, a task each, which takes its blocks one after another.  A column's
coefficients are sums over rows: every group adds its blocks' parts as it goes and gives one
sum, the sums meet by blocks of columns in a shuffle, are added in the order of the groups,
and the columns sweep there.  So what an iteration moves grows with the columns, and not with
the rows times the columns.  An iteration is one job.  Blocks and groups follow from the
counts of cells, and blocks have random streams of their own, so results don't depend on the
cluster.

The samples' matrix, the smaller side, is broadcast to the blocks of rows in each iteration;
what the genes' side adds to its running sums needs the samples' maxima, and is added by the
next pass.  Cells and states are kept on the executors' disks, and states are checkpointed
every ``CHECKPOINT`` iterations.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..model import Params
from ..runtime import checkpointed, shared_checkpoint_dir, ship_package
from .kernel import LEAST_UPDATES, Cells, Side, SparseRows, heat

#: Cells and rows of a block of rows, about, and columns of a block of columns.
BLOCK_ROWS, BLOCK_COLUMNS = 500_000, 16_384
#: Groups of blocks of rows, at most; each gives a sum for every column in every iteration.
GROUPS = 36
#: Runs of rows that blocks are made of, at most; the driver gets a count for each.
RUNS = 4_096
#: Iterations between two checkpoints of the states.
CHECKPOINT = 10
#: Rows of a batch of results.
BATCH = 100_000


def _own(key: int) -> int:
    return key


class _Part:
    """A block's factor, its random stream and running sums."""

    def __init__(self, first: int, rows: int, params: Params, alpha: float, most: float, mean: float, seed: list[int]) -> None:
        self.first, self.side = first, Side(rows, params.n_patterns, alpha, mean, most)
        self.rng = np.random.default_rng(np.random.SeedSequence(seed))
        self.sums = [np.zeros(self.side.matrix.shape) for _ in range(2)]
        self.pump = np.zeros(self.side.matrix.shape if params.pump else (0, params.n_patterns), np.int64)
        self.snapshots: list[tuple[str, int, np.ndarray]] = []

    def keep(self, x: np.ndarray, pump: bool) -> None:
        self.sums[0] += x
        self.sums[1] += x * x
        if pump:
            self.pump[np.arange(len(x)), x.argmax(axis=1)] += 1

    def moments(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        total, squares = self.sums
        return total / max(n, 1), np.sqrt(np.maximum(0, squares - total**2 / max(n, 1)) / (n - 1)) if n > 1 else np.full(total.shape, np.nan)


def _packed(first: int, rows: int):
    """The cells of a block as one value: how many each row has, and columns and values in the order of rows."""

    def pack(cells: pd.DataFrame) -> bytes:
        x = Cells(cells["i"].to_numpy() - first, cells["j"].to_numpy(), cells["value"].to_numpy(), (rows, 0))
        return pickle.dumps((np.bincount(x.rows, minlength=rows).astype(np.int32), x.cols.astype(np.int32), x.values), 5)

    return pack


class _Laid:
    """The cells of a block as arrays; weights as in :class:`kernel.SparseRows`."""

    def __init__(self, packed: bytes) -> None:
        counts, cols, values = pickle.loads(packed)
        self.n = len(counts)
        self.rows, self.cols = np.repeat(np.arange(self.n), counts), cols.astype(np.int64)
        self.inverse = 1 / values
        self.more = self.inverse * self.inverse - 1
        self.base = SparseRows.BETA * len(values)


class _Sums:
    """Sums over cells for the coefficients of one side: b, and the lower half of G; then what BETA and Gram matrices add."""

    def __init__(self, n: int, patterns: int) -> None:
        self.near, self.more = np.zeros((patterns, n)), np.zeros((patterns * (patterns + 1) // 2, n))
        self.own, self.atoms = np.zeros((patterns, patterns)), 0

    def add(self, to: np.ndarray, other: np.ndarray, at: np.ndarray, cells: _Laid) -> None:
        """Cells of places ``to`` on this side and ``at`` on the ``other``, of which patterns without mass add nothing."""
        n = self.near.shape[1]
        near = [np.ascontiguousarray(x).take(at) if x.any() else None for x in other.T]
        for x, one in enumerate(near):
            if one is None:
                continue
            self.near[x] += np.bincount(to, one * cells.inverse, n)
            weighted = one * cells.more
            for y, two in enumerate(near[: x + 1]):
                if two is not None:
                    self.more[x * (x + 1) // 2 + y] += np.bincount(to, weighted * two, n)

    def part(self, first: int, end: int) -> tuple:
        """Of a block of places, those where anything was added."""
        near, more = self.near[:, first:end], self.more[:, first:end]
        at = np.flatnonzero(near.any(axis=0) | more.any(axis=0)).astype(np.int32)
        return at, near[:, at], more[:, at], self.own, self.atoms


def _coefficients(near: np.ndarray, more: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, n = near.shape
    g = np.empty((n, k, k))
    for values, x, y in zip(more, *np.tril_indices(k)):
        g[:, x, y] = g[:, y, x] = values + gram[x, y]
    return SparseRows.BETA * np.ascontiguousarray(near.T), SparseRows.BETA * g


def _summed(parts: list[tuple], columns: int, patterns: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The coefficients of a block of columns, and the rows' atoms, from the groups' sums in their order."""
    whole = _Sums(columns, patterns)
    for _, at, near, more, own, atoms in sorted(parts, key=lambda x: x[0]):
        whole.near[:, at] += near
        whole.more[:, at] += more
        whole.own += own
        whole.atoms += atoms
    return *_coefficients(whole.near, whole.more, whole.own), whole.atoms


def _row_step(params: Params, p, todo: dict):
    """A pass over groups of blocks of rows: what the last iteration left to add, then the sweep, then the columns' sums.

    States come first, then cells, of which one block is laid out at a time.
    """

    def block(group: int, part: _Part, cells: _Laid, whole: np.ndarray, gram: np.ndarray, sums: _Sums) -> Iterator[tuple]:
        side, a, told = part.side, part.side.matrix, {}
        if todo["norm"] is not None:
            part.keep(a * todo["norm"], params.pump)
        if todo["snapshot"]:
            part.snapshots.append((*todo["snapshot"], a.copy()))
        if todo["chisq"] or todo["share"] is not None:
            rows = _Sums(cells.n, params.n_patterns)
            rows.add(cells.rows, whole, cells.cols, cells)
            coefficients = _coefficients(rows.near, rows.more, gram)
            if todo["chisq"]:
                told["chisq"] = cells.base - 2 * float((a * coefficients[0]).sum()) + float(((coefficients[1] @ a[:, :, None])[:, :, 0] * a).sum())
        if todo["share"] is not None:
            side.sweep(part.rng, todo["share"] * len(a), *coefficients, todo["heat"])
            sums.add(cells.cols, a, cells.rows, cells)
            sums.own += a.T @ a
            sums.atoms += side.atoms
        yield group, ("told", part.first, told, side.proposals, side.rounds)
        yield group, part

    def run(group: int, items: Iterator[tuple]) -> Iterator[tuple]:
        parts, whole = {}, p.value
        gram, sums = whole.T @ whole, _Sums(len(whole), params.n_patterns)
        for _, x in items:
            if isinstance(x, _Part):
                parts[x.first] = x
            elif x[0] == "cells":
                yield from block(group, parts.pop(x[1]), _Laid(x[2]), whole, gram, sums)
        if todo["share"] is not None:
            for c in range(todo["blocks"]):
                yield c, ("part", group, *sums.part(c * todo["width"], (c + 1) * todo["width"]))

    return run


def _column_step(params: Params, todo: dict):
    """A pass over blocks of columns: the groups' sums are added in their order, then the sweep."""

    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        states, parts = {}, {}
        for c, x in items:
            if isinstance(x, _Part):
                states[c] = x
            elif x[0] == "part":
                parts.setdefault(c, []).append(x[1:])
        for c in sorted(states):
            part = states[c]
            side = part.side
            if todo["norm"] is not None:
                part.keep(side.matrix / todo["norm"], False)
            if todo["snapshot"]:
                part.snapshots.append((*todo["snapshot"], side.matrix.copy()))
            atoms = 0
            if todo["share"] is not None:
                b, g, atoms = _summed(parts.pop(c), len(side.count), params.n_patterns)
                side.sweep(part.rng, todo["share_p"] * len(side.count), b, g, todo["heat"])
            yield c, ("done", side.matrix, side.atoms, atoms, side.proposals, side.rounds)
            yield c, part

    return run


def _expanded(axis: str, samples: int, pump: bool):
    """Rows of results of stored parts, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["state"]:
                part = pickle.loads(packed)
                mean, sd = part.moments(samples)
                tables = [("factor", "", 0, mean, sd), *[("snapshot", phase, it, x, None) for phase, it, x in part.snapshots], *([("pump", "", 0, part.pump.astype(float), None)] if pump else [])]
                for kind, phase, it, x, more in tables:
                    k = x.shape[1]
                    for start in range(0, len(x), BATCH):
                        y = x[start : start + BATCH]
                        ids = np.arange(part.first + start, part.first + start + len(y))
                        yield pd.DataFrame({"kind": kind, "phase": phase, "iter": it, "axis": axis, "idx": np.repeat(ids, k), "k": np.tile(np.arange(k), len(y)), "mean": y.ravel(), "sd": 0.0 if more is None else more[start : start + BATCH].ravel()})

    return run


def run_blocks(cell: DataFrame, params: Params, shape: tuple[int, int], schema: str, stage: int = 1, set_id: int = 0) -> DataFrame:
    """Stored rows of ``schema`` of one sparse chain over positive cells (i, j, value)."""
    spark = cell.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    shared_checkpoint_dir(spark)
    began = time.monotonic()
    (n_rows, n_cols), level = shape, StorageLevel.DISK_ONLY
    cell = cell.where((F.col("value") > 0) & F.col("i").between(0, n_rows - 1) & F.col("j").between(0, n_cols - 1)).select("i", "j", "value")
    # runs of rows and what they hold; blocks are runs of about equal weight
    step = max(1, -(-n_rows // RUNS))
    held = {r["run"]: (r["n"], r["s"]) for r in cell.groupBy(F.floor(F.col("i") / step).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("s")).collect()}
    n_cells, weight, firsts, weights = sum(n for n, _ in held.values()), 0, [0], []
    for run in range(-(-n_rows // step)):
        own = held.get(run, (0, 0.0))[0] + step
        if weight and weight + own > BLOCK_ROWS:
            firsts.append(run * step)
            weights.append(weight)
            weight = 0
        weight += own
    ends, weights = [*firsts[1:], n_rows], [*weights, weight]
    mean = sum(held[r][1] for r in sorted(held)) / n_cells if n_cells else 1.0
    blocks, columns = len(firsts), -(-n_cols // BLOCK_COLUMNS)
    groups = min(GROUPS, blocks)
    dealt = ((np.cumsum(weights) - weights) * groups // sum(weights)).astype(int).tolist()  # blocks to groups, by weight
    bounds = spark.createDataFrame([(r, int(np.searchsorted(firsts, r * step, "right") - 1)) for r in range(-(-n_rows // step))], "run long, b int")
    keyed = cell.withColumn("run", F.floor(F.col("i") / step)).join(F.broadcast(bounds), "run").select("b", "i", "j", "value")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        return pd.DataFrame({"b": [b], "cells": [_packed(firsts[b], ends[b] - firsts[b])(rows)]})

    empty = lambda b: _packed(firsts[b], ends[b] - firsts[b])(pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "value": np.zeros(0)}))
    packed = keyed.repartition(blocks, "b").groupBy("b").applyInPandas(pack, "b int, cells binary")
    full = {int(np.searchsorted(firsts, run * step, "right") - 1) for run in held}
    given = packed.rdd.map(lambda r: (r["b"], bytes(r["cells"]))).union(sc.parallelize([b for b in range(blocks) if b not in full], 1).map(lambda b: (b, empty(b))))
    placed = given.map(lambda x: (dealt[x[0]], ("cells", firsts[x[0]], x[1]))).partitionBy(groups, _own)
    cells = placed.mapPartitions(lambda x: sorted(x, key=lambda y: y[1][1]), True).persist(level)
    seeds = [params.seed, stage, set_id]
    widths = [min(BLOCK_COLUMNS, n_cols - c * BLOCK_COLUMNS) for c in range(columns)]
    a = sc.parallelize(range(blocks), groups).map(lambda b: (dealt[b], b)).partitionBy(groups, _own).mapPartitions(
        lambda x: ((g, _Part(firsts[b], ends[b] - firsts[b], params, params.alpha_a, params.max_gibbs_mass_a, mean, [*seeds, 1, b])) for g, b in x), True
    )
    p = sc.parallelize(range(columns), columns).map(lambda c: (c, _Part(c * BLOCK_COLUMNS, widths[c], params, params.alpha_p, params.max_gibbs_mass_p, mean, [*seeds, 2, c]))).partitionBy(columns, _own).mapPartitions(lambda x: x, True)
    rng = np.random.default_rng(np.random.SeedSequence(seeds))
    whole, atoms_a, atoms_p, updates, samples = np.zeros((n_cols, params.n_patterns)), 0, 0, 0, 0
    todo, trace, done = {"norm": None, "snapshot": None, "chisq": None, "blocks": columns, "width": BLOCK_COLUMNS}, [], []
    for count, (phase, it) in enumerate([(x, n + 1) for x in ("equilibration", "sampling") for n in range(params.n_iterations)] + [(None, 0)]):
        sweeps = phase is not None
        steps = [int(rng.poisson(max(n, LEAST_UPDATES))) if sweeps else 0 for n in (atoms_a, atoms_p)]
        updates += sum(steps)
        todo |= {"share": steps[0] / n_rows if sweeps else None, "share_p": steps[1] / n_cols, "heat": heat(phase, it, params.n_iterations) if sweeps else 1.0}
        sent = sc.broadcast(whole)
        new_a = a.union(cells).mapPartitionsWithIndex(_row_step(params, sent, dict(todo)), True).persist(level)
        # map drops the groups' partitioner, else partitionBy into as many blocks of columns would move nothing
        parts = new_a.filter(lambda x: isinstance(x[1], tuple) and x[1][0] == "part").map(lambda x: x).partitionBy(columns, _own).mapPartitions(lambda x: x, True)
        new_p = parts.union(p).mapPartitions(_column_step(params, dict(todo)), True).persist(level)
        stops = count % CHECKPOINT == CHECKPOINT - 1
        if stops:
            new_p.checkpoint()
        found = dict(new_p.filter(lambda x: isinstance(x[1], tuple)).collect())  # the smaller side's matrix
        if todo["chisq"] or not sweeps:
            told = [x for _, x in sorted(new_a.filter(lambda x: isinstance(x[1], tuple) and x[1][0] == "told").collect(), key=lambda x: x[1][1])]
            if todo["chisq"]:
                trace.append((*todo["chisq"][:2], sum(x[2]["chisq"] for x in told), *todo["chisq"][2:]))
        if stops:  # states alone
            kept = new_a.filter(lambda x: isinstance(x[1], _Part)).persist(level)
            kept.checkpoint()
            kept.count()
            new_a.unpersist()
            new_a = kept
        a.unpersist()
        p.unpersist()
        done.append(sent)
        if len(done) > CHECKPOINT:
            done.pop(0).unpersist()
        a, p = new_a, new_p
        if count and count % CHECKPOINT == 0:  # shuffles of before the checkpoint stay on disk until the driver's garbage is collected
            new_a = new_p = parts = kept = None
            gc.collect()
            sc._jvm.System.gc()
        whole = np.concatenate([found[c][1] for c in range(columns)])
        if not sweeps:
            break
        atoms_a, atoms_p = found[0][3], sum(x[2] for x in found.values())
        top = whole.max(axis=0)
        samples += phase == "sampling"
        todo["norm"] = np.where(top == 0, 1.0, top) if phase == "sampling" else None
        todo["chisq"] = (phase, it, atoms_a, atoms_p) if params.output_frequency and (it % params.output_frequency == 0 or it == params.n_iterations) else None
        todo["snapshot"] = (phase, it) if params.n_snapshots and params.snapshot_phase in (phase, "all") and it % max(1, params.n_iterations // params.n_snapshots) == 0 else None
    batch = [sum(x[3] for x in told) / max(1, told[0][4]), sum(x[4] for x in found.values()) / max(1, found[0][5])]
    names = [x.split()[0] for x in schema.split(", ")]
    cast = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])
    few = [{"kind": "trace", "phase": phase, "iter": i, "chisq": float(c), "atoms_a": na, "atoms_p": np_} for phase, i, c, na, np_ in trace]
    few.append({"kind": "updates", "phase": "", "iter": 0, "idx": updates, "sd": time.monotonic() - began})
    few += [{"kind": "batch", "phase": "", "iter": 0, "axis": x, "sd": float(n)} for x, n in zip("AP", batch)]
    for row in few:
        row["mean"] = row.pop("sd", None)
    last = spark.createDataFrame([tuple(r.get(n) for n in names) for r in few], schema)
    out = [last]
    for axis, rdd in (("A", a), ("P", p)):
        states = spark.createDataFrame(rdd.filter(lambda x: isinstance(x[1], _Part)).map(lambda x: (pickle.dumps(x[1], 5),)), "state binary")
        out.append(cast(states.mapInPandas(_expanded(axis, samples, params.pump), "kind string, phase string, iter int, axis string, idx long, k int, mean double, sd double")))
    rows = checkpointed(out[0].unionByName(out[1]).unionByName(out[2]).withColumn("set_id", F.lit(set_id)).select(*names))
    for old in (cells, a, p):
        old.unpersist()
    return rows
