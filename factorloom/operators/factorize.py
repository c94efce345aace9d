"""Factorisation of a table of cells: one chain per set of rows or columns, one set per task.

A chain's sweeps follow each other, so the parallel units are sets.  Each set's cells meet
in one task; seeds are keyed by (seed, stage, set), so results don't depend on the cluster.
With two stages, each set is factorised, its patterns are matched into a consensus, and
each set is refitted with the consensus fixed.

What chains return is written to shared storage, the checkpoint folder or the run's own, so
a lost executor repeats at most its set's work since the last checkpoint.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FACTOR, TRACE, Params, Result
from ..runtime import checkpointed, ship_package
from ..sources import matrix_files
from . import blocks, checkpoints, consensus, matrix, subsets
from .kernel import Cells, Chain

ROWS = "set_id int, kind string, phase string, iter int, axis string, idx long, k int, mean double, sd double, chisq double, atoms_a int, atoms_p int, state binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: What a task gets beside its cells: rows of the fixed side, and the state it continues from.
BESIDE = "set_id int, idx long, k int, mean double, state binary"
#: Cells of one set's dense grid; a larger set belongs in more sets or in sparse mode, which makes no grid.
MOST_CELLS = 200_000_000
#: Cells, rows and columns of a sparse chain that one task takes; larger ones run in blocks (:mod:`blocks`).
MOST_TOGETHER = 2_000_000


def _matrix_rows(set_id: int, kind: str, phase: str, it: int, axis: str, ids: np.ndarray, mean: np.ndarray, sd: np.ndarray | None = None) -> pd.DataFrame:
    k = mean.shape[1]
    return pd.DataFrame(
        {"set_id": set_id, "kind": kind, "phase": phase, "iter": it, "axis": axis, "idx": np.repeat(ids, k), "k": np.tile(np.arange(k), len(ids)), "mean": mean.ravel(), "sd": 0.0 if sd is None else sd.ravel()}
    )


def _typed(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Rows of ``ROWS`` of parts that may lack columns.  Numbers stay numbers, since a set's long side has many rows; ``parts`` is emptied."""
    sizes = [len(x) for x in parts]
    out = {}
    for name, kind in (x.split() for x in ROWS.split(", ")):
        columns = [x.pop(name) if name in x else None for x in parts]
        if kind in ("int", "long"):
            values, mask = np.zeros(sum(sizes), np.int32 if kind == "int" else np.int64), np.ones(sum(sizes), bool)
        else:
            values = np.full(sum(sizes), np.nan) if kind == "double" else np.full(sum(sizes), None, object)
        end = 0
        for column, size in zip(columns, sizes, strict=True):
            start, end = end, end + size
            if column is None:
                continue
            if kind in ("int", "long"):
                there = column.notna().to_numpy()
                mask[start:end] = ~there
                values[start:end][there] = column.to_numpy()[there].astype(values.dtype)
            else:
                values[start:end] = column.to_numpy()
        out[name] = pd.arrays.IntegerArray(values, mask) if kind in ("int", "long") else values
    parts.clear()
    return pd.DataFrame(out, copy=False)


def _chain(params: Params, stage: int, other: int, transposed: bool, given_sigma: bool, stops: bool):
    """The task of one set; ``other`` is the size of the side that isn't cut."""

    def run(key: tuple, cells: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        set_id = int(key[0])
        own = np.sort(cells["idx"].unique())
        if not params.sparse and len(own) * other > MOST_CELLS:
            raise ValueError("a set is too large for one task; use more sets or sparse mode")
        place = np.searchsorted(own, cells["idx"].to_numpy())
        cross = cells["cross"].to_numpy()
        there = cross >= 0
        value, sigma = cells["value"].to_numpy()[there], None
        if params.sparse:
            grid = Cells(place[there], cross[there], value, (len(own), other))
            grid = grid.transposed() if transposed else grid
        else:
            grid = np.zeros((len(own), other))
            grid[place[there], cross[there]] = value
            if given_sigma:
                sigma = np.full(grid.shape, 0.1)
                sigma[place[there], cross[there]] = cells["sigma"].to_numpy()[there]
            if transposed:  # the set holds columns
                grid, sigma = grid.T.copy(), None if sigma is None else sigma.T.copy()
        states = [bytes(x) for x in beside["state"] if x is not None]
        if states:
            chain = pickle.loads(states[0]).attach(grid, sigma)
        else:
            start = None
            if params.fixed != "N":
                start = np.zeros((grid.shape[0 if params.fixed == "A" else 1], params.n_patterns))
                rows = beside["idx"].to_numpy()
                if (params.fixed == "A") != transposed:  # the side that sets cut
                    rows = np.searchsorted(own, rows)
                start[rows, beside["k"].to_numpy().astype(int)] = beside["mean"].to_numpy()
            chain = Chain(grid, params, (params.seed, stage, set_id), sigma, start)
        del grid, sigma, place, cross, there, value  # the chain has what it needs of them
        chain.run(params.checkpoint_interval if stops else None)
        if stops and chain.phase != "done":
            return pd.DataFrame([(set_id, "state", chain.phase, chain.iteration, *[None] * 8, pickle.dumps(chain))], columns=_NAMES)
        r = chain.result()
        ids = {"A": np.arange(other) if transposed else own, "P": own if transposed else np.arange(other)}
        out = [_matrix_rows(set_id, "factor", "", 0, "A", ids["A"], r.a_mean, r.a_sd), _matrix_rows(set_id, "factor", "", 0, "P", ids["P"], r.p_mean, r.p_sd)]
        for phase, it, a, p in r.snapshots:
            out += [_matrix_rows(set_id, "snapshot", phase, it, "A", ids["A"], a), _matrix_rows(set_id, "snapshot", phase, it, "P", ids["P"], p)]
        if params.pump:
            out.append(_matrix_rows(set_id, "pump", "", 0, "A", ids["A"], r.pump.astype(float)))
        last = [(set_id, "trace", phase, it, None, None, None, None, None, c, na, np_, None) for phase, it, c, na, np_ in r.trace]
        last.append((set_id, "updates", "", 0, None, r.updates, None, r.seconds, None, None, None, None, None))
        last += [(set_id, "batch", "", 0, axis, None, None, size, None, None, None, None, None) for axis, size in zip("AP", r.batch, strict=True)]
        out.append(pd.DataFrame(last, columns=_NAMES))
        del chain, r
        return _typed(out)

    return run


def run_sets(cell: DataFrame, sets: DataFrame, params: Params, other: int, by: str, stage: int = 1, fixed: DataFrame | None = None, uncertainty: DataFrame | None = None, checkpoint: str | None = None) -> DataFrame:
    """Stored rows of ``ROWS`` from one chain per set.  ``by`` is the side that sets cut, i or j.

    A member without cells takes part as zeros.  With a checkpoint folder the chains stop
    every ``checkpoint_interval`` iterations (or at the end alone, if that is 0) and what they
    give is written there, under a manifest (:mod:`checkpoints`): a later call of the same
    run continues from the last stop, or returns what is finished, and any other is refused.
    """
    spark = cell.sparkSession
    ship_package(spark)
    cross = {"i": "j", "j": "i"}[by]
    cells = cell if uncertainty is None else matrix.with_sigma(cell, uncertainty)
    sigma = F.col("sigma") if uncertainty is not None else F.lit(None).cast("double")
    flat = cells.select(F.col(by).alias("idx"), F.col(cross).alias("cross"), "value", sigma.alias("sigma"))
    members = sets.select("set_id", "idx").distinct()
    keyed = members.join(flat, "idx", "left").select("set_id", "idx", F.coalesce("cross", F.lit(-1)).cast("long").alias("cross"), F.coalesce("value", F.lit(0.0)).alias("value"), *([] if uncertainty is None else ["sigma"]))
    none = F.lit(None)
    if fixed is None or params.fixed == "N":
        held = spark.createDataFrame([], BESIDE)
    else:
        rows = fixed.select("idx", "k", "mean", none.cast("binary").alias("state"))
        if (params.fixed == "A") == (by == "i"):
            # members' columns are in the cells beside it too, so these get names of their own first
            own = members.select(F.col("set_id").alias("s"), F.col("idx").alias("x"))
            rows = rows.join(own, F.col("idx") == F.col("x")).select(F.col("s").alias("set_id"), F.col("x").alias("idx"), "k", "mean", "state")
        else:  # every set needs the whole of the other side
            rows = rows.withColumn("set_id", F.explode(F.array(*[F.lit(r["set_id"]) for r in members.select("set_id").distinct().collect()])))  # one row per set
        held = rows.select("set_id", "idx", "k", "mean", "state")
    stops = bool(checkpoint and params.checkpoint_interval)
    task = _chain(params, stage, other, by == "j", uncertainty is not None, stops)
    run = lambda beside: keyed.groupBy("set_id").cogroup(beside.groupBy("set_id")).applyInPandas(task, ROWS)
    if not checkpoint:
        return checkpointed(run(held))
    parts = checkpoints.parts_of(params, stage, cells=cell, uncertainty=uncertainty, sets=members, fixed=None if fixed is None else fixed.select("idx", "k", "mean"))
    folder = checkpoints.RunFolder(spark, checkpoint, parts)
    stop, status = folder.last()
    while status != checkpoints.FINISHED:
        # a chain's state holds its fixed side, so a run that continues needs nothing else
        beside = held if status is None else _states(spark.read.schema(ROWS).parquet(folder.place(stop)))
        stop += 1
        run(beside).write.mode("overwrite").parquet(folder.place(stop))
        stopped = spark.read.schema(ROWS).parquet(folder.place(stop)).where("kind = 'state'").limit(1).count()
        status = checkpoints.STOPPED if stopped else checkpoints.FINISHED
        folder.commit(stop, status)
    return spark.read.schema(ROWS).parquet(folder.place(stop))


def _states(written: DataFrame) -> DataFrame:
    """The chains' states of a stop, as rows beside the cells."""
    none = F.lit(None)
    return written.where("kind = 'state'").select("set_id", none.cast("long").alias("idx"), none.cast("int").alias("k"), none.cast("double").alias("mean"), "state")


def names_of(spark: SparkSession, dims: DataFrame | None, params: Params, n_rows: int, n_cols: int) -> DataFrame:
    """axis, idx, name: given names, else the source's, else numbered ones."""
    sides = []
    for axis, given, n, prefix in (("A", params.gene_names, n_rows, "Gene_"), ("P", params.sample_names, n_cols, "Sample_")):
        if given is not None:
            if len(given) != n:
                raise ValueError(f"{len(given)} names for {n} {'genes' if axis == 'A' else 'samples'}")
            sides.append(spark.createDataFrame([(axis, i, str(x)) for i, x in enumerate(given)], "axis string, idx long, name string"))
            continue
        numbered = spark.range(n).select(F.lit(axis).alias("axis"), F.col("id").alias("idx"), F.concat(F.lit(prefix), (F.col("id") + 1).cast("string")).alias("number"))
        if dims is None:
            sides.append(numbered.withColumnRenamed("number", "name"))
        else:
            own = dims.where(F.col("axis") == axis).select("idx", "name")
            sides.append(numbered.join(own, "idx", "left").select("axis", "idx", F.coalesce("name", "number").alias("name")))
    return sides[0].unionByName(sides[1])


def prepared(
    cell: DataFrame, params: Params, dims: DataFrame | None = None, shape: tuple[int, int] | None = None, transpose: bool = False, uncertainty: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, tuple[int, int], DataFrame | None]:
    """Cells, names, shape and uncertainty after the transpose, then the subset; names go with their cells.

    Given names are those of the whole transposed matrix, before the subset.
    """
    spark = cell.sparkSession
    cell = cell.select("i", "j", F.col("value").cast("double").alias("value"))
    if transpose:
        cell = matrix.transpose(cell)
        uncertainty = None if uncertainty is None else matrix.transpose(uncertainty)
        dims = None if dims is None else matrix.transpose_names(dims)
        shape = None if shape is None else shape[::-1]
    if shape is None:
        top = cell.agg(F.max("i"), F.max("j")).first()
        shape = tuple(-1 if x is None else x for x in top)
        shape = (shape[0] + 1, shape[1] + 1)
    named = names_of(spark, dims, params, *shape)
    if params.subset_indices is not None and params.subset_dim:
        chosen = [x - 1 for x in params.subset_indices]
        if min(chosen) < 0 or max(chosen) >= shape[params.subset_dim - 1]:
            raise ValueError("subset indices lie outside the matrix")
        index = spark.createDataFrame(list(enumerate(chosen)), "pos long, idx long")
        cell = matrix.subset(cell, index, params.subset_dim)
        uncertainty = None if uncertainty is None else matrix.subset(uncertainty, index, params.subset_dim)
        named = matrix.subset_names(named, index, "AP"[params.subset_dim - 1])
        shape = (len(chosen), shape[1]) if params.subset_dim == 1 else (shape[0], len(chosen))
    return cell, named, shape, uncertainty


def factorize(
    cell: DataFrame,
    params: Params,
    uncertainty: DataFrame | None = None,
    fixed_patterns: DataFrame | None = None,
    transpose: bool = False,
    dims: DataFrame | None = None,
    shape: tuple[int, int] | None = None,
    **overrides,
) -> Result:
    """Factorise cells with indices from 0 into genes x patterns and samples x patterns."""
    if overrides.pop("single_cell", False):
        overrides["distributed"] = "single-cell"
    if overrides:
        params = params.with_(**overrides)
    spark = cell.sparkSession
    cell, named, (n_rows, n_cols), uncertainty = prepared(cell, params, dims, shape, transpose, uncertainty)
    cell, seen = matrix.loaded(cell)  # checked as it is loaded; all later passes read what was loaded
    if uncertainty is not None:
        matrix.check_uncertainty(uncertainty, params.sparse)
    if (params.fixed != "N") != (fixed_patterns is not None) and not params.distributed:
        raise ValueError("fixed patterns and the side they fix go together")
    if params.n_patterns >= min(n_rows, n_cols):
        raise ValueError("n_patterns must be less than both dimensions")
    cell = cell.where("value > 0")
    meta: dict = {"n_genes": n_rows, "n_samples": n_cols, "observed": seen}
    if params.distributed:
        rows, meta2, params = _two_stages(cell, params, n_rows, n_cols, named, fixed_patterns, uncertainty)
        meta |= meta2
    elif params.sparse and params.fixed == "N" and not params.checkpoint_path and seen["n_positive"] + n_rows + n_cols > MOST_TOGETHER:
        rows = blocks.run_blocks(cell, params, (n_rows, n_cols), ROWS)
    else:
        rows = run_sets(cell, subsets_all(spark, n_rows), params, n_cols, "i", 1, fixed_patterns, uncertainty, params.checkpoint_path)
    parts = rows.where("kind = 'factor'")
    if params.distributed:
        # The matched side is the same in every set; the other side's sets don't overlap,
        # unless rows were drawn with replacement, when their means are averaged.
        parts = parts.groupBy("axis", "idx", "k").agg(
            F.when(F.first("axis") == params.fixed, F.max("mean")).otherwise(F.avg("mean")).alias("mean"), F.avg("sd").alias("sd")
        )
    factors = parts.join(named, ["axis", "idx"]).select(*[c.split()[0] for c in FACTOR.split(", ")])
    trace = rows.where("kind = 'trace'").select("set_id", F.lit(2 if params.distributed else 1).alias("stage"), "phase", "iter", "chisq", "atoms_a", "atoms_p")
    chisq = matrix.chi_square(cell, factors.where("axis = 'A'"), factors.where("axis = 'P'"), uncertainty).first()[0]
    sums = rows.agg(
        F.sum(F.when(F.col("kind") == "updates", F.col("idx"))).alias("updates"),
        F.sum(F.when(F.col("kind") == "updates", F.col("mean"))).alias("seconds"),
        *[F.avg(F.when((F.col("kind") == "batch") & (F.col("axis") == x), F.col("mean"))).alias(x) for x in "AP"],
    ).first()
    meta |= {
        "total_updates": int(sums["updates"] or 0),
        "total_seconds": float(sums["seconds"] or 0.0),
        "average_batch": {"A": sums["A"], "P": sums["P"]},
        "snapshots": rows.where("kind = 'snapshot'").select("set_id", "phase", "iter", "axis", "idx", "k", F.col("mean").alias("value")),
        "pump": rows.where("kind = 'pump'").select("idx", "k", F.col("mean").cast("long").alias("n")),
        "mean_pattern": matrix.top_pattern(factors.where("axis = 'A'")),
    }
    return Result(factors, trace, params, float(chisq or 0.0), meta)


def factorize_file(spark: SparkSession, path: str, params: Params, transpose: bool = False, **kw) -> Result:
    """Factorise a matrix file; of a subset only its rows or columns are read."""
    wanted: dict = {}
    if params.subset_indices is not None and params.subset_dim:
        side = "rows" if (params.subset_dim == 1) != transpose else "columns"
        wanted = {side: sorted({x - 1 for x in params.subset_indices})}
    cell, dims, shape = matrix_files.read_matrix(spark, path, **wanted)
    return factorize(cell, params, transpose=transpose, dims=dims, shape=shape, **kw)


def subsets_all(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(0).alias("set_id"), F.col("id").cast("int").alias("pos"), F.col("id").alias("idx"))


def _two_stages(cell: DataFrame, params: Params, n_rows: int, n_cols: int, named: DataFrame, fixed: DataFrame | None, uncertainty: DataFrame | None) -> tuple[DataFrame, dict, Params]:
    spark = cell.sparkSession
    genome = params.distributed == "genome-wide"
    by, size, other, shared = ("i", n_rows, n_cols, "P") if genome else ("j", n_cols, n_rows, "A")
    if params.explicit_sets is not None:
        sets = subsets.explicit_sets(spark, params.explicit_sets, named.where(F.col("axis") == ("A" if genome else "P")))
    elif params.sampling_annotation is not None:
        annotation = spark.createDataFrame(list(enumerate(params.sampling_annotation)), "idx long, name string")
        sets = subsets.weighted_sets(annotation, params.sampling_weight or {}, params.n_sets, params.seed)
    else:
        sets = subsets.uniform_sets(spark.range(size).withColumnRenamed("id", "idx"), params.n_sets, params.seed)
    subsets.check_sizes(sets, params.n_patterns)
    meta: dict = {"subsets": sets}
    folder = lambda stage: params.checkpoint_path and f"{params.checkpoint_path}/stage{stage}"
    if fixed is None:
        first = run_sets(cell, sets, params.with_(fixed="N"), other, by, 1, None, uncertainty, folder(1))
        found = first.where((F.col("kind") == "factor") & (F.col("axis") == shared))
        patterns = found.select(F.concat((F.col("set_id") + 1).cast("string"), F.lit("."), (F.col("k") + 1).cast("string")).alias("pattern"), "idx", F.col("mean").alias("value"))
        agreed, to_mean, clustered = consensus.match_patterns(spark, patterns, params.cut, params.min_ns, params.max_ns)
        fixed = agreed.select("idx", F.col("cluster").alias("k"), F.col("value").alias("mean"))
        meta |= {"first_pass": first, "unmatched_patterns": patterns, "clustered_patterns": clustered, "correlation_to_mean": to_mean}
    n_patterns = fixed.agg(F.max("k")).first()[0] + 1
    last = params.with_(n_patterns=n_patterns, fixed=shared)
    return run_sets(cell, sets, last, other, by, 2, fixed, uncertainty, folder(2)), meta, last


def single_cell(cell: DataFrame, params: Params, **kw) -> Result:
    """Columns in sets; kept for callers of the older name."""
    return factorize(cell, params.with_(distributed="single-cell"), **kw)


def genome_wide(cell: DataFrame, params: Params, **kw) -> Result:
    """Rows in sets; kept for callers of the older name."""
    return factorize(cell, params.with_(distributed="genome-wide"), **kw)


def from_numpy(spark: SparkSession, values: Sequence[Sequence[float]] | np.ndarray) -> DataFrame:
    """Cells of a matrix in memory, zeros included."""
    x = np.asarray(values, float)
    i, j = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": x.ravel()}))


def iterations_per_second(seconds: float, params: Params) -> float:
    return 2 * params.n_iterations / seconds if seconds > 0 else math.inf
