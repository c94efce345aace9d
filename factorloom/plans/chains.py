"""Queries of what a chain's run must give whatever it draws: keys, totals, kept sides and repeated runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Params
from ..operators import checkpoints, factorize, matrix
from ..runtime import checkpointed, shared_checkpoint_dir
from ..streaming import moments
from . import inputs
from .base import query, rounded

_FEW = 60
_NAMES = "SELECT 'A' AS axis, i AS idx, 'Gene_' || CAST(i + 1 AS VARCHAR) AS name FROM (SELECT DISTINCT i FROM m) UNION ALL SELECT 'P', j, 'Sample_' || CAST(j + 1 AS VARCHAR) FROM (SELECT DISTINCT j FROM m)"
_KEYS = f", n AS ({_NAMES}) SELECT axis, idx, name, CAST(k AS INTEGER) AS k FROM n CROSS JOIN generate_series(0, 1) g(k)"


def _run(spark: SparkSession, sf: str, **settings):
    return factorize.factorize(inputs.m(spark, sf), Params(2, n_iterations=_FEW, seed=42, output_frequency=20).with_(**settings))


@query(_KEYS)
def factor_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).factors.where("mean >= 0 and sd >= 0").select("axis", "idx", "name", "k")


@query(_KEYS)
def factor_keys_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, sparse=True).factors.where("mean >= 0 and sd >= 0").select("axis", "idx", "name", "k")


@query(_KEYS)
def factor_keys_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Every gene once, whichever set it was dealt into, under the names of the whole matrix."""
    out = _run(spark, sf, distributed="genome-wide", n_sets=3, min_ns=1, cut=2, max_ns=9)
    return out.factors.where("mean >= 0 and k < 2").select("axis", "idx", "name", "k")


@query("SELECT CAST(0 AS INTEGER) AS set_id, CAST(1 AS INTEGER) AS stage, phase, CAST(iter AS INTEGER) AS iter FROM (VALUES ('equilibration'), ('sampling')) p(phase) CROSS JOIN (VALUES (20), (40), (60)) i(iter)")
def trace_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).trace.where("chisq > 0 and atoms_a > 0 and atoms_p > 0").select("set_id", "stage", "phase", "iter")


@query("SELECT CAST(0 AS BIGINT) AS n")
def no_trace(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, output_frequency=0).trace.agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT i AS idx, CAST({_FEW} AS BIGINT) AS n FROM m")
def pump_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, pump=True).metadata["pump"].groupBy("idx").agg(F.sum("n").alias("n"))


@query("SELECT phase, CAST(iter AS INTEGER) AS iter, axis, count(*) AS n FROM (VALUES ('equilibration'), ('sampling')) p(phase) CROSS JOIN (VALUES (30), (60)) i(iter) CROSS JOIN (SELECT 'A' AS axis, i, k FROM (SELECT DISTINCT i FROM m) CROSS JOIN generate_series(0, 1) g(k) UNION ALL SELECT 'P', j, k FROM (SELECT DISTINCT j FROM m) CROSS JOIN generate_series(0, 1) g(k)) GROUP BY ALL")
def snapshot_keys(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = _run(spark, sf, n_snapshots=2, snapshot_phase="all").metadata["snapshots"]
    return snapshots.groupBy("phase", "iter", "axis").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run, CAST(iter - 1 AS BIGINT) AS idx, CAST(CASE WHEN k = 0 THEN 0 ELSE 1 END AS INTEGER) AS k, round(avg(disc), 6) AS mean, CAST(0 AS DOUBLE) AS sd FROM lines CROSS JOIN (VALUES ('first'), ('second')) r(run) GROUP BY ALL")
def kept_side(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed side comes back as it was given, also from the folder of a finished run."""
    given = inputs.lines(spark, sf).groupBy((F.col("iter") - 1).cast("long").alias("idx"), F.when(F.col("k") == 0, 0).otherwise(1).alias("k")).agg(F.avg("disc").alias("mean"))
    folder = f"{shared_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    params = Params(2, n_iterations=_FEW, seed=42, fixed="P", checkpoint_interval=50, checkpoint_path=folder)
    runs = [factorize.factorize(inputs.m(spark, sf), params, fixed_patterns=given).sample_factors.select(F.lit(x).alias("run"), "idx", "k", rounded("mean"), "sd") for x in ("first", "second")]
    return runs[0].unionByName(runs[1])


@query("SELECT CAST(stop AS INTEGER) AS stop, status, (SELECT count(*) FROM m) AS n_cells, (SELECT count(*) FROM (SELECT DISTINCT i FROM m)) AS n_members FROM (VALUES (1, 'stopped'), (2, 'stopped'), (3, 'finished')) v(stop, status)")
def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What a run's folder says of its stops, and of the table and sets that it belongs to."""
    folder = f"{shared_checkpoint_dir(spark)}/listed-{uuid.uuid4().hex}"
    _run(spark, sf, checkpoint_interval=50, checkpoint_path=folder)
    rows = lambda part: F.split(F.get_json_object("parts", f"$.{part}"), ":")[0].cast("long")
    return checkpoints.manifest(spark, folder).select("stop", "status", rows("cells").alias("n_cells"), rows("sets").alias("n_members"))


@query("SELECT CAST(0 AS BIGINT) AS different, true AS enough_updates, true AS timed")
def repeated_run(spark: SparkSession, sf: str) -> DataFrame:
    """The same seed gives the same factors, however the cells are dealt."""
    one = _run(spark, sf)
    two = factorize.factorize(inputs.m(spark, sf).repartition(5), one.params)
    # Each iteration makes at least ten updates a side on average.
    enough, timed = one.metadata["total_updates"] >= _FEW * 2 * 2 * 8, one.metadata["total_seconds"] > 0
    return one.factors.exceptAll(two.factors).agg(F.count(F.lit(1)).alias("different")).select("different", F.lit(enough).alias("enough_updates"), F.lit(timed).alias("timed"))


@query("SELECT CAST(0 AS BIGINT) AS different, CAST(2 AS BIGINT) AS stops")
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run that stops at checkpoints and continues from them gives a straight run's factors."""
    folder = f"{shared_checkpoint_dir(spark)}/chain-{uuid.uuid4().hex}"
    one, two = _run(spark, sf), _run(spark, sf, checkpoint_interval=50, checkpoint_path=folder)
    stops = checkpoints.manifest(spark, folder).where("status = 'stopped'").count()
    return one.factors.exceptAll(two.factors).agg(F.count(F.lit(1)).alias("different")).select("different", F.lit(stops).alias("stops"))


@query("SELECT true AS same")
def reported_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """The statistic of the result is that of its factors over the whole grid."""
    m, out = inputs.m(spark, sf), _run(spark, sf)
    again = matrix.residuals(m, out.feature_loadings, out.sample_factors).agg(F.sum(F.col("residual") * F.col("residual")).alias("x"))
    return again.select((F.abs(F.col("x") / F.lit(out.mean_chisq) - 1) < 1e-6).alias("same"))


@query("SELECT round(CAST(100 AS DOUBLE) * count(*), 3) AS chisq FROM m")
def first_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """Zero factors leave a tenth of each value as its error."""
    m = inputs.m(spark, sf)
    zero = lambda key: m.select(F.col(key).alias("idx")).distinct().select("idx", F.lit(0).alias("k"), F.lit(0.0).alias("mean"))
    return matrix.chi_square(m, zero("i"), zero("j")).select(rounded("chisq", 3))


@query("SELECT axis, CAST(k AS INTEGER) AS k, CAST(1 AS DOUBLE) AS top FROM (VALUES ('P')) x(axis) CROSS JOIN generate_series(0, 1) g(k)")
def consensus_tops(spark: SparkSession, sf: str) -> DataFrame:
    """Each consensus pattern of a two-stage run has maximum 1, and is returned, not zeros."""
    out = _run(spark, sf, distributed="genome-wide", n_sets=3, min_ns=1, cut=2, max_ns=9)
    return out.sample_factors.groupBy("axis", "k").agg(F.round(F.max("mean"), 9).alias("top")).where("k < 2")


@query(", s AS (SELECT DISTINCT i AS idx FROM m) SELECT count(*) AS n_members, count(DISTINCT idx) AS n_distinct, CAST(3 AS BIGINT) AS n_sets FROM s")
def dealt_members(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, sf, distributed="genome-wide", n_sets=3, min_ns=1)
    return out.subsets.agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("idx").alias("n_distinct"), F.countDistinct("set_id").alias("n_sets"))


@query("SELECT CAST(set_id AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS pattern, count(*) AS n FROM generate_series(1, 3) s(set_id) CROSS JOIN generate_series(1, 2) g(k) CROSS JOIN (SELECT DISTINCT j FROM m) GROUP BY ALL")
def first_pass_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of the first stage are labelled by their set and number."""
    out = _run(spark, sf, distributed="genome-wide", n_sets=3, min_ns=1)
    return out.unmatched_patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


_RATE = "0.01 * sqrt(2 / (sum(value) / count(*) FILTER (WHERE value > 0)))"


@query(f"SELECT round({_RATE}, 9) AS rate, round(100 / ({_RATE}), 4) AS max_mass, CAST(0.02 AS DOUBLE) AS births FROM m")
def hyper_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The prior's rate and the largest mass from the mean of what isn't zero, and births tried for each atom's deaths."""
    from ..operators.kernel import Side

    p = Params(2)
    side = Side(25, p.n_patterns, p.alpha_a, float(matrix.moments(inputs.m(spark, sf)).first()["nonzero_mean"]), p.max_gibbs_mass_a)
    return spark.createDataFrame([(round(side.rate, 9), round(side.max_mass, 4), round(side.line_rate, 6))], "rate double, max_mass double, births double")


@query("SELECT idx, k, round(mean, 5) AS mean, round(sd, 5) AS sd, coalesce(t.n, 0) AS top FROM (SELECT idx, k, avg(mean) AS mean, stddev_samp(mean) AS sd FROM samples GROUP BY idx, k) LEFT JOIN (SELECT idx, k, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY iter, idx ORDER BY mean DESC, k) AS n FROM samples) WHERE n = 1 GROUP BY idx, k) t USING (idx, k)")
def streamed_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Files of samples, folded by a stream that ends after half of them and is started again."""
    place = f"{shared_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = inputs.samples(spark, sf).groupBy("iter", "idx").agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("mean"))) for k in range(3)]).alias("v"))
    rows = checkpointed(rows.select(F.col("iter").cast("long").alias("iter"), "idx", "v"))
    for part in (rows.where("iter <= 3"), rows.where("iter > 3")):
        part.write.mode("append").parquet(f"{place}/samples")
        moments.fold(spark, f"{place}/samples", f"{place}/state", f"{place}/stream", 4).awaitTermination()
    return moments.moments(spark, f"{place}/state").select("idx", "k", rounded("mean", 5), rounded("sd", 5), "top")


@query("SELECT CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_negative, count(*) FILTER (WHERE value > 0) AS n_positive, count(*) AS n_cells, round(max(value), 4) AS largest, round(sum(value), 4) AS total FROM m")
def observed_load(spark: SparkSession, sf: str) -> DataFrame:
    """What is observed of the cells by the pass that loads them."""
    _, told = matrix.loaded(inputs.m(spark, sf))
    names = ("n_missing", "n_negative", "n_positive", "n_cells", "largest", "total")
    return spark.createDataFrame([tuple(told[n] for n in names)], "n_missing long, n_negative long, n_positive long, n_cells long, largest double, total double").withColumns({"largest": F.round("largest", 4), "total": F.round("total", 4)})
