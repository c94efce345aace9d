import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factorloom.model import Params
from factorloom.operators import factorize
from factorloom.sources import matrix_source, result_source, stores


def result(spark, seed=1):
    rng = np.random.default_rng(seed)
    cell = factorize.from_numpy(spark, rng.exponential(1, (15, 2)) @ rng.exponential(1, (2, 8)))
    names = tuple(f'g,"{i}' for i in range(15))
    return factorize.factorize(cell, Params(2, n_iterations=20, seed=seed, output_frequency=5, gene_names=names))


def test_a_published_result_comes_back_whole(spark, tmp_path):
    out, place = result(spark), str(tmp_path / "bundle")
    result_source.publish(out, place)
    back = result_source.published(spark, place)
    assert back.factors.orderBy("axis", "idx", "k").collect() == out.factors.orderBy("axis", "idx", "k").collect()
    assert back.trace.orderBy("phase", "iter").collect() == out.trace.orderBy("phase", "iter").collect()
    assert back.params == out.params and back.mean_chisq == out.mean_chisq
    again = result(spark, 2)
    result_source.publish(again, place)
    assert result_source.published(spark, place).mean_chisq == again.mean_chisq
    assert len([f for f in os.listdir(place) if f.startswith("data")]) == 1


def test_a_task_that_fails_leaves_no_readable_result(spark, tmp_path):
    out, place = result(spark), str(tmp_path / "bundle")
    broken = result(spark)
    broken.factors = out.factors.withColumn("mean", F.when((F.col("axis") == "P") & (F.col("idx") == 7), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("mean")))
    with pytest.raises(PySparkException):
        result_source.publish(broken, place)
    with pytest.raises(Exception, match="no published bundle"):
        result_source.published(spark, place)
    result_source.publish(out, place)
    before = stores.manifest(place)
    with pytest.raises(PySparkException):
        result_source.publish(broken, place)
    assert stores.manifest(place) == before and result_source.published(spark, place).mean_chisq == out.mean_chisq


def test_a_subset_of_a_file_is_all_that_is_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(1, (20, 2)) @ rng.exponential(1, (2, 12)), 6) + 0.5
    path = str(tmp_path / "m.csv")
    rows = [",".join([f"g{i}", *map(str, x[i])]) for i in range(20)]
    rows[15] = "g15," + ",".join(["unreadable"] * 12)
    (tmp_path / "m.csv").write_text("\n".join([",".join(["", *[f"s{j}" for j in range(12)]]), *rows]) + "\n")
    params = Params(2, n_iterations=15, seed=5, subset_dim=1, subset_indices=(9, 3, 11, 5, 7))
    out = factorize.factorize_file(spark, path, params)
    cell = factorize.from_numpy(spark, x)
    names = spark.createDataFrame([("A", i, f"g{i}") for i in range(20)] + [("P", j, f"s{j}") for j in range(12)], "axis string, idx long, name string")
    key = lambda r: r.factors.orderBy("axis", "idx", "k").collect()
    assert key(out) == key(factorize.factorize(cell, params, dims=names))
    assert [r["name"] for r in out.feature_loadings.where("k = 0").orderBy("idx").collect()] == ["g8", "g2", "g10", "g4", "g6"]
    flipped = factorize.factorize_file(spark, path, Params(2, n_iterations=5, seed=5, subset_dim=2, subset_indices=(9, 3, 11)), transpose=True)
    assert [r["name"] for r in flipped.sample_factors.where("k = 0").orderBy("idx").collect()] == ["g8", "g2", "g10"]
    with pytest.raises(PySparkException, match="not a number"):
        matrix_source.load(spark, path, "csv")[0].count()
