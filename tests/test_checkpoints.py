import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.model import Params
from factorloom.operators import checkpoints, factorize


def cells(spark, seed=0, rows=20, cols=12):
    rng = np.random.default_rng(seed)
    return factorize.from_numpy(spark, rng.exponential(1, (rows, 3)) @ rng.exponential(1, (3, cols)))


def side(spark, n, k=3):
    return spark.createDataFrame([(i, j, 1.0 + (i * 7 + j * 3) % 5) for i in range(n) for j in range(k)], "idx long, k int, mean double")


def rows(out):
    return out.factors.orderBy("axis", "idx", "k").collect()


@pytest.mark.parametrize("fixed,n,every", [("P", 12, 9), ("A", 20, 0)])
def test_a_finished_run_with_a_fixed_side_is_returned(spark, tmp_path, fixed, n, every):
    cell, given = cells(spark), side(spark, n)
    params = Params(3, n_iterations=20, seed=4, fixed=fixed, checkpoint_interval=every, checkpoint_path=str(tmp_path / "run"))
    straight = factorize.factorize(cell, params.with_(checkpoint_path=None), fixed_patterns=given)
    first = factorize.factorize(cell, params, fixed_patterns=given)
    stops = checkpoints.manifest(spark, params.checkpoint_path).count()
    second = factorize.factorize(cell.repartition(5), params, fixed_patterns=given.orderBy(F.desc("k")))
    assert rows(first) == rows(second) == rows(straight) and second.mean_chisq == pytest.approx(first.mean_chisq, rel=1e-9)
    kept = {(r.idx, r.k): r["mean"] for r in second.factors.where(F.col("axis") == fixed).collect()}
    assert kept == {(r.idx, r.k): r["mean"] for r in given.collect()}
    assert checkpoints.manifest(spark, params.checkpoint_path).count() == stops == (5 if every else 1)


def test_another_run_is_refused(spark, tmp_path):
    cell = cells(spark)
    params = Params(3, n_iterations=20, seed=4, checkpoint_interval=9, checkpoint_path=str(tmp_path / "run"))
    done = rows(factorize.factorize(cell, params))
    for changed, what, kw in (
        (cell, "parameter seed", {"seed": 5}),
        (cell, "parameter n_iterations", {"n_iterations": 30}),
        (cell.withColumn("value", F.when((F.col("i") == 3) & (F.col("j") == 3), 9.25).otherwise(F.col("value"))), "cells", {}),
        (cell.where("i > 0 or j > 0").unionByName(cell.limit(1).selectExpr("0L i", "0L j", "1e-3 value")), "cells", {}),
    ):
        with pytest.raises(ValueError, match=f"differ: {what}$"):
            factorize.factorize(changed, params.with_(**kw))
    with pytest.raises(ValueError, match="differ: uncertainty$"):
        factorize.factorize(cell, params, uncertainty=cell.withColumn("value", F.lit(0.5)))
    assert rows(factorize.factorize(cell, params.with_(checkpoint_interval=4))) == done


def test_fixed_patterns_are_part_of_a_run(spark, tmp_path):
    params = Params(3, n_iterations=10, seed=4, fixed="P", checkpoint_path=str(tmp_path / "run"))
    given = side(spark, 12)
    factorize.factorize(cells(spark), params, fixed_patterns=given)
    with pytest.raises(ValueError, match="differ: fixed$"):
        factorize.factorize(cells(spark), params, fixed_patterns=given.withColumn("mean", F.col("mean") + 1))


def test_a_run_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    cell = cells(spark)
    params = Params(3, n_iterations=20, seed=4, checkpoint_interval=9, checkpoint_path=str(tmp_path / "run"))
    straight = rows(factorize.factorize(cell, params.with_(checkpoint_path=None)))
    commit = checkpoints.RunFolder.commit

    def broken(self, stop, status):
        if stop == 3:
            raise RuntimeError("lost")
        commit(self, stop, status)

    monkeypatch.setattr(checkpoints.RunFolder, "commit", broken)
    with pytest.raises(RuntimeError):
        factorize.factorize(cell, params)
    monkeypatch.setattr(checkpoints.RunFolder, "commit", commit)
    assert [r.stop for r in checkpoints.manifest(spark, params.checkpoint_path).orderBy("stop").collect()] == [1, 2]
    assert rows(factorize.factorize(cell, params)) == straight
    entries = checkpoints.manifest(spark, params.checkpoint_path).orderBy("stop").collect()
    assert [(r.stop, r.status) for r in entries] == [(1, "stopped"), (2, "stopped"), (3, "stopped"), (4, "stopped"), (5, "finished")]
    assert len({r.digest for r in entries}) == 1


def test_a_finished_stage_is_not_run_again(spark, tmp_path):
    import shutil

    cell = cells(spark, rows=30)
    params = Params(3, n_iterations=20, seed=9, distributed="genome-wide", n_sets=3, min_ns=1, checkpoint_path=str(tmp_path / "run"))
    done = rows(factorize.factorize(cell, params))
    written = [r.written for r in checkpoints.manifest(spark, f"{params.checkpoint_path}/stage1").collect()]
    shutil.rmtree(f"{params.checkpoint_path}/stage2")
    assert rows(factorize.factorize(cell, params)) == done
    assert [r.written for r in checkpoints.manifest(spark, f"{params.checkpoint_path}/stage1").collect()] == written
    assert checkpoints.manifest(spark, f"{params.checkpoint_path}/stage2").count() == 1
    with pytest.raises(ValueError, match="differ: parameter n_sets"):
        factorize.factorize(cell, params.with_(n_sets=4, min_ns=1))


def test_checksums_follow_rows_not_their_order(spark):
    cell = cells(spark)
    assert checkpoints.checksum(cell) == checkpoints.checksum(cell.orderBy(F.desc("value")).repartition(3))
    assert checkpoints.checksum(cell) != checkpoints.checksum(cell.unionByName(cell.limit(1)))
    assert checkpoints.checksum(cell.limit(0)) == checkpoints.checksum(cell.limit(0)) != checkpoints.checksum(None)
