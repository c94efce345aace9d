import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.streaming import moments


def written(spark, path, x, first):
    rows = [(first + s, i, [float(v) for v in x[s, i]]) for s in range(len(x)) for i in range(x.shape[1])]
    spark.createDataFrame(rows, moments.SAMPLES).repartition(4).write.mode("append").parquet(path)


def expected(x):
    top = np.stack([(x.argmax(axis=2) == k).sum(axis=0) for k in range(x.shape[2])], axis=1)
    return x.mean(axis=0), x.std(axis=0, ddof=1), top


def check(spark, state, x):
    mean, sd, top = expected(x)
    rows = moments.moments(spark, state).collect()
    assert len(rows) == mean.size
    for r in rows:
        assert abs(r["mean"] - mean[r.idx, r.k]) < 1e-9 and abs(r.sd - sd[r.idx, r.k]) < 1e-9 and r.top == top[r.idx, r.k]


def test_a_stream_that_breaks_off_counts_every_sample_once(spark, tmp_path, monkeypatch):
    x = np.round(np.random.default_rng(0).gamma(1, size=(12, 5, 3)), 3)
    x[:, 0, 1] = x[:, 0].max(axis=1)  # ties go to the first
    samples, state, checkpoint = (str(tmp_path / n) for n in ("samples", "state", "checkpoint"))
    written(spark, samples, x[:6], 0)
    moments.fold(spark, samples, state, checkpoint, 2).awaitTermination()
    check(spark, state, x[:6])
    written(spark, samples, x[6:], 6)
    select = moments.folded

    def broken(rows):
        return select(rows).withColumn("n", F.when(F.lit(True), F.raise_error(F.lit("lost"))).cast("long"))

    monkeypatch.setattr(moments, "folded", broken)
    with pytest.raises(Exception, match="lost"):
        moments.fold(spark, samples, state, checkpoint, 1).awaitTermination()
    monkeypatch.setattr(moments, "folded", select)
    check(spark, state, x[:6])
    moments.fold(spark, samples, state, checkpoint, 1).awaitTermination()
    check(spark, state, x)
    moments.fold(spark, samples, state, checkpoint).awaitTermination()
    check(spark, state, x)


def test_one_sample_has_no_deviation(spark, tmp_path):
    samples, state, checkpoint = (str(tmp_path / n) for n in ("samples", "state", "checkpoint"))
    written(spark, samples, np.ones((1, 2, 2)), 0)
    moments.fold(spark, samples, state, checkpoint).awaitTermination()
    assert {(r["mean"], r.sd, r.top) for r in moments.moments(spark, state).collect()} == {(1.0, None, 1), (1.0, None, 0)}
