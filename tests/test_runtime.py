import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: A session that was made, and whose workers were started, before the package was in reach of the driver alone.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert spark.range(4).mapInPandas(lambda it: it, "id long").count() == 4
sys.path.insert(0, {root!r})
{body}
print("fine")
"""


def run_apart(body: str, folder: str) -> None:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, body=body)], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_workers_get_the_package_from_the_driver(tmp_path):
    run_apart(
        """
import numpy as np
from factorloom.model import Params
from factorloom.operators import factorize
out = factorize.factorize(factorize.from_numpy(spark, np.arange(1.0, 61).reshape(10, 6)), Params(2, n_iterations=4, seed=1))
assert out.factors.count() == 32
""",
        str(tmp_path),
    )


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest

    from factorloom import runtime

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_checkpoint_dir(Session())
    assert runtime.shared_checkpoint_dir(spark)


def test_the_entry_is_imported_without_a_session(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_batches_are_bounded_and_never_raised(spark):
    from factorloom import runtime

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for held, want in (("64m", str(8 << 20)), ("67108864b", str(8 << 20)), ("1g", str(8 << 20)), ("1m", "1m"), ("4096", "4096")):
        spark.conf.set(key, held)
        runtime.bound_batches(spark)
        assert spark.conf.get(key) in (want, f"{want}b", "1048576b")
    spark.conf.unset(key)
