"""What every job needs from the cluster: this package on the executors, and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    The driver serves the archive, so executors need no installation, no shared path and
    no environment of the driver's.
    """
    sc = spark.sparkContext
    if getattr(sc, "_factorloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="factorloom"), "factorloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._factorloom_shipped = True


#: Bytes of one Arrow batch between the JVM and a Python worker, which both hold it.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch to ``BATCH_BYTES``, if they are more.

    Batches are cut by rows otherwise, and 10,000 long texts are more than a task should hold.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        held = spark.conf.get(key)
    except PySparkException:  # a version without the setting
        return
    digits = "".join(c for c in held if c.isdigit())
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held.lower().rstrip("b")[-1:], 1)
    if int(digits or 0) * unit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that setting and the context's own folder are unset, a local run gets a temporary
    folder, and a cluster, whose machines couldn't share one, an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder, which outlives any executor."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by a table in the shared checkpoint folder.

    Loops use it: what a checkpointed plan keeps of its origin (estimates and constraints)
    grows with every round, and a table keeps nothing.
    """
    spark = df.sparkSession
    place = f"{shared_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
