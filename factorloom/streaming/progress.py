"""The trace of a checkpointed run as a stream.

A run with a checkpoint folder writes one Parquet folder per stop.  The stream reads the
new ones and gives the chains' states as they come, without their contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.factorize import ROWS


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """set_id, kind, phase, iter, chisq, atoms_a, atoms_p of states and trace rows as they appear."""
    rows = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(folder)
    return rows.where("kind in ('state', 'trace')").select("set_id", "kind", "phase", "iter", "chisq", "atoms_a", "atoms_p")
