"""A run's folder: a manifest of what was written in it, and by which run.

Every stop of a run writes a table and then appends one row to ``manifest``; only tables
that the manifest names count, so a stop that died half-written is written again.  A row
holds the digest of what decides the run: its parameters, and checksums of the cells, their
uncertainty, the dealing into sets and the fixed side, which are summed by Spark and don't
depend on the order of rows.  A later run in the same folder

* with the same digest gets the finished table, or continues from the last stop;
* with another one is refused, and told what differs.

Values enter checksums as single-precision numbers, so that sums which were added up in
another order are still the same table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Params

SCHEMA = "stop int, status string, place string, digest string, parts string, written timestamp"
#: Parameters that don't decide a run's result.
FREE = ("checkpoint_path", "checkpoint_interval")
STOPPED, FINISHED = "stopped", "finished"


def checksum(table: DataFrame | None) -> str:
    """Rows of a table as a count and two sums of hashes; doubles count in single precision."""
    if table is None:
        return "none"
    columns = [F.col(f"`{n}`").cast("float") if t == "double" else F.col(f"`{n}`") for n, t in sorted(table.dtypes)]
    row = F.xxhash64(*columns)
    n, one, two = table.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.sum(F.hash(row, *columns).cast("long"))).first()
    return f"{n}:{one or 0}:{two or 0}"


def parts_of(params: Params, stage: int, **tables: DataFrame | None) -> dict[str, str]:
    """What decides a run, by name."""
    settings = {k: v for k, v in asdict(params).items() if k not in FREE}
    named = {f"parameter {k}": json.dumps(v, sort_keys=True, default=str) for k, v in settings.items()}
    return {**named, "stage": str(stage), **{k: checksum(t) for k, t in tables.items()}}


@dataclass
class RunFolder:
    spark: SparkSession
    path: str
    parts: dict[str, str]

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.parts, sort_keys=True).encode()).hexdigest()

    def entries(self) -> DataFrame:
        return manifest(self.spark, self.path)

    def last(self) -> tuple[int, str | None]:
        """Number and status of the last stop whose table is there; raises if another run wrote the folder."""
        for row in self.entries().orderBy(F.desc("stop")).collect():  # a row for each stop
            if row["digest"] != self.digest:
                other = json.loads(row["parts"])
                differing = sorted(k for k in {*other, *self.parts} if other.get(k) != self.parts.get(k))
                raise ValueError(f"{self.path} holds another run; these differ: {', '.join(differing)}")
            try:
                self.spark.read.schema("kind string").parquet(row["place"])
            except AnalysisException:  # lost since
                continue
            return row["stop"], row["status"]
        return 0, None

    def place(self, stop: int) -> str:
        return f"{self.path}/stop-{stop:06d}"

    def commit(self, stop: int, status: str) -> None:
        row = self.spark.createDataFrame([(stop, status, self.place(stop), self.digest, json.dumps(self.parts))], "stop int, status string, place string, digest string, parts string")
        row.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``SCHEMA`` of a run's folder; none where no stop was written."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
