"""Results as files that appear together: ``write.format("bundle")`` and ``read.format("bundle")``.

A bundle is a published folder (:mod:`stores`) of several text files, each in parts.  Rows
(file, place, line) are sorted by file and place in ranges, every task writes the parts of
the files it has lines of, and one manifest names all parts of all files.  So factors,
deviations, names, trace and summary of a result are there together or not at all: a write
that broke off leaves what was there before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import FACTOR, TRACE, Params, Result
from ..runtime import ship_package
from .stores import Publication, manifest, opened, qualified

LINES = "file string, place long, line string"
SIDES = {"A": "feature_loadings", "P": "sample_factors"}
BATCH_LINES = 4096


@dataclass
class Part(InputPartition):
    file: str
    name: str


@dataclass
class Parts(WriterCommitMessage):
    partition: int
    files: list[dict]


class BundleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.file = options["path"], options.get("file")
        listed = manifest(self.path)
        if listed is None:
            raise FileNotFoundError(f"{self.path} holds no published bundle")
        self.parts = [Part(f["file"], f["name"]) for f in listed["files"] if self.file in (None, f["file"])]

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, place = opened(self.path)
        with store.open_input_stream(f"{place}/{partition.name}") as stream:
            yield from pa.ipc.open_stream(stream)


class BundleWriter(DataSourceArrowWriter):
    """Lines sorted by file and place, in ranges of them."""

    def __init__(self, options: dict[str, str]):
        self.publication = Publication(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, files, out, sink = TaskContext.get(), [], None, None
        for batch in iterator:
            names = batch.column(0).to_pylist()
            start = 0
            for end in range(1, len(names) + 1):
                if end < len(names) and names[end] == names[start]:
                    continue
                if not files or files[-1]["file"] != names[start]:
                    if out is not None:
                        out.close()
                        sink.close()
                    name = f"{names[start]}-{context.partitionId():05d}-{context.taskAttemptId()}"
                    sink = self.publication.create(name)
                    out = pa.ipc.new_stream(sink, batch.schema)
                    files.append({"file": names[start], "name": name, "lines": 0})
                out.write_batch(batch.slice(start, end - start))
                files[-1]["lines"] += end - start
                start = end
        if out is not None:
            out.close()
            sink.close()
        return Parts(context.partitionId(), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.publication.publish([f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.publication.drop()


class BundleSource(DataSource):
    """Options: ``path``, and for reading ``file``, one of the bundle's (all by default)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: Any) -> DataSourceReader:
        return BundleReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(BundleSource)


def _factor_lines(factors: DataFrame, axis: str, value: str) -> DataFrame:
    """A line for each row of one side: its number, name and patterns in order."""
    rows = factors.where(F.col("axis") == axis).groupBy("idx", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias("v"))
    line = F.to_json(F.struct("idx", "name", "v"), {"ignoreNullFields": "false"})
    return rows.select(F.lit(SIDES[axis] + ("" if value == "mean" else f"_{value}")).alias("file"), F.col("idx").alias("place"), line.alias("line"))


def publish(result: Result, folder: str) -> None:
    """Both factors and their deviations, the trace and the summary, as one bundle of JSON lines."""
    spark = result.factors.sparkSession
    register(spark)
    numbered = result.trace.select(F.lit("trace").alias("file"), F.col("iter").cast("long").alias("place"), F.to_json(F.struct("*")).alias("line"))
    summary = json.dumps({"mean_chisq": result.mean_chisq, "version": result.version, "params": result.params.to_json()})
    lines = numbered.unionByName(spark.createDataFrame([("summary", 0, summary)], LINES))
    for axis in SIDES:
        for value in ("mean", "sd"):
            lines = lines.unionByName(_factor_lines(result.factors, axis, value))
    ordered = lines.repartitionByRange("file", "place").sortWithinPartitions("file", "place").select("file", "place", "line")
    ordered.write.format("bundle").mode("overwrite").save(qualified(spark, folder))


def published(spark: SparkSession, folder: str) -> Result:
    """The result of a bundle; raises where none was published."""
    register(spark)
    path = qualified(spark, folder)
    lines = lambda file: spark.read.format("bundle").option("file", file).load(path)
    sides = []
    for axis, file in SIDES.items():
        parsed = [lines(f).select(F.from_json("line", "idx long, name string, v array<double>").alias("r")).select("r.idx", "r.name", F.posexplode("r.v").alias("k", value)) for f, value in ((file, "mean"), (f"{file}_sd", "sd"))]
        sides.append(parsed[0].join(parsed[1].drop("name"), ["idx", "k"]).select(F.lit(axis).alias("axis"), "idx", "name", "k", "mean", "sd"))
    summary = json.loads(lines("summary").first()["line"])
    trace = lines("trace").select(F.from_json("line", TRACE).alias("r")).select("r.*")
    return Result(sides[0].unionByName(sides[1]).select(*[c.split()[0] for c in FACTOR.split(", ")]), trace, Params.from_json(summary["params"]), summary["mean_chisq"])
