"""Matrix files as a data source: ``spark.read.format("matrix")`` and ``write.format("matrix")``.

A file, or a folder's files in their order, is cut into ranges of bytes, one a partition; a
line belongs to the range in which it begins.  Rows are numbered from the counts of lines of
the ranges before, which one pass over the bytes gives (:func:`load`), so nothing is
shuffled or sorted.  Coordinate files carry their numbers and need no such pass.

Wanted rows and columns are given to the scan as options: ranges without a wanted row aren't
opened, other rows are passed over unparsed, and of wanted rows only wanted columns are
parsed.  They aren't left to ``pushFilters``, since scans of one loaded table share a reader,
and what one scan pushes would be missing from the others.

Written matrices are streamed row by row from cells that are sorted by row, and published
by a manifest (:mod:`stores`): all partitions' files appear together or none does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.scalars import TRIM
from ..runtime import ship_package
from .stores import Publication, files_of, opened, qualified

FORMATS = {"csv": b",", "tsv": b"\t", "gct": b"\t", "mtx": b" "}
RANGE_BYTES = 64 << 20
CHUNK = 4 << 20
BATCH_CELLS = 1 << 16
_TRIM = TRIM.encode()
_NUMBER = re.compile(rb"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?")
_FOREIGN = re.compile(rb"[^0-9eE.+\-]")
_PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
SCHEMAS = {"cells": "i long, j long, value double", "names": "axis string, idx long, name string", "ranges": "number int, lines long"}


@dataclass
class Range(InputPartition):
    """Bytes of a file from ``start`` to ``end`` (None: all of a compressed one), and the lines before it and in it, if they are counted."""

    number: int
    file: str
    first: int
    start: int
    end: int | None
    before: int = 0
    lines: int | None = None


@dataclass
class Layout:
    """Where the rows of a matrix begin, and what its header says."""

    kind: str
    ranges: list[Range]
    fields: list[str] = field(default_factory=list)
    shape: tuple[int, int] | None = None

    @property
    def lead(self) -> int:
        """Fields of a row before its values."""
        return 2 if self.kind == "gct" else int(self.kind != "mtx" and self.fields[:1] == [""])


def _packing(file: str) -> str | None:
    return _PACKED.get(file.rsplit(".", 1)[-1])


def _stream(store, file: str):
    return store.open_input_stream(file, compression=_packing(file)) if _packing(file) else store.open_input_file(file)


def _blocks(stream, part: Range) -> Iterator[list[bytes]]:
    """The lines that begin in a range, without their ends, some at a time."""
    at = part.start if part.start == part.first else part.start - 1
    if part.end is not None:
        stream.seek(at)
    elif at:
        stream.read(at)
    skip, tail = at < part.start, b""
    while True:
        block = stream.read(CHUNK)
        data = tail + block
        cut = data.rfind(b"\n") if block else len(data)
        if cut < 0:
            tail = data
            continue
        lines = data[:cut].split(b"\n") if cut or block else []
        begun = at
        at, tail = at + cut + 1, data[cut + 1 :]
        if skip and lines:
            begun += len(lines[0]) + 1
            lines, skip = lines[1:], False
        if part.end is not None and at > part.end:
            starts = begun + np.cumsum([0, *[len(x) + 1 for x in lines]])[:-1] if lines else []
            yield lines[: int(np.searchsorted(starts, part.end))]
            return
        yield lines
        if not block:
            return


def _full(lines: list[bytes]) -> list[bytes]:
    return [x for x in lines if x.strip(b" \r")]


def plan(path: str, kind: str, range_bytes: int = RANGE_BYTES) -> Layout:
    """The ranges of a matrix behind its header, of which only the first lines are read."""
    store, _ = opened(path)
    files = files_of(path)
    heading, shape, place = {"gct": 3}.get(kind, 1), None, None
    header: list[bytes] = []
    for number, (file, size) in enumerate(files):
        at = 0
        with _stream(store, file) as stream:
            while len(header) < heading:
                line, more = b"", b"x"
                while not line.endswith(b"\n") and more:
                    more = stream.read(1 << 10)
                    line += more
                    if b"\n" in line:
                        line = line[: line.index(b"\n") + 1]
                if not line:
                    break
                at += len(line)
                if _packing(file):
                    stream.close()
                    stream = _stream(store, file)
                    stream.read(at)
                else:
                    stream.seek(at)
                if line.strip() and not (kind == "mtx" and b"%" in line):
                    header.append(line)
        if len(header) == heading:
            place = (number, at)
            break
    if place is None:
        raise ValueError(f"{path} is empty")
    fields = [x.decode().strip(TRIM) for x in header[-1].rstrip(b"\r\n").split(FORMATS[kind])] if kind != "mtx" else []
    if kind == "mtx":
        shape = tuple(int(x) for x in header[0].split()[:2])
    ranges: list[Range] = []
    for number, (file, size) in enumerate(files):
        first = place[1] if number == place[0] else 0
        if number < place[0]:
            continue
        if _packing(file):
            ranges.append(Range(len(ranges), file, first, first, None))
            continue
        for start in range(first, size, range_bytes):
            ranges.append(Range(len(ranges), file, first, start, min(start + range_bytes, size)))
    return Layout(kind, ranges, fields, shape)


class Wanted:
    """The chosen numbers of an index, or all of them."""

    def __init__(self, chosen: str | None):
        self.chosen = None if chosen is None else np.unique(np.array(json.loads(chosen), np.int64))
        self.held = None if chosen is None else frozenset(self.chosen.tolist())

    def has(self, x: int) -> bool:
        return self.held is None or x in self.held

    def meets(self, first: int, n: int) -> bool:
        """Whether any of ``n`` numbers from ``first`` is wanted."""
        return self.chosen is None or np.searchsorted(self.chosen, first) < np.searchsorted(self.chosen, first + n)

    def mask(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool) if self.chosen is None else np.isin(x, self.chosen)


def _numbers(tokens: list[bytes]) -> np.ndarray:
    """Doubles; words for missing or infinite values aren't numbers."""
    if not tokens:
        return np.zeros(0)
    try:
        if _FOREIGN.search(b"".join(tokens)) or not all(tokens):
            raise ValueError
        return np.array(tokens).astype(float)
    except ValueError:
        bad = next((t for t in tokens if not _NUMBER.fullmatch(t)), None)
        if bad is None:
            raise
        raise ValueError(f"not a number: {bad.decode(errors='replace') or 'nothing'}") from None


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"], options.get("content", "cells")
        self.kind = options.get("kind") or self.path.rsplit(".", 1)[-1]
        self.layout = plan(self.path, self.kind, int(options.get("rangebytes", RANGE_BYTES)))
        counts = options.get("counts")
        numbered = self.content != "ranges" and self.kind != "mtx"
        if counts is None and numbered and len(self.layout.ranges) > 1:
            raise ValueError("rows of several ranges need counts; use matrix_source.load")
        if counts is not None:
            before = 0
            for part, n in zip(self.layout.ranges, json.loads(counts), strict=True):
                part.before, part.lines, before = before, n, before + n
        self.wanted = {"i": Wanted(options.get("rows")), "j": Wanted(options.get("columns"))}

    def partitions(self) -> list[InputPartition]:
        if self.content == "ranges":
            return self.layout.ranges
        return [r for r in self.layout.ranges if r.lines is None or self.wanted["i"].meets(r.before, r.lines)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range has a wanted row
            return
        store, _ = opened(self.path)
        with _stream(store, partition.file) as stream:
            blocks = _blocks(stream, partition)
            if self.content == "ranges":
                yield pa.record_batch([pa.array([partition.number], pa.int32()), pa.array([sum(len(_full(x)) for x in blocks)], pa.int64())], ["number", "lines"])
            elif self.content == "names":
                yield from self._names(blocks, partition)
            else:
                yield from (self._coordinates if self.kind == "mtx" else self._rows)(blocks, partition)

    def _names(self, blocks: Iterator[list[bytes]], part: Range) -> Iterator[pa.RecordBatch]:
        at = part.before
        for lines in blocks:
            lines = _full(lines)
            names = [x.split(FORMATS[self.kind], 1)[0].strip(_TRIM).decode() for x in lines]
            yield pa.record_batch([pa.array(["A"] * len(names), pa.string()), pa.array(np.arange(at, at + len(names))), pa.array(names, pa.string())], ["axis", "idx", "name"])
            at += len(names)

    def _coordinates(self, blocks: Iterator[list[bytes]], part: Range) -> Iterator[pa.RecordBatch]:
        for lines in blocks:
            lines = [x for x in _full(lines) if b"%" not in x]
            tokens = [t for x in lines for t in (x.split() + [b""] * 3)[:3]]
            i, j = (_numbers(tokens[n::3]).astype(np.int64) - 1 for n in (0, 1))
            value = _numbers(tokens[2::3])
            keep = self.wanted["i"].mask(i) & self.wanted["j"].mask(j)
            yield _cells(i[keep], j[keep], value[keep])

    def _rows(self, blocks: Iterator[list[bytes]], part: Range) -> Iterator[pa.RecordBatch]:
        at, lead, width = part.before, self.layout.lead, max(1, len(self.layout.fields) - self.layout.lead)
        rows, columns = self.wanted["i"], self.wanted["j"]
        chosen = None if columns.chosen is None else [j for j in range(width) if columns.has(j)]
        separator, held, size = FORMATS[self.kind], [], 0
        for lines in blocks:
            for line in _full(lines):
                i, at = at, at + 1
                if not rows.has(i):
                    continue
                tokens = [x.strip(_TRIM) for x in line.split(separator)[lead : lead + width]]
                js = range(len(tokens)) if chosen is None else [j for j in chosen if j < len(tokens)]
                value = _numbers(tokens if chosen is None else [tokens[j] for j in js])
                held.append((np.full(len(value), i), np.asarray(js, np.int64), value))
                size += len(value)
                if size >= BATCH_CELLS:
                    yield _cells(*(np.concatenate(c) for c in zip(*held)))
                    held, size = [], 0
        if held:
            yield _cells(*(np.concatenate(c) for c in zip(*held)))


def _cells(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(value, pa.float64())], ["i", "j", "value"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int
    rows: int
    partition: int


class MatrixWriter(DataSourceArrowWriter):
    """Cells sorted by i and j, no row in two partitions, as lines."""

    def __init__(self, options: dict[str, str], append: bool):
        self.kind = options.get("kind") or options["path"].rsplit(".", 1)[-1]
        self.rows, self.columns = int(options.get("rows", 0)), int(options["columns"])
        self.append, self.publication = append, Publication(options["path"])
        if self.kind not in ("csv", "tsv", "mtx"):
            raise ValueError(f"can't write {self.kind}")

    def _header(self) -> bytes:
        if self.kind == "mtx":
            return b"%%%%MatrixMarket matrix coordinate real general\n%d %d 0\n" % (self.rows, self.columns)
        return FORMATS[self.kind].join([b"", *[b"Col%d" % (j + 1) for j in range(self.columns)]]) + b"\n"

    def _lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        """Text, and the number of rows it ends."""
        if self.kind == "mtx":
            for batch in batches:
                i, j, value = (c.to_pylist() for c in batch.columns)
                yield b"".join(b"%d %d %s\n" % (a + 1, b + 1, repr(v).encode()) for a, b, v in zip(i, j, value)), len(i)
            return
        row, held = None, np.zeros(self.columns)
        text = lambda: FORMATS[self.kind].join([b"Row%d" % (row + 1), *[repr(v).encode() for v in held.tolist()]]) + b"\n"
        for batch in batches:
            i, j, value = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
            cuts = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                if a < b and i[a] != row:
                    if row is not None:
                        yield text(), 1
                    row, held = int(i[a]), np.zeros(self.columns)
                held[j[a:b]] = value[a:b]
        if row is not None:
            yield text(), 1

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, size, rows = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}", 0, 0
        with self.publication.create(name) as out:
            for text, ended in self._lines(iterator):
                out.write(text)
                size, rows = size + len(text), rows + ended
        return Written(name, size, rows, context.partitionId())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        header = self._header()
        with self.publication.create(f"header.{self.kind}") as out:
            out.write(header)
        files = [{"name": f"header.{self.kind}", "bytes": len(header), "rows": 0}] * (not self.append)
        files += [{"name": m.name, "bytes": m.bytes, "rows": m.rows} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.rows]
        self.publication.publish(files, self.append, kind=self.kind)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.publication.drop()


class MatrixSource(DataSource):
    """Options: ``path``, ``kind`` (csv, tsv, gct or mtx; by default the extension), ``content`` (cells or names), ``rangeBytes``,
    ``rows`` and ``columns`` (JSON lists of the wanted ones); for writing ``rows`` and ``columns`` are how many there are."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "cells")]

    def reader(self, schema: Any) -> DataSourceReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return MatrixWriter(dict(self.options), append=not overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(MatrixSource)


def load(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES, rows: Sequence[int] | None = None, columns: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame | None, tuple[int, int] | None]:
    """(cells, dims, shape) of a matrix of any size, or of its wanted rows and columns under their numbers in the whole.

    Lines of several ranges are counted first, and those of one if a part is wanted; names
    and shape are the whole matrix', whose shape isn't known where lines weren't counted.
    """
    register(spark)
    layout = plan(path, kind, range_bytes)

    def source(content: str, **options):
        reader = spark.read.format("matrix").option("path", path).option("kind", kind).option("content", content).option("rangeBytes", range_bytes)
        for name, value in options.items():
            reader = reader if value is None else reader.option(name, json.dumps(value))
        return reader.load()

    part = {"rows": None if rows is None else [int(x) for x in rows], "columns": None if columns is None else [int(x) for x in columns]}
    if kind == "mtx":
        return source("cells", **part), None, layout.shape
    counts, shape = None, None
    if len(layout.ranges) > 1 or any(x is not None for x in part.values()):
        found = dict(source("ranges").collect())  # a row for each range
        counts = [found[n] for n in range(len(layout.ranges))]
        shape = (sum(counts), max(1, len(layout.fields) - layout.lead))
    samples = spark.createDataFrame([("P", n, x) for n, x in enumerate(layout.fields[layout.lead :])], SCHEMAS["names"])
    return source("cells", counts=counts, **part), source("names", counts=counts).unionByName(samples) if layout.lead else samples, shape


def save(cell: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> None:
    """Write cells as a published folder: a line for each row that occurs, a column up to the last that does."""
    spark = cell.sparkSession
    register(spark)
    path = qualified(spark, path)
    kind = kind or path.rsplit(".", 1)[-1]
    rows, columns = (x or 0 for x in cell.agg(F.max("i") + 1, F.max("j") + 1).first())
    once = cell.groupBy("i", "j").agg(F.max("value").alias("value"))
    ordered = once.repartitionByRange("i").sortWithinPartitions("i", "j").select("i", "j", "value")
    ordered.write.format("matrix").option("kind", kind).option("rows", rows).option("columns", columns).mode(mode).save(path)
