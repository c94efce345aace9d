"""Matrix files as tables of cells, and results as files.

Files in a store that Python can open are read by the data source of :mod:`matrix_source`,
without a shuffle.  For any other that Spark reads, lines are numbered by the places that
Spark's text reader keeps in order within a split (``_lines``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TRIM, trimmed
from ..model import Params, Result
from ..runtime import checkpointed
from . import matrix_source, stores

FORMATS = ("csv", "tsv", "mtx", "gct")


def file_format(path: str) -> str:
    """The extension after the last point, if it is one that can be read."""
    ext = path.rsplit(".", 1)[-1]
    if "." not in path or "/" in ext or ext not in FORMATS:
        raise ValueError(f"{path}: not one of {', '.join(FORMATS)}")
    return ext


def supported(path: str) -> bool:
    try:
        return bool(file_format(path))
    except ValueError:
        return False


def parse_number(token: Column) -> Column:
    """A double; anything else fails the query and names the token.

    A sign, a point and an exponent of either case are read; words for missing or infinite values are not.
    """
    value = F.when(F.rlike(token, F.lit(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")), token.try_cast("double"))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(token, F.lit("nothing")))).cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """n, value: the lines of one file, or of a folder's files in the order of their names, numbered from 0.

    The text reader's splits are consecutive, and so are the ids it gives lines within
    one, so only the splits' numbers of lines are summed.
    """
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    keyed = raw.select(F.monotonically_increasing_id().alias("id"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("at"), "value")
    part = F.shiftright("id", 33)
    inside = F.col("id").bitwiseAND((1 << 33) - 1)
    counted = keyed.select("at", part.alias("part"), inside.alias("place"), "value")
    # One row per split: where its first line stands, since a task may read several splits, and how many lines come before.
    splits = counted.groupBy("at", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = splits.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = F.row_number().over(Window.partitionBy("at", "part").orderBy("place")) - 1
    numbered_lines = counted.withColumn("kept", kept).join(F.broadcast(before.select("at", "part", "before")), ["at", "part"])
    return numbered_lines.select((F.col("before") + F.col("kept")).cast("long").alias("n"), "value")


def read_delimited(spark: SparkSession, path: str, delimiter: str, skip: int = 0, drop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, dims) of a header line and rows.

    An empty first header field means that rows begin with their names; for GCT two lines
    and two fields are skipped and rows are named by the first.
    """
    lines = _lines(spark, path).where(F.col("n") >= skip)
    header = lines.where(F.col("n") == skip).select("value").first()
    if header is None:
        raise ValueError(f"{path} is empty")
    fields = [x.strip(TRIM) for x in header[0].split(delimiter)]
    lead = drop if drop is not None else int(fields[0] == "")
    parts = F.split("value", F.lit(f"\\Q{delimiter}\\E"))
    rows = lines.where(F.col("n") > skip).select((F.col("n") - skip - 1).alias("i"), F.transform(parts, trimmed).alias("f"))
    wide = rows.select("i", F.when(F.lit(lead > 0), F.col("f")[0]).alias("name"), F.slice("f", lead + 1, max(1, len(fields) - lead)).alias("v"))
    cells = wide.select("i", F.posexplode("v").alias("j", "token")).select("i", F.col("j").cast("long").alias("j"), parse_number(F.col("token")).alias("value"))
    samples = spark.createDataFrame([("P", n, x) for n, x in enumerate(fields[lead:])], "axis string, idx long, name string")
    genes = wide.where("name is not null").select(F.lit("A").alias("axis"), F.col("i").alias("idx"), "name")
    return cells, genes.unionByName(samples)


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """(cells, shape) of a coordinate file; indices become 0-based, entries not given are zero."""
    lines = _lines(spark, path).where(~F.contains("value", F.lit("%")))
    first = lines.orderBy("n").limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    shape = tuple(int(x) for x in first["value"].split()[:2])
    parts = F.split(F.trim("value"), r"\s+")
    cells = lines.where(F.col("n") > first["n"]).select(
        (parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), parse_number(parts[2]).alias("value")
    )
    return cells, shape


def read_10x(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """(cells, dims, shape) of a directory of counts: matrix.mtx with features.tsv (or genes.tsv) and barcodes.tsv.

    Each may be compressed.  Features are named by their second column, or by the first of one.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def find(*names: str) -> str:
        for name in names:
            for end in ("", ".gz"):
                if fs.exists(jvm.org.apache.hadoop.fs.Path(root, name + end)):
                    return f"{folder.rstrip('/')}/{name}{end}"
        raise ValueError(f"{folder} has no {names[0]}")

    counts = find("matrix.mtx")
    whole = stores.qualified(spark, counts)
    if stores.reachable(whole):
        cells, _, shape = matrix_source.load(spark, whole, "mtx")
    else:
        cells, shape = read_mtx(spark, counts)
    parts = F.split("value", "\t")
    features = _lines(spark, find("features.tsv", "genes.tsv")).select(F.lit("A").alias("axis"), F.col("n").alias("idx"), F.coalesce(F.get(parts, F.lit(1)), parts[0]).alias("name"))
    barcodes = _lines(spark, find("barcodes.tsv")).select(F.lit("P").alias("axis"), F.col("n").alias("idx"), parts[0].alias("name"))
    return cells, features.unionByName(barcodes), shape


def read_matrix(spark: SparkSession, path: str, rows: Sequence[int] | None = None, columns: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame | None, tuple[int, int] | None]:
    """(cells, dims, shape) of a file of any supported format; of its wanted rows and columns, if they are given, all else is left unread."""
    kind = file_format(path)
    whole = stores.qualified(spark, path)
    if stores.reachable(whole):
        return matrix_source.load(spark, whole, kind, rows=rows, columns=columns)
    dims, shape = None, None
    if kind == "mtx":
        cells, shape = read_mtx(spark, path)
    else:
        cells, dims = read_delimited(spark, path, "," if kind == "csv" else "\t", 2 if kind == "gct" else 0, 2 if kind == "gct" else None)
    for key, wanted in (("i", rows), ("j", columns)):
        cells = cells if wanted is None else cells.where(F.col(key).isin(sorted(set(wanted))))
    return cells, dims, shape


def file_info(spark: SparkSession, path: str) -> dict:
    """dimensions, row_names and col_names."""
    cells, dims, shape = read_matrix(spark, path)
    if shape is None:
        top = cells.agg(F.max("i"), F.max("j")).first()
        shape = ((top[0] if top[0] is not None else -1) + 1, (top[1] if top[1] is not None else -1) + 1)
    names = {"A": [], "P": []}
    if dims is not None:
        for r in dims.orderBy("axis", "idx").collect():
            names[r["axis"]].append(r["name"])
    return {"dimensions": shape, "row_names": names["A"], "col_names": names["P"]}


def numbered(frame: DataFrame, order: list[Column]) -> DataFrame:
    """With i, the place of each row in the order: rows are sorted by ranges, and the ranges' sizes summed beside them."""
    ranged = checkpointed(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("__inside", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(sizes), "__part").withColumn("i", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def from_wide(frame: DataFrame, name_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, dims) of a table with a column per sample, rows in the order of their names or values."""
    columns = [c for c in frame.columns if c != name_col]
    order = [name_col] if name_col else columns
    rows = numbered(frame, [F.col(f"`{c}`") for c in order])
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    cells = rows.select("i", F.posexplode(values).alias("j", "value")).select("i", F.col("j").cast("long").alias("j"), "value")
    samples = frame.sparkSession.createDataFrame([("P", n, c) for n, c in enumerate(columns)], "axis string, idx long, name string")
    if name_col is None:
        return cells, samples
    return cells, rows.select(F.lit("A").alias("axis"), F.col("i").alias("idx"), F.col(f"`{name_col}`").cast("string").alias("name")).unionByName(samples)


def from_triplets(frame: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Cells of compressed or coordinate triplets, repeated entries added up."""
    return frame.groupBy(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j")).agg(F.sum(F.col(value).cast("double")).alias("value"))


def bind_parts(parts: list[DataFrame], widths: list[int]) -> DataFrame:
    """Cells of matrices with the same rows, side by side."""
    out, start = None, 0
    for part, width in zip(parts, widths, strict=True):
        moved = part.select("i", (F.col("j") + start).alias("j"), "value")
        out = moved if out is None else out.unionByName(moved)
        start += width
    return out


# --- sinks -------------------------------------------------------------------


def _wide(factor: DataFrame, value: str) -> DataFrame:
    k = [r["k"] for r in factor.select("k").distinct().orderBy("k").collect()]
    return factor.groupBy("idx", "name").pivot("k", k).agg(F.first(value)).select("idx", "name", *[F.col(str(x)).alias(f"Pattern_{x + 1}") for x in k]).orderBy("idx")


def write_csv(result: Result, folder: str) -> None:
    """Both factors, their deviations and names, the statistic, the trace and the version, a folder each."""
    for label, axis in (("feature_loadings", "A"), ("sample_factors", "P")):
        side = result.factors.where(F.col("axis") == axis)
        _wide(side, "mean").write.mode("overwrite").csv(f"{folder}/{label}", header=True)
        _wide(side, "sd").write.mode("overwrite").csv(f"{folder}/{label}_sd", header=True)
        side.select("idx", "name").distinct().orderBy("idx").write.mode("overwrite").csv(f"{folder}/{label}_names", header=True)
    spark = result.factors.sparkSession
    result.trace.write.mode("overwrite").csv(f"{folder}/trace", header=True)
    spark.createDataFrame([(result.mean_chisq, result.version, result.params.to_json())], "mean_chisq double, version string, params string").write.mode("overwrite").json(f"{folder}/summary")


def read_csv(spark: SparkSession, folder: str) -> Result:
    """The inverse of :func:`write_csv`; parameters come back too."""
    parts = []
    for label, axis in (("feature_loadings", "A"), ("sample_factors", "P")):
        sides = []
        for suffix, value in (("", "mean"), ("_sd", "sd")):
            wide = spark.read.csv(f"{folder}/{label}{suffix}", header=True)
            patterns = [c for c in wide.columns if c.startswith("Pattern_")]
            wide = wide.select(F.col("idx").cast("long").alias("idx"), "name", *[F.col(c).cast("double").alias(c) for c in patterns])
            sides.append(wide.unpivot(["idx", "name"], patterns, "pattern", value))
        both = sides[0].join(sides[1].drop("name"), ["idx", "pattern"])
        parts.append(both.select(F.lit(axis).alias("axis"), "idx", "name", (F.substring("pattern", 9, 9).cast("int") - 1).alias("k"), "mean", "sd"))
    summary = spark.read.json(f"{folder}/summary").first()
    trace = spark.read.csv(f"{folder}/trace", header=True, schema="set_id int, stage int, phase string, iter int, chisq double, atoms_a int, atoms_p int")
    return Result(parts[0].unionByName(parts[1]), trace, Params.from_json(summary["params"]), summary["mean_chisq"])


def write_parquet(result: Result, folder: str) -> None:
    """Factors and trace as tables, parameters and statistic beside them."""
    result.factors.write.mode("overwrite").partitionBy("axis").parquet(f"{folder}/factors")
    result.trace.write.mode("overwrite").parquet(f"{folder}/trace")
    meta = json.dumps({"params": result.params.to_json(), "mean_chisq": result.mean_chisq})
    result.factors.sparkSession.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{folder}/metadata")


def read_parquet(spark: SparkSession, folder: str) -> Result:
    meta = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
    factors = spark.read.parquet(f"{folder}/factors").select("axis", "idx", "name", "k", "mean", "sd")
    return Result(factors, spark.read.parquet(f"{folder}/trace"), Params.from_json(meta["params"]), meta["mean_chisq"])


def write_matrix(cell: DataFrame, path: str) -> None:
    """A wide CSV with RowN and ColN labels: a line per row that occurs, a column up to the last that does."""
    last = cell.agg(F.max("j")).first()[0]
    columns = -1 if last is None else last
    held = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    rows = cell.groupBy("i", "j").agg(F.max("value").alias("value")).groupBy("i").agg(held.alias("held"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(columns).cast("long")) if columns >= 0 else F.array().cast("array<bigint>")
    values = F.transform(places, lambda j: F.coalesce(F.try_element_at("held", j), F.lit(0.0)).cast("string"))
    line = F.concat_ws(",", F.concat(F.lit("Row"), (F.col("i") + 1).cast("string")), values)
    header = ",".join(["row", *[f"Col{j + 1}" for j in range(columns + 1)]])
    # One column whose name and values are whole lines, neither quoted nor split.
    whole = rows.repartitionByRange("i").sortWithinPartitions("i").select(line.alias(header))
    whole.write.mode("overwrite").option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
