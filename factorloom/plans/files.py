"""Queries of sources and sinks: matrices written to the shared folder in each format, and read back."""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Params, Result
from ..operators import factorize, matrix
from ..runtime import shared_checkpoint_dir
from ..sources import matrix_files, matrix_source, result_source, stores
from . import inputs
from .base import query, rounded


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _write_lines(lines: DataFrame, path: str) -> str:
    """Lines (n, value) as a folder of text files whose names are in the order of n."""
    lines.repartitionByRange(3, "n").sortWithinPartitions("n").select("value").write.text(path)
    return path


def _rows(cell: DataFrame, separator: str, lead: Column | None = None) -> DataFrame:
    """One line (n, value) per row of a full matrix; ``lead`` is an aggregate that comes first."""
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"].cast("string")), separator)
    line = values if lead is None else F.concat(lead, F.lit(separator), values)
    return cell.groupBy("i").agg(line.alias("value")).select(F.col("i").alias("n"), "value")


def _header(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(k - len(lines), x) for k, x in enumerate(lines)], "n long, value string")


_COLUMNS = [f"L{j + 1}" for j in range(7)]
_M = "SELECT i, j, round(value, 4) AS value FROM m"


def _brand() -> Column:
    return F.concat(F.lit("Brand#"), (F.col("i") + 1).cast("string"))


def _cells(cells: DataFrame) -> DataFrame:
    return cells.select("i", "j", rounded("value", 4))


def _csv(spark: SparkSession, sf: str) -> str:
    rows = _rows(inputs.m(spark, sf), ",", F.concat(F.lit('"'), F.first(_brand()), F.lit('"')))
    return _write_lines(_header(spark, ",".join(['""', *_COLUMNS])).unionByName(rows), _place(spark, "m.csv"))


@query(", names AS (SELECT DISTINCT 'A' AS axis, i AS idx, 'Brand#' || CAST(i + 1 AS VARCHAR) AS name FROM m UNION SELECT DISTINCT 'P', j, 'L' || CAST(j + 1 AS VARCHAR) FROM m) SELECT m.i, m.j, round(value, 4) AS value, x.name AS row_name, y.name AS col_name FROM m JOIN names x ON x.axis = 'A' AND x.idx = m.i JOIN names y ON y.axis = 'P' AND y.idx = m.j")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    cells, dims, _ = matrix_files.read_matrix(spark, _csv(spark, sf))
    rows = dims.where("axis = 'A'").select(F.col("idx").alias("i"), F.col("name").alias("row_name"))
    cols = dims.where("axis = 'P'").select(F.col("idx").alias("j"), F.col("name").alias("col_name"))
    return cells.join(rows, "i").join(cols, "j").select("i", "j", rounded("value", 4), "row_name", "col_name")


@query(_M)
def scan_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(_header(spark, "\t".join(_COLUMNS)).unionByName(_rows(inputs.m(spark, sf), "\t")), _place(spark, "m.tsv"))
    return _cells(matrix_files.read_matrix(spark, path)[0])


@query(_M)
def scan_gct(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(inputs.m(spark, sf), "\t", F.concat(F.first(_brand()), F.lit("\tabout")))
    head = _header(spark, "#1.2", "25\t7", "\t".join(["NAME", "Description", *_COLUMNS]))
    return _cells(matrix_files.read_matrix(spark, _write_lines(head.unionByName(rows), _place(spark, "m.gct")))[0])


def _coordinates(spark: SparkSession, cell: DataFrame, path: str, rows: int, cols: int) -> str:
    text = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("value").cast("string"))
    lines = cell.select((F.col("i") * cols + F.col("j")).alias("n"), text.alias("value"))
    head = _header(spark, "%%MatrixMarket matrix coordinate real general", "% a remark", f"{rows} {cols} 0")
    return _write_lines(head.unionByName(lines), path)


@query(_M)
def scan_mtx(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(matrix_files.read_matrix(spark, _coordinates(spark, inputs.m(spark, sf), _place(spark, "m.mtx"), 25, 7))[0])


@query("SELECT i, j, round(value, 4) AS value, 'Brand#' || CAST(i + 1 AS VARCHAR) AS feature, 'cell-' || CAST(j + 1 AS VARCHAR) AS barcode FROM m")
def scan_10x(spark: SparkSession, sf: str) -> DataFrame:
    folder = _place(spark, "counts")
    _coordinates(spark, inputs.m(spark, sf), f"{folder}/matrix.mtx", 25, 7)
    _write_lines(spark.range(25).select(F.col("id").alias("n"), F.format_string("E%04d\tBrand#%d\tGene Expression", "id", F.col("id") + 1).alias("value")), f"{folder}/features.tsv")
    _write_lines(spark.range(7).select(F.col("id").alias("n"), F.format_string("cell-%d", F.col("id") + 1).alias("value")), f"{folder}/barcodes.tsv")
    cells, dims, _ = matrix_files.read_10x(spark, folder)
    named = lambda axis, key, name: dims.where(F.col("axis") == axis).select(F.col("idx").alias(key), F.col("name").alias(name))
    return cells.join(named("A", "i", "feature"), "i").join(named("P", "j", "barcode"), "j").select("i", "j", rounded("value", 4), "feature", "barcode")


@query("SELECT DISTINCT 'A' AS axis, i AS idx, 'Brand#' || CAST(i + 1 AS VARCHAR) AS name, count(DISTINCT i) OVER () AS n_rows, 7 AS n_cols FROM (SELECT DISTINCT i FROM m) UNION ALL SELECT 'P', j, 'L' || CAST(j + 1 AS VARCHAR), (SELECT count(DISTINCT i) FROM m), 7 FROM (SELECT DISTINCT j FROM m)")
def file_information(spark: SparkSession, sf: str) -> DataFrame:
    info = matrix_files.file_info(spark, _csv(spark, sf))
    n_rows, n_cols = info["dimensions"]
    rows = [("A", k, x, n_rows, n_cols) for k, x in enumerate(info["row_names"])] + [("P", k, x, n_rows, n_cols) for k, x in enumerate(info["col_names"])]
    return spark.createDataFrame(rows, "axis string, idx long, name string, n_rows long, n_cols int")


@query("SELECT i, j, round(value, 4) AS value FROM m WHERE i IN (3, 19, 20) AND j IN (1, 6)")
def part_of_file(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted rows and columns of a file, which is all that its scan parses."""
    return _cells(matrix_files.read_matrix(spark, _csv(spark, sf), rows=(20, 3, 19), columns=(1, 6))[0])


@query("SELECT i, j, round(value, 4) AS value, CAST(i AS VARCHAR) || ':' || CAST(j AS VARCHAR) AS place FROM m")
def ranges_of_file(spark: SparkSession, sf: str) -> DataFrame:
    """A file in ranges of 100 bytes: rows are numbered from the lines of the ranges before."""
    path = stores.qualified(spark, _csv(spark, sf))
    return _cells(matrix_source.load(spark, path, "csv", 100)[0]).withColumn("place", F.concat_ws(":", "i", "j"))


@query("SELECT kind, i, j, round(value, 4) AS value FROM m CROSS JOIN (VALUES ('csv'), ('tsv'), ('mtx')) k(kind)")
def published_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix written as one publication in each format, and read back."""
    out = None
    for kind in ("csv", "tsv", "mtx"):
        path = _place(spark, f"published.{kind}")
        matrix_source.save(inputs.m(spark, sf), path)
        back = _cells(matrix_files.read_matrix(spark, path)[0]).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 100, 4) AS whole, round(-l_quantity, 4) AS negative, round(l_discount, 6) AS plain FROM lineitem")
def parsed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    item = spark.read.parquet(f"{sf}/lineitem.parquet")
    number = lambda text, name: F.round(matrix_files.parse_number(text), 6 if name == "plain" else 4).alias(name)
    quantity = F.col("l_quantity").cast("string")
    return item.select("l_orderkey", "l_linenumber", number(F.concat(quantity, F.lit("e2")), "whole"), number(F.concat(F.lit("-"), quantity, F.lit("E+0")), "negative"), number(F.col("l_discount").cast("string"), "plain"))


@query(
    """, s AS (SELECT row_number() OVER (ORDER BY s_name) - 1 AS i, s_name, s_acctbal, s_nationkey FROM supplier)
SELECT i, CAST(0 AS BIGINT) AS j, s_acctbal AS value, s_name AS name FROM s UNION ALL SELECT i, 1, CAST(s_nationkey AS DOUBLE), s_name FROM s"""
)
def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf}/supplier.parquet").select("s_name", "s_acctbal", "s_nationkey")
    cells, dims = matrix_files.from_wide(wide, "s_name")
    return cells.join(dims.where("axis = 'A'").select(F.col("idx").alias("i"), "name"), "i").select("i", "j", "value", "name")


@query("SELECT l_partkey AS i, l_suppkey AS j, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY l_partkey, l_suppkey")
def triplets(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(matrix_files.from_triplets(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_partkey", "l_suppkey", "l_quantity"))


@query("SELECT i, j, round(value, 4) AS value FROM m UNION ALL SELECT i, j + 7, round(2 * value, 4) FROM m")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.m(spark, sf)
    return _cells(matrix_files.bind_parts([m, m.withColumn("value", 2 * F.col("value"))], [7, 7]))


@query("SELECT i, j, round(value, 4) AS value, 0 AS part FROM m UNION ALL SELECT i, j, round(2 * value, 4), 1 FROM m")
def numbered_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.m(spark, sf)
    return matrix.bind_columns([m, m.withColumn("value", 2 * F.col("value"))]).select("i", "j", rounded("value", 4), "part")


@query("SELECT i, j, round(value, 4) AS value FROM m UNION ALL SELECT i + 25, j, round(value, 4) FROM m")
def one_below_the_other(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.m(spark, sf)
    return _cells(matrix.bind_rows(m, m.withColumn("i", F.col("i") + 25)))


@query("SELECT 'Row' || CAST(i + 1 AS VARCHAR) AS row, 'Col' || CAST(j + 1 AS VARCHAR) AS col, round(value, 4) AS value FROM m")
def written_matrix(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "matrix")
    matrix_files.write_matrix(inputs.m(spark, sf), path)
    back = spark.read.csv(path, header=True)
    return back.unpivot(["row"], [c for c in back.columns if c != "row"], "col", "value").select("row", "col", F.round(F.col("value").cast("double"), 4).alias("value"))


_RESULT = """SELECT 'A' AS axis, i AS idx, name, k, round(mean, 6) AS mean, round(sd, 6) AS sd FROM a
UNION ALL SELECT 'P', j, 'S' || CAST(j AS VARCHAR), k, round(mean, 6), round(sd, 6) FROM p"""


def _result(spark: SparkSession, sf: str) -> Result:
    a, p = inputs.a(spark, sf), inputs.p(spark, sf)
    sides = [x.select(F.lit(axis).alias("axis"), "idx", "name", "k", "mean", "sd") for axis, x in (("A", a), ("P", p))]
    trace = spark.createDataFrame([(0, 1, "sampling", 10, 2.5, 7, 8)], "set_id int, stage int, phase string, iter int, chisq double, atoms_a int, atoms_p int")
    return Result(sides[0].unionByName(sides[1]), trace, Params(3, seed=42, gene_names=("x", "y")), 12.5)


def _factors(result: Result) -> DataFrame:
    return result.factors.select("axis", "idx", "name", "k", rounded("mean"), rounded("sd"))


@query(_RESULT)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "result")
    matrix_files.write_csv(_result(spark, sf), path)
    return _factors(matrix_files.read_csv(spark, path))


@query(_RESULT)
def parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "result")
    matrix_files.write_parquet(_result(spark, sf), path)
    return _factors(matrix_files.read_parquet(spark, path))


@query(_RESULT)
def published_result(spark: SparkSession, sf: str) -> DataFrame:
    """Factors, names, trace and summary that appeared together."""
    path = _place(spark, "bundle")
    result_source.publish(_result(spark, sf), path)
    return _factors(result_source.published(spark, path))


@query("SELECT 3 AS n_patterns, 50000 AS n_iterations, 42 AS seed, 'x,y' AS gene_names, CAST(12.5 AS DOUBLE) AS mean_chisq, 3 AS cut, 2 AS min_ns, 6 AS max_ns, CAST(10 AS INTEGER) AS iter, CAST(2.5 AS DOUBLE) AS chisq")
def result_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters with their defaults, the statistic and the trace, after both round trips."""
    path = _place(spark, "result")
    matrix_files.write_parquet(_result(spark, sf), f"{path}/p")
    matrix_files.write_csv(matrix_files.read_parquet(spark, f"{path}/p"), f"{path}/c")
    back = matrix_files.read_csv(spark, f"{path}/c")
    row, p = back.trace.first(), back.params
    return spark.createDataFrame(
        [(p.n_patterns, p.n_iterations, p.seed, ",".join(p.gene_names), back.mean_chisq, p.cut, p.min_ns, p.max_ns, row["iter"], row["chisq"])],
        "n_patterns int, n_iterations int, seed int, gene_names string, mean_chisq double, cut int, min_ns int, max_ns int, iter int, chisq double",
    )


@query(
    """, picked AS (SELECT * FROM (VALUES (0, 6), (1, 2), (2, 6)) x(pos, idx))
SELECT CAST(x.pos AS BIGINT) AS i, m.i AS j, round(m.value, 4) AS value, 'L' || CAST(x.idx + 1 AS VARCHAR) AS row_name, 'Brand#' || CAST(m.i + 1 AS VARCHAR) AS col_name
FROM picked x JOIN m ON m.j = x.idx"""
)
def prepared_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The transpose, then columns 7, 3 and 7 of the file as rows, names with them."""
    cells, dims, shape = matrix_files.read_matrix(spark, _csv(spark, sf), columns=(2, 6))  # no other is parsed
    cells, named, _, _ = factorize.prepared(cells, Params(1, subset_indices=(7, 3, 7), subset_dim=1), dims, shape, transpose=True)
    name = lambda axis, key, label: named.where(F.col("axis") == axis).select(F.col("idx").alias(key), F.col("name").alias(label))
    return cells.join(name("A", "i", "row_name"), "i").join(name("P", "j", "col_name"), "j").select("i", "j", rounded("value", 4), "row_name", "col_name")


@query("SELECT i, j, round(value - 600, 4) AS value FROM m WHERE value - 600 > 0")
def positive_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(matrix.positive(inputs.m(spark, sf).withColumn("value", F.col("value") - 600)))


@query(
    """SELECT 'A' AS axis, i AS idx, 'Brand#' || CAST(i + 1 AS VARCHAR) AS name, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT i FROM m) CROSS JOIN generate_series(0, 1) g(k)
UNION ALL SELECT 'P', j, 'L' || CAST(j + 1 AS VARCHAR), CAST(k AS INTEGER) FROM (SELECT DISTINCT j FROM m) CROSS JOIN generate_series(0, 1) g(k)"""
)
def command_line(spark: SparkSession, sf: str) -> DataFrame:
    """The factors that `python -m factorloom` writes for a csv, with the file's names."""
    from ..__main__ import main

    place = f"{shared_checkpoint_dir(spark)}/command-{uuid.uuid4().hex}"
    with contextlib.redirect_stdout(io.StringIO()):
        main([_csv(spark, sf), place, "--patterns", "2", "--iterations", "20", "--normalize"])
    return matrix_files.read_parquet(spark, place).factors.where("mean >= 0").select("axis", "idx", "name", "k")
