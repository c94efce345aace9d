import gzip
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from factorloom.sources import matrix_files, matrix_source, stores

ROWS, COLS = 57, 9


def data(seed=0):
    rng = np.random.default_rng(seed)
    return np.round(rng.gamma(1, size=(ROWS, COLS)) * (rng.random((ROWS, COLS)) < 0.7), 3)


def text(x, kind, named=True):
    sep = "," if kind == "csv" else "\t"
    if kind == "mtx":
        return "%%MatrixMarket matrix coordinate real general\n% remark\n" + f"{ROWS} {COLS} 0\n" + "".join(f"{i + 1} {j + 1} {x[i, j]}\n" for i, j in np.argwhere(x))
    head = [f"s{j}" for j in range(COLS)]
    rows = [sep.join(([f'"g{i}"'] + (["about"] if kind == "gct" else []) if named else []) + [str(v) for v in x[i]]) for i in range(ROWS)]
    if kind == "gct":
        return "\n".join([f"#1.2\n{ROWS}\t{COLS}", sep.join(["NAME", "Description", *head]), *rows]) + "\n"
    return "\r\n".join([sep.join(([""] if named else []) + head), *rows[:20], "", *rows[20:]])


def dense(cells):
    out = np.zeros((ROWS, COLS))
    for r in cells.collect():
        out[r.i, r.j] = r.value
    return out


@pytest.mark.parametrize("range_bytes", [40, 1 << 20])
@pytest.mark.parametrize("kind", ["csv", "tsv", "gct", "mtx"])
def test_ranges_of_bytes_give_every_row_once(spark, tmp_path, kind, range_bytes):
    x = data()
    (tmp_path / f"m.{kind}").write_bytes(text(x, kind).encode())
    cells, dims, shape = matrix_source.load(spark, str(tmp_path / f"m.{kind}"), kind, range_bytes)
    assert cells.count() == (ROWS * COLS if kind != "mtx" else np.count_nonzero(x)) and (dense(cells) == x).all()
    if kind == "mtx":
        assert shape == (ROWS, COLS) and dims is None
    else:
        names = {(r.axis, r.idx): r["name"] for r in dims.collect()}
        assert names == {**{("A", i): f"g{i}" for i in range(ROWS)}, **{("P", j): f"s{j}" for j in range(COLS)}}


def test_folders_without_names_and_compressed_parts(spark, tmp_path):
    x = data(1)
    raw = text(x, "csv", named=False).encode()
    folder = tmp_path / "m.csv"
    folder.mkdir()
    lines = raw.split(b"\r\n")
    (folder / "a.csv").write_bytes(b"\r\n".join(lines[:9]) + b"\r\n")
    (folder / "b.csv.gz").write_bytes(gzip.compress(b"\r\n".join(lines[9:30]) + b"\r\n"))
    (folder / "c.csv").write_bytes(b"\r\n".join(lines[30:]))
    (folder / "_ignored").write_text("x")
    cells, dims, _ = matrix_source.load(spark, str(folder), "csv", 50)
    assert (dense(cells) == x).all() and dims.count() == COLS
    again, _, _ = matrix_files.read_matrix(spark, str(folder))
    assert (dense(again) == x).all()


def test_wanted_rows_and_columns_reach_the_scan(spark, tmp_path):
    x = data(2)
    rows, columns = [50, 3, 51, 3], [4, 2]
    for kind in ("csv", "gct", "mtx"):
        path = str(tmp_path / f"m.{kind}")
        (tmp_path / f"m.{kind}").write_bytes(text(x, kind).encode())
        part, dims, shape = matrix_source.load(spark, path, kind, 200, rows, columns)
        want = {(i, j): x[i, j] for i in set(rows) for j in columns if kind != "mtx" or x[i, j]}
        assert shape == (ROWS, COLS) and {(r.i, r.j): r.value for r in part.collect()} == want
        assert (kind == "mtx") == (dims is None) and (dims is None or dims.count() == ROWS + COLS)
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        whole = matrix_source.load(spark, path, kind, 200)[0]
        assert kind == "mtx" or part.rdd.getNumPartitions() <= 3 < whole.rdd.getNumPartitions()
        # a loaded table is the same whatever was asked of it before
        assert whole.where("i = 3").count() == (COLS if kind != "mtx" else np.count_nonzero(x[3])) and whole.where("j = 1 and i in (1, 2)").count() <= 2
        assert (dense(whole) == x).all()
        assert matrix_source.load(spark, path, kind, 200, rows=[])[0].count() == 0


def test_words_are_no_numbers(spark, tmp_path):
    for bad in ("nan", "NA", "1_0", "inf", "", "--1", "1e", "0x1"):
        (tmp_path / "m.csv").write_text(f"a,b\n1,{bad}\n")
        cells, _, _ = matrix_source.load(spark, str(tmp_path / "m.csv"), "csv")
        with pytest.raises(PySparkException, match="not a number"):
            cells.collect()
    (tmp_path / "m.csv").write_text("a,b\n1., +.5e-1\n")
    assert [r.value for r in matrix_source.load(spark, str(tmp_path / "m.csv"), "csv")[0].collect()] == [1.0, 0.05]
    (tmp_path / "none.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="empty"):
        matrix_source.load(spark, str(tmp_path / "none.csv"), "csv")


@pytest.mark.parametrize("kind", ["csv", "tsv", "mtx"])
def test_written_matrices_come_back(spark, tmp_path, kind):
    x = data(3)
    x[5], x[:, 4] = 0, 0
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.argwhere(x)], "i long, j long, value double").repartition(7)
    path = str(tmp_path / f"out.{kind}")
    matrix_source.save(cells, path)
    back, dims, shape = matrix_source.load(spark, path, kind, 500)
    if kind == "mtx":
        assert shape == (ROWS, COLS) and (dense(back) == x).all()
    else:
        occurring = [i for i in range(ROWS) if x[i].any()]
        assert [r["name"] for r in dims.where("axis = 'A'").orderBy("idx").collect()] == [f"Row{i + 1}" for i in occurring]
        assert (dense(back)[: len(occurring)] == x[occurring]).all()
    matrix_source.save(cells.where("i < 3"), path)
    assert len(os.listdir(path)) == 2 and matrix_source.load(spark, path, kind)[0].agg({"i": "max"}).first()[0] == 2


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([(i, j, 1.0 + i) for i in range(20) for j in range(3)], "i long, j long, value double")
    path = str(tmp_path / "out.csv")
    bad = good.selectExpr("i", "j", "if(i = 19 and j = 2, raise_error('lost'), value) AS value")
    ordered = lambda df: df.repartitionByRange(4, "i").sortWithinPartitions("i", "j").write.format("matrix").option("columns", 3).mode("overwrite")
    matrix_source.register(spark)
    with pytest.raises(PySparkException):
        ordered(bad).save(path)
    assert not stores.reachable(path) or stores.manifest(path) is None and not [f for f in os.listdir(path) if f.startswith("data")]
    matrix_source.save(good, path)
    before = stores.manifest(path)
    with pytest.raises(PySparkException):
        ordered(bad).save(path)
    assert stores.manifest(path) == before and matrix_source.load(spark, path, "csv")[0].count() == 60
