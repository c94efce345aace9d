import duckdb
import pytest

from factorloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(map(str, con.sql("SELECT " + ", ".join(f'"{c}"' for c in names) + " FROM want").fetchall()))


def test_workers_get_the_package_from_the_driver(tmp_path):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from test_runtime import run_apart

    run_apart(
        f"""
from factorloom.llm import queries
for name in ("op3_pii", "op7_gif", "op10_token_counts"):
    assert queries.QUERIES[name](spark, {SF!r}).count() > 100
""",
        str(tmp_path),
    )
