"""Training-data queries that have SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from countloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(name, spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}{'/*' if f.is_dir() else ''}'")
    df = queries.queries()[name](spark, SF)
    answer = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    order = [df.columns.index(c) for c in columns]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(answer.fetchall())
