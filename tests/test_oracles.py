"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from countloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def rows(columns: list[str], found) -> list[str]:
    """Rows as text with columns by name; no pandas in between, which would turn whole numbers beside nulls into floats."""
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return sorted(repr([None if isinstance(r[c], float) and r[c] != r[c] else r[c] for c in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    answer = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, answer.fetchall())
