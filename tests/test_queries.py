"""Every registered query against its SQL on the smallest tables; those without SQL have rows and a stable schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from cyclonet import catalog

SF = "/root/testdata/sf0.001"
NO_ROWS = {"topo_overlap_percolation"}  # so few particles overlap nowhere


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def table(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == order
    assert table([tuple(r) for r in df.collect()], df.columns, order) == table(cursor.fetchall(), columns, order)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.head(1)
    assert df.schema.names and (rows or name in NO_ROWS)
