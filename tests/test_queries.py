"""Every query that has SQL gives the SQL's rows (DuckDB on the same files)."""

import glob
import os

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: None if v is None or v != v else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted((tuple(tidy(r[k]) for k in order) for r in data), key=repr), [names[k] for k in order]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    got = frame.collect()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert rows(frame.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert len(got)
