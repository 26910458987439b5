"""Every registered query of the transcript toolkit against its SQL, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from convlake.plans.registry import NAMES, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries()) - set(NAMES)))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in oracle_sql():
        return
    found = con.sql(oracle_sql()[name])
    names = found.columns
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_names_of_one_job():
    assert all(queries()[name] is queries()[job] and oracle_sql()[name] == oracle_sql()[job] for name, job in NAMES.items())
