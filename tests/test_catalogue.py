"""Every query with SQL gives the same rows in Spark and in the comparison engine."""

import glob
import os

import duckdb
import pytest

from clausewright import catalogue

DATA = "/root/testdata/sf0.001"
SLOW = {"validation_cascade", "normalization_failures"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
