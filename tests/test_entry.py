import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tremor.plans.workload import QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
