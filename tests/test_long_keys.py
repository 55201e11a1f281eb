"""Keys of seven digits, of which paths keep six: several parts share a path."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = {"part": "p_partkey", "lineitem": "l_partkey"}


@pytest.mark.parametrize("name", ["facts_marked_tests", "merge_dispatch_edges", "merge_fragment_edges"])
def test_query_matches_sql_where_paths_are_shared(spark, tmp_path, name):
    db = duckdb.connect()
    for table, key in TABLES.items():
        db.execute(f"copy (select * replace ({key} + 1000000 as {key}) from '{SF}/{table}.parquet') to '{tmp_path}/{table}.parquet' (format parquet)")
        db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = db.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
