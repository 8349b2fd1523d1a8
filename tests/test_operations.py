"""Queries of streams, versions and inspections against their SQL."""

import glob
import os

import duckdb
import pytest

from assayer.plans import curation, operations  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
NAMES = ("log_stream", "follower_events", "created_sheets", "inspected_files", "indexed_search")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = curation.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(curation.SQL[name]).select(*columns).fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
