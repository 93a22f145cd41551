"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftgraph.plans import analysing, assuring, comparing, compiling, edits, impact, inferring, merging, planning, projecting, reading, regressing, relations, review, searching, snapshots, validating, walking  # noqa: F401  register their queries
from weftgraph.plans.queries import REGISTRY

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", REGISTRY)
def test_query_matches_sql(spark, views, name):
    build, sql = REGISTRY[name]
    got = build(spark, DATA)
    expected = views.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = sorted(map(repr, got.select(*columns).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    other = sorted(map(repr, expected.df()[columns].astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    assert rows == other
