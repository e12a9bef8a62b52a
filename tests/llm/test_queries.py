"""Queries of the subpackage: those with SQL against DuckDB, the rest against their definitions, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cisweave.llm import registry
from tools.oracle import normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES = {n: f for m in registry.MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in registry.MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_columns_of_found_queries(spark):
    assert QUERIES["p7_found"](spark, FOLDER).columns == ["doc_id", "item_id"]
    assert QUERIES["p1_found"](spark, FOLDER).columns == ["plan_id", "chrom", "bin_no"]


def test_sample_follows_allocation(spark):
    drawn = {tuple(r)[:3]: r["count"] for r in QUERIES["p1_sample"](spark, FOLDER).groupBy("plan_id", "chrom", "bin_no").count().collect()}
    assert drawn == {(r.plan_id, r.chrom, r.bin_no): r.drawn for r in QUERIES["p1_allocation"](spark, FOLDER).collect() if r.drawn}


def test_containers_are_nearly_full(spark):
    for r in QUERIES["p6_fill"](spark, FOLDER).collect():
        assert r.n_containers <= r.least * 1.03 + 1
