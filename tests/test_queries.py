"""Registered queries against their oracle SQL at the smallest scale; CHECK_ALL=1 runs every one."""

import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUICK = ["b1_standardise_strings", "b6_downsample", "c2_popularity", "c3_median_cut", "c4_wu", "c13_source_pixels", "d1_strips", "e3_both_audits", "f9_gradient_spaces", "g4_grade_lattice", "g6_apply_lattice", "h1_violations", "a6_catalogue_scan"]
NAMES = sorted(oracle_sql()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, db, name):
    df = queries()[name](spark, SF)
    cur = db.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
