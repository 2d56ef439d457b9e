"""Queries that SQL can express, against it, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from scrivel.llm import queries


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == names
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[at[c]] for c in names]) for r in cur.fetchall())
