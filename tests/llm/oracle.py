"""Runs a registered query and its DuckDB twin on one folder and compares all rows."""

import glob
import os

import duckdb

from tallyframe.llm.queries import ORACLES, QUERIES


def twin(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(r[i] for i in order) for r in got.fetchall())


def check(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    names, want = twin(sf_dir, ORACLES[name])
    assert sorted(df.columns) == names
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
