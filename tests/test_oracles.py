"""Every query that has a DuckDB form gives the same rows as it, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from evidentia.plans import commerce_queries, integrity_queries, stream_queries, view_queries  # noqa: F401  register their queries
from evidentia.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(Q.ORACLES[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs_without_oracle(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
