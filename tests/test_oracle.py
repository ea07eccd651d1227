"""Every registered query against its DuckDB oracle at sf0.001 (the
driver's gate runs the same comparison at sf0.01)."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from convkit.plans.catalog import QUERIES
from convkit.plans.oracle import ORACLE
from convkit.sources.tables import TABLES

from conftest import SF001


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "sid", "pid", "cid", "context", "response"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(sdf.columns, rows) == digest(ocols, orows)
