"""The queries that SQL can express, against DuckDB at sf0.001."""
import duckdb
import pytest

from convkit.llm import catalog
from llm_edge import SF001


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    res = c.execute(catalog.ORACLE[name])
    cols = [d[0] for d in res.description]
    got = catalog.QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, res.fetchall()))
