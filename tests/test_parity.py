"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from quern.plans import all_queries
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(all_queries.SQL))
def test_query(spark, duck, name):
    df = all_queries.QUERIES[name](spark, SF)
    rel = duck.sql(all_queries.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    kinds, own = dict(zip(rel.columns, map(str, rel.types), strict=True)), dict(df.dtypes)
    assert {c: TYPES[own[c]] for c in cols} == {c: kinds[c] for c in cols}
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({all_queries.SQL[name]})").fetchall()
    assert sorted(_plain(r) for r in df.select(*cols).collect()) == sorted(map(_plain, want))


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.SQL)))
def test_rows_only(spark, name):
    assert all_queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
