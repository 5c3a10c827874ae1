"""Every engine query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from arandu.plans import queries, table_queries  # noqa: F401
from arandu.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    other = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(other.fetchall(), other.columns)
