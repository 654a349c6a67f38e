"""Every query with SQL against DuckDB at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pytest

from factloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Line-ups of six need more suppliers a region than the smallest tables have.
SF_MORE = os.environ.get("TEST_SF_DIR_MORE", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def compare(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    compare(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.skipif(not Path(SF_MORE).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_is_stable(spark, name):
    q = registry.queries()[name]
    a, b = (sorted(map(repr, q(spark, SF_MORE).collect())) for _ in range(2))
    assert a and a == b
