"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from answerloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 50


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
