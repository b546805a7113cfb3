"""Every query with SQL for its result, against DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from sluice.plans.registry import ORACLE, QUERIES

AT = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_result(spark, duck, name):
    df = QUERIES[name](spark, AT)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLE[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())


#: Queries whose point is that no row comes back.
EMPTY = {"null_eq", "null_ne", "not_in_null", "agg_limit_zero", "limit_zero", "sub_not_in_null", "sub_scalar_empty", "dml_delete_all", "having_without_group_none"}


def test_other_queries_return_rows():
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in ORACLE.items():
        assert (duck.execute(f"SELECT count(*) FROM ({sql}) t").fetchone()[0] == 0) == (name in EMPTY), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
