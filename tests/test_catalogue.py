"""Every query runs; every SQL agrees with its query on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from conftest import SMALL
from hanmaru.plans import catalogue


@pytest.fixture(scope="session")
def tables():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    try:
        return None if math.isnan(float(v)) else round(float(v), 6)
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalogue.ORACLES:
        cursor = tables.execute(catalogue.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
