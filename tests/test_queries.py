"""Every registered query against its SQL twin on the smallest shared tables."""

import math
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry
from standcarbon.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="shared tables are absent")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    ours = entry.queries()[name](spark, FOLDER)
    theirs = sql.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    left = Counter(tuple(plain(row[c]) for c in columns) for row in ours.collect())
    right = Counter(tuple(plain(row[i]) for i in order) for row in theirs.fetchall())
    assert left == right


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "notice_id" and df.count() == 1500
