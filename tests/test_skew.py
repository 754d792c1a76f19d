"""A third of everything under one key, one place or one reference: same answers."""

from collections import Counter

import pytest
from test_queries import FOLDER, TABLES, plain

import __spark_entry__ as entry
from standcarbon.operators import skew

HEAVY = (
    "notice_results", "species_breakdown", "intersections", "overlay_overlap", "overlay_polygons",
    "stands_for_notices", "unmatched_notice_anti", "detail_pruning", "inventory_allocation",
    "detail_strata_allocation", "planned_from_species", "allocate_by_share", "dominant_species",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Part 4 gets a third of the line items; a third of the orders are copies of 40 ids."""
    duckdb = pytest.importorskip("duckdb")
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    changes = {
        "lineitem": "select * replace (case when l_orderkey % 3 = 0 then 4 else l_partkey end as l_partkey)",
        "orders": "select * replace (case when o_orderkey % 3 = 0 then o_orderkey % 40 "
        "else o_orderkey end as o_orderkey)",
    }
    for name in TABLES:
        select = changes.get(name, "select *")
        connection.execute(
            f"copy ({select} from '{FOLDER}/{name}.parquet') to '{folder}/{name}.parquet'"
        )
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", HEAVY)
def test_hot_keys_change_nothing(spark, skewed, monkeypatch, name):
    folder, connection = skewed
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 50)
    ours = entry.queries()[name](spark, folder)
    theirs = connection.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    order = [theirs.columns.index(c) for c in columns]
    left = Counter(tuple(plain(row[c]) for c in columns) for row in ours.collect())
    right = Counter(tuple(plain(row[i]) for i in order) for row in theirs.fetchall())
    assert left == right
