"""Work that must not be done once for each row of a large join."""

import re

import pytest
from pyspark.sql import functions as F

from standcarbon import queries
from standcarbon.operators import allocate as A
from standcarbon.operators import skew
from standcarbon.plans import analysis as N


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_density_is_looked_up_per_record(spark):
    elements = spark.createDataFrame(
        [("1", "a", 0, "MA", 1.0)],
        "stand_id string, record_id string, pos long, species_code string, share_pct double",
    )
    parts = spark.createDataFrame([("n", "1", 2.0)], "notice_id string, stand_id string, planned_part_m3 double")
    rows = A.prorate_by_share(elements, parts)
    assert "array_position" not in plan(rows).splitlines()[0]
    assert rows.first()["volume_m3"] == 2.0


def test_increment_needs_no_allocation(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("allocation of stocks")

    monkeypatch.setattr(A, "stand_allocation", refuse)
    rows = queries.QUERIES["increment_rollup"](spark, "/root/testdata/sf0.001")
    assert rows.select(F.col("increment_m3_y") > 0).first()[0]


FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_species_of_an_overlap_travel_in_one_row(spark):
    rows = spark.createDataFrame(
        [("n", "1", 1.0), ("n", "2", 2.0), ("m", "2", 1.0), ("o", "3", 1.0)],
        "notice_id string, stand_id string, overlap_ha double",
    )
    entry = "struct<species: string, standing: double, planned: double>"
    stands = spark.createDataFrame(
        [("1", [("a", 5.0, None), ("b", 1.0, 0.5)]), ("2", [("b", 2.0, 0.5), ("c", 2.0, 0.5)]), ("3", [])],
        f"stand_id string, listed array<{entry}>",
    )
    largest = N.largest_species(N.Overlaps(rows), stands)
    plan_text = physical(largest)
    assert "hashpartitioning(notice_id" in plan_text and "species" not in "".join(
        line for line in plan_text.splitlines() if "Exchange" in line
    )
    # A notice whose stands list nothing has a row too; ties go to the first name.
    assert {tuple(r) for r in largest.collect()} == {("n", "a", "b"), ("m", "b", "b"), ("o", None, None)}


def test_top_notices_look_for_species_of_their_own_only(spark, monkeypatch):
    seen, largest = [], N.largest_species

    def watched(overlaps, stands):
        seen.append(overlaps.rows.select("notice_id").distinct().count())
        return largest(overlaps, stands)

    monkeypatch.setattr(N, "largest_species", watched)
    rows = queries.QUERIES["top20_notices"](spark, FOLDER)
    assert rows.filter("dominant_species is not null").count() == 20
    assert seen == [20]


def test_stored_results_have_the_columns_that_are_read(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(N, "staged", lambda df, inner=N.staged: (stored.append(df.columns), inner(df))[1])
    queries.QUERIES["quantile_thresholds"](spark, FOLDER)
    assert stored[-1] == ["standing_live_biomass_tco2"]


def test_own_labels_are_combined_by_hash(spark):
    rows = spark.createDataFrame(
        [("n", 1.0, 2.0, 3.0, b, h, True, True, 0.0, 0.0) for b, h in
         [("andmed puuduvad", "andmed puuduvad"), ("detail-liigiline tagavara", "raiemahu põhine hinnang")]],
        "notice_id string, overlap_ha double, standing_live_biomass_tco2 double, planned_harvest_biomass_tco2 "
        "double, standing_volume_basis string, planned_harvest_volume_basis string, standing_biomass_is_complete "
        "boolean, planned_harvest_biomass_is_complete boolean, weighted_age_num double, weighted_age_den double",
    )
    own, any_ = N.aggregate_intersections(rows, own_labels=True), N.aggregate_intersections(rows)
    assert own.collect() == any_.collect()
    assert "ObjectHashAggregate" not in physical(own)


def test_a_task_reads_a_bounded_part_of_a_file(spark):
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) <= 16 << 20


def test_polygon_results_do_not_stage_shapes(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(N, "staged", lambda df, inner=N.staged: (stored.append(df.columns), inner(df))[1])
    queries.QUERIES["notice_results_polygons"](spark, FOLDER)
    assert any("edges" in columns for columns in stored)
    assert not any("geometry" in columns for columns in stored)


@pytest.fixture
def unbroadcast(spark):
    """Joins as they are at large sizes: no side is small enough to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exchanges_above(text, leaf):
    """For each line of a plan with `leaf`, how many exchanges its rows pass."""
    counts, path = [], []
    for line in text.splitlines():
        name = re.search(r"[A-Za-z]", line)
        if not name:
            continue
        while path and path[-1][0] >= name.start():
            path.pop()
        path.append((name.start(), line[name.start() :]))
        if leaf in line:
            counts.append(sum(step.startswith("Exchange") for _, step in path))
    return counts


def test_breakdown_shuffles_records_once(spark, unbroadcast, monkeypatch):
    """Neither for their coefficients and site nor to count them are records shuffled again, and
    nothing that is kept on disk has their species."""
    kept = []
    for module in (N, skew):
        monkeypatch.setattr(module, "staged", lambda df, inner=module.staged: (kept.append((df.columns, plan(df))), inner(df))[1])
    rows = queries.QUERIES["species_breakdown"](spark, FOLDER)
    assert exchanges_above(physical(rows), "lineitem.parquet") == [1]
    assert not any("species_code" in columns for columns, _ in kept)
    counts = [text for columns, text in kept if "_left" in columns]
    assert counts and not any("l_quantity" in text for text in counts)


def test_records_matched_by_stand_are_those_matched_by_stratum(spark):
    elements = spark.createDataFrame(
        [("1", "a", None), ("1", "b", "1"), ("1", "c", "2"), ("2", "d", "1"), ("2", "e", "A"), ("3", "f", "1"), (None, "g", "1")],
        "stand_id string, record_id string, stratum_code string",
    )
    coefficients = spark.createDataFrame(
        [("1", "", 1.0), ("1", "1", 2.0), ("2", "1", 3.0), ("2", "1", 4.0), ("4", "1", 5.0), (None, "1", 6.0)],
        "stand_id string, stratum_key string, standing_per_stock double",
    )
    found = A.match_by_stand(elements, coefficients)
    expected = A.match_records(elements, coefficients).select(found.columns)
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)
    assert found.count() == 4


def test_records_of_a_crowded_stand_are_split(spark, unbroadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        elements = spark.range(0, 60_000, 1, 6).selectExpr(
            "string(if(id % 3 > 0, 1, id)) as stand_id", "string(id) as record_id", "'1' as stratum_code"
        )
        coefficients = spark.range(60_000).selectExpr("string(id) as stand_id", "'1' as stratum_key", "1.0D as n")
        matched = A.match_by_stand(elements, coefficients)
        assert len(matched.collect()) == 60_000
        assert "skew=true" in physical(matched)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_counted_elsewhere_are_dealt_alike(spark, monkeypatch):
    left = spark.range(200).selectExpr("1 as k", "id as a").union(spark.range(10).selectExpr("2 as k", "id as a"))
    right = spark.range(150).selectExpr("1 as k", "id as b").union(spark.range(10).selectExpr("2 as k", "id as b"))
    rows = spark.createDataFrame([(1, 120), (1, 80), (2, 10), (3, 5)], "k int, rows int"), right.selectExpr("k", "1 as rows")
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 100)
    crowded = skew.crowded_keys(left, right, ["k"])
    assert sorted(skew.crowded_keys(left, right, ["k"], rows=rows).collect()) == sorted(crowded.collect())
    dealt = skew.many_to_many(left, right, ["k"], ["a"], ["b"], rows)
    plain = left.join(right, "k").select("k", "a", "b")
    assert sorted(dealt.select("k", "a", "b").collect()) == sorted(plain.collect())
