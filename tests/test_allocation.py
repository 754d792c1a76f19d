"""Allocation rules on single stands, each stated as (stratum, species, share, stock[, age])."""

import pytest

from standcarbon import schemas as S
from standcarbon.operators import allocate as A

STAND = (
    "stand_id string, stock_layer_1 double, stock_layer_2 double, stock_young double, "
    "stock_m3_ha double"
)
ELEMENT = (
    "stand_id string, pos long, record_id string, stratum_code string, species_code string, "
    "share_pct double, stock_m3_ha double, inventory_age double, current_age double"
)


def frames(spark, components, records, stock="sum"):
    known = [c for c in components if c is not None]
    total = (float(sum(known)) if known else None) if stock == "sum" else stock
    values = [None if c is None else float(c) for c in components]
    stands = spark.createDataFrame([("1", *values, total)], STAND)
    rows = [
        ("1", pos, str(pos), stratum, species, None if share is None else float(share),
         None if amount is None else float(amount), *map(float, ages), *[None] * (2 - len(ages)))
        for pos, (stratum, species, share, amount, *ages) in enumerate(records)
    ]
    return stands, spark.createDataFrame(rows, ELEMENT)


def allocate(spark, components, records, stock="sum"):
    """(standing basis, {record: m3/ha}, {record: harvest weight})"""
    stands, elements = frames(spark, components, records, stock)
    allocation = A.stand_allocation(stands, A.group_elements(elements))
    rates = A.species_rates(allocation)
    rows = A.stand_records(elements, allocation).orderBy("record_id").collect()
    stand = A.stand_rates(rates).first()
    standing = {r["record_id"]: r["standing_m3_per_ha"] for r in rows
                if r["standing_m3_per_ha"] is not None}
    weights = {r["record_id"]: r["harvest_weight"] for r in rows if r["harvest_weight"] is not None}
    # Rates summed before any record is looked at must tell the same story.
    assert (stand["standing_m3_per_ha"] is None) == (not standing)
    assert (stand["standing_m3_per_ha"] or 0) == pytest.approx(sum(standing.values()))
    assert stand["harvest_ok"] == bool(weights)
    if weights:
        assert sum(weights.values()) == pytest.approx(1.0)
    return stand["standing_basis"], standing, weights


NONE = (None, None, None)
SHARES = [(None, "KS", 70, None), (None, "KU", 15, None), (None, "HB", 10, None),
          (None, "LM", 5, None)]


def test_detail_stock_comes_first(spark):
    basis, standing, _ = allocate(spark, NONE, [(None, "KS", 100, 64)], stock=71.0)
    assert (basis, standing) == (S.DETAIL_STOCK, {"0": 64.0})


def test_stand_stock_is_spread_by_shares(spark):
    basis, standing, weights = allocate(spark, NONE, SHARES, stock=120.0)
    assert basis == S.ALLOCATED_STOCK
    assert list(standing.values()) == pytest.approx([84.0, 18.0, 12.0, 6.0])
    assert list(weights.values()) == pytest.approx([0.7, 0.15, 0.1, 0.05])


def test_no_stock_is_unknown_but_single_stratum_shares_carry_a_harvest(spark):
    basis, standing, weights = allocate(spark, NONE, SHARES)
    assert (basis, standing) == (S.UNKNOWN, {})
    assert list(weights.values()) == pytest.approx([0.7, 0.15, 0.1, 0.05])


def test_two_strata_without_stock_carry_nothing(spark):
    records = [("1", "KS", 100, None), ("2", "KU", 100, None)]
    assert allocate(spark, NONE, records) == (S.UNKNOWN, {}, {})


def test_harvest_uses_shares_within_each_stratum(spark):
    records = [("1", "LM", 60, 90), ("1", "SA", 25, 38), ("2", "MA", 100, 50), ("1", "TA", 15, 22)]
    basis, standing, weights = allocate(spark, (150, 50, 0), records)
    assert basis == S.DETAIL_STOCK
    assert standing == {"0": 90.0, "1": 38.0, "2": 50.0, "3": 22.0}
    assert [weights[str(i)] for i in range(4)] == pytest.approx([0.45, 0.1875, 0.25, 0.1125])


def test_rounded_zero_stock_keeps_its_share_and_shrubs_get_nothing(spark):
    records = [("A", "SP", 40, 3), ("Y", "LV", 100, 9), ("1", "LM", 92, 6), ("1", "TA", 8, 0),
               ("A", "TO", None, None)]
    basis, standing, weights = allocate(spark, (6, None, 9), records)
    assert basis == S.DETAIL_STOCK
    assert standing == {"1": 9.0, "2": 6.0, "3": 0.0}
    assert [weights[str(i)] for i in (1, 2, 3)] == pytest.approx([0.6, 0.4 * 0.92, 0.4 * 0.08])


def test_share_gap_falls_back_to_stocks_of_that_stratum(spark):
    records = [("1", "MA", None, 50), ("1", "KS", 100, 50), ("2", "KU", 10, 100)]
    _, _, weights = allocate(spark, NONE, records)
    assert weights == pytest.approx({"0": 0.25, "1": 0.25, "2": 0.5})


def test_incomplete_detail_falls_back_to_components(spark):
    records = [("1", "MA", 60, 60, 80), ("1", "KS", 40, None, 40), ("2", "KU", 100, None, 20)]
    basis, standing, _ = allocate(spark, (100, 50, None), records)
    assert basis == S.ALLOCATED_STOCK
    assert standing == pytest.approx({"0": 60.0, "1": 40.0, "2": 50.0})


@pytest.mark.parametrize(("detail", "complete"), [(98, True), (97, False), (102, True), (103, False)])
def test_two_percent_reconciles(spark, detail, complete):
    basis, _, _ = allocate(spark, (100, None, None), [("1", "MA", None, detail)])
    assert basis == (S.DETAIL_STOCK if complete else S.UNKNOWN)


def test_one_cubic_metre_always_reconciles(spark):
    basis, _, _ = allocate(spark, (5, None, None), [("1", "MA", None, 6)])
    assert basis == S.DETAIL_STOCK


def test_positive_component_without_records_is_unknown(spark):
    records = [("1", "MA", 100, 100)]
    assert allocate(spark, (100, 20, None), records) == (S.UNKNOWN, {}, {})
    assert allocate(spark, (100, 0, None), records)[0] == S.DETAIL_STOCK


def test_unmapped_stratum_is_living_but_not_checked(spark):
    records = [("1", "MA", 100, 100), ("7", "KS", 100, 30)]
    basis, standing, weights = allocate(spark, (100, None, None), records)
    assert (basis, standing) == (S.DETAIL_STOCK, {"0": 100.0, "1": 30.0})
    assert weights == {"0": 1.0}


@pytest.mark.parametrize("bad", [None, -1])
def test_one_bad_share_fails_the_group(spark, bad):
    records = [(None, "MA", 50, None), (None, "KS", bad, None)]
    assert allocate(spark, NONE, records, stock=50.0) == (S.UNKNOWN, {}, {})


def test_zero_shares_emit_no_row(spark):
    records = [(None, "MA", 0, None), (None, "KS", 10, None)]
    _, standing, weights = allocate(spark, NONE, records, stock=50.0)
    assert (standing, weights) == ({"1": 50.0}, {"1": 1.0})


def test_zero_stock_is_one_known_row_and_carries_no_harvest(spark):
    basis, standing, weights = allocate(spark, (0, 0, None), [("1", "MA", 100, None)])
    assert (basis, standing, weights) == (S.ALLOCATED_STOCK, {None: 0.0}, {})


def test_stand_without_elements(spark):
    assert allocate(spark, (0, None, None), []) == (S.ALLOCATED_STOCK, {None: 0.0}, {})
    assert allocate(spark, (10, None, None), []) == (S.UNKNOWN, {}, {})


def test_bare_species_list(spark):
    volumes = spark.createDataFrame([("1", 18.0)], "stand_id string, volume_m3 double")
    _, elements = frames(spark, NONE, SHARES)
    got = A.planned_records(elements, volumes).orderBy("record_id").collect()
    assert [r["volume_m3"] for r in got] == pytest.approx([12.6, 2.7, 1.8, 0.9])
    _, elements = frames(spark, NONE, [("1", "MA", 10, 30), ("2", "KS", 10, 60)])
    got = A.planned_records(elements, volumes).orderBy("record_id").collect()
    assert [r["volume_m3"] for r in got] == pytest.approx([6.0, 12.0])
    zero = volumes.selectExpr("stand_id", "0D as volume_m3")
    assert [r["volume_m3"] for r in A.planned_records(elements, zero).collect()] == [0.0]


def test_shares_alone_pass_over_missing_ones(spark):
    _, elements = frames(spark, NONE, [(None, "MA", None, 1), (None, "KS", 30, 1), (None, "KU", 10, 1)])
    volumes = spark.createDataFrame([("1", 8.0)], "stand_id string, total_volume_m3 double")
    got = {r["species_code"]: r["volume_m3"] for r in A.allocate_by_share(elements, volumes).collect()}
    assert got == pytest.approx({"KS": 6.0, "KU": 2.0})
    none = volumes.selectExpr("stand_id", "0D as total_volume_m3")
    assert A.allocate_by_share(elements, none).count() == 0


def test_one_unusable_volume_makes_the_total_unknown(spark):
    rows = [("a", "KU", 10.0), ("b", "KU", 10.0), ("b", "KU", float("nan")), ("c", "KU", -1.0)]
    df = spark.createDataFrame(rows, "k string, species_code string, v double")
    got = {r["k"]: r["tco2e"] for r in A.carbon_totals(df, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(10 * 0.4 * 1.3 * 0.5 * 44 / 12)
    assert (got["b"], got["c"]) == (None, None)


def test_proration_lists_every_record(spark):
    _, elements = frames(spark, NONE, [(None, "MA", 30, 1), (None, "MA", 10, 1), (None, "KU", None, 1)])
    parts = spark.createDataFrame(
        [("n", "1", 8.0), ("m", "1", 0.0), ("o", "1", None), ("p", "2", 5.0)],
        "notice_id string, stand_id string, planned_part_m3 double",
    )
    got = A.prorate_by_share(elements, parts).orderBy("record_id").collect()
    assert [(r["notice_id"], r["record_id"], r["volume_m3"]) for r in got] == [("n", "0", 6.0), ("n", "1", 2.0)]
