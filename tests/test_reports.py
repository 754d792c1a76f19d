import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from standcarbon import schemas as S
from standcarbon.operators.ordering import exact_quantiles, row_numbers
from standcarbon.plans import reports as R


def results(spark, *rows):
    base = {
        "notice_id": "1", "area_ha": 1.75, "standing_live_biomass_tco2": 210.0,
        "planned_harvest_biomass_tco2": 64.0, "standing_volume_basis": S.ALLOCATED_STOCK,
        "planned_harvest_volume_basis": S.HARVEST_VOLUME, "inventory_date": "2019-05-14",
        "inventory_age_years": 7.25, "inventory_recency": "hea", "mean_age": 61.0,
        "current_increment_on_overlap_m3_y": 9.5, "current_increment_covered_area_ha": 1.75,
        "current_increment_is_complete": True, "raie_liik": "LR", "planned_volume_m3": 80.0,
        "carbon_co2e_t": 777.0,
    }
    kinds = {str: "string", float: "double", bool: "boolean"}
    schema = ", ".join(f"{name} {kinds[type(value)]}" for name, value in base.items())
    return spark.createDataFrame([tuple((base | row).values()) for row in rows], schema)


def test_kpis_skip_unknown_and_never_invent_zero(spark):
    unknown = {"standing_live_biomass_tco2": None, "planned_harvest_volume_basis": S.UNKNOWN}
    row = R.kpi_rollup(results(spark, {}, unknown)).first()
    assert (row["n_notices"], row["total_area_ha"], row["standing_tco2"]) == (2, 3.5, 210.0)
    assert (row["planned_tco2"], row["n_harvest_estimates"]) == (128.0, 1)
    assert R.kpi_rollup(results(spark, unknown)).first()["standing_tco2"] is None


def test_label_sets(spark):
    row = R.label_sets(results(spark, {}, {"inventory_recency": "nõrk", "inventory_date": None})).first()
    assert row["recency_labels"] == "hea, nõrk"
    assert row["inventory_dates"] == "2019-05-14"
    assert row["standing_sources"] == S.ALLOCATED_STOCK


def test_increment_rate_is_area_weighted(spark):
    rows = [
        {"current_increment_on_overlap_m3_y": 6.0, "current_increment_covered_area_ha": 2.0},
        {"current_increment_on_overlap_m3_y": 30.0, "current_increment_covered_area_ha": 6.0},
        {"current_increment_is_complete": False},
        {"current_increment_on_overlap_m3_y": float("nan")},
        {"current_increment_covered_area_ha": 0.0},
    ]
    assert tuple(R.increment_rollup(results(spark, *rows)).first()) == (36.0, 8.0, 4.5)
    assert tuple(R.increment_rollup(results(spark, rows[2])).first()) == (None, None, None)


def test_export_has_the_stable_columns_only(spark):
    columns = R.export_table(results(spark, {})).columns
    assert columns[:3] == ["notice_id", "raiutav_maht", "raie_liik"]
    assert "mean_inventory_age_years" in columns and "mean_age" not in columns
    assert "carbon_co2e_t" not in columns


def test_counts_and_top(spark):
    rows = [{"notice_id": str(i), "standing_live_biomass_tco2": float(i) if i % 3 else None,
             "inventory_recency": ["hea", "nõrk", None][i % 3]} for i in range(30)]
    df = results(spark, *rows)
    assert [tuple(r) for r in R.value_counts(df, "inventory_recency").collect()] == [("hea", 10), ("nõrk", 10)]
    top = R.top_notices(df).collect()
    assert len(top) == 20 and top[0]["notice_id"] == "29"
    assert R.top_notices(df, 30).collect()[-1]["standing_live_biomass_tco2"] is None


def test_species_pivot_keeps_scopes_apart(spark):
    rows = [("Kask", "standing", 2.0, 3.0), ("Kask", "standing", 1.0, 1.0), ("Kuusk", "planned_harvest", 5.0, 7.0)]
    df = spark.createDataFrame(rows, "species string, estimate_scope string, volume_m3 double, biomass_tco2 double")
    assert [tuple(r) for r in R.species_rollup(df).collect()] == [
        ("Kuusk", "planned_harvest", 5.0, 7.0), ("Kask", "standing", 3.0, 4.0)]
    assert {tuple(r) for r in R.species_pivot(df).collect()} == {("Kask", 4.0, None), ("Kuusk", None, 7.0)}


@pytest.mark.parametrize("count", [1, 2, 3, 100, 1298, 1299, 1300, 49_999, 120_001])
def test_quantiles_are_exact(spark, count):
    rng = np.random.default_rng(count)
    values = np.where(rng.random(count) < 0.4, 7.0, rng.normal(0, 1000, count))
    unusable = [float("nan"), float("inf"), float("-inf")]
    data = pa.table({"v": pa.array([*values, *unusable, None], pa.float64())})
    row = exact_quantiles(spark.createDataFrame(data).repartition(3), "v", [0.33, 0.66]).first()
    assert tuple(row) == pytest.approx(tuple(np.quantile(values, [0.33, 0.66])))


def test_map_classes(spark):
    values = [None, 1.0, 2.0, 3.0, 4.0]
    rows = [{"notice_id": str(v), "standing_live_biomass_tco2": v} for v in values]
    got = R.map_layer(results(spark, *rows)).orderBy("notice_id").collect()
    assert [r["map_class"] for r in got] == ["low", "middle", "high", "high", "unknown"]
    assert got[-1]["map_color"] == "#777777"
    none = R.quantile_thresholds(results(spark, rows[0])).first()
    assert tuple(none) == (0.0, 0.0)


def test_row_numbers_follow_the_key(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"), "id")
    numbered = row_numbers(df.repartition(5), "k", "n")
    assert numbered.filter("n != id + 1").count() == 0 and numbered.count() == 1000
    assert row_numbers(df.limit(0), "k", "n").count() == 0


def test_chart_rows_number_known_notices(spark):
    rows = [{"notice_id": n, "standing_live_biomass_tco2": s, "planned_harvest_biomass_tco2": p}
            for n, s, p in (("b", 1.0, None), ("a", None, 2.0), ("c", None, None))]
    got = R.chart_rows(results(spark, *rows)).orderBy("sequence").collect()
    assert [(r["sequence"], r["notice_id"]) for r in got] == [(1, "a"), (2, "b")]


def test_quantiles_rank_only_their_brackets(spark, monkeypatch):
    from standcarbon.operators import ordering

    ranked, seen = ordering._ranked, []

    def counted(df, key, weight):
        seen.append(df.count())
        return ranked(df, key, weight)

    monkeypatch.setattr(ordering, "_ranked", counted)
    # Distinct values with one that holds a third of the rows, and some that are no numbers.
    value = F.when(F.col("id") % 3 == 0, 1e6).otherwise(F.col("id") * 7919 % 1_000_003 + 0.5)
    df = spark.range(600_000).select(F.when(F.col("id") % 1000 == 1, float("nan")).otherwise(value).alias("v"))
    shares = [0.0, 0.1, 0.5, 0.66, 0.9, 1.0]
    row = exact_quantiles(df, "v", shares).first()
    values = np.array([r.v for r in df.filter("not isnan(v)").collect()])
    assert tuple(row) == pytest.approx(tuple(np.quantile(values, shares)), rel=1e-12)
    assert seen[0] < 0.005 * 600_000
    # Brackets that miss their ranks are opened.
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, _: F.transform(p, lambda x: F.lit(3.5)))
    missed = exact_quantiles(df, "v", [0.5]).first()
    assert missed.q1 == pytest.approx(np.quantile(values, 0.5), rel=1e-12)
