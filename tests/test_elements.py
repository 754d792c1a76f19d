import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from standcarbon.operators import elements as E


def details(spark, *items, stand="7"):
    texts = [item if isinstance(item, str) else json.dumps(item) for item in items]
    return spark.createDataFrame([(stand, texts)], "stand_id string, elements array<string>")


def test_elements_are_typed_and_negative_stock_dropped(spark):
    rows = E.normalize_elements(
        details(
            spark,
            {"id": 5.0, "puuliigiKood": " ma", "osakaal": "50", "tagavara": "nan", "rindeKood": "y"},
            '"stray"',
            "null",
            {"eraldisId": 7, "puuliigiKood": "KU", "tagavara": -2},
            {"eraldisId": 7, "puuliigiKood": "KS", "tagavara": 10, "vanus": 30, "jooksevVanus": True},
            {"id": 0, "tagavara": 0},
            {"id": "a 1 ", "osakaal": None},
            {"puuliigiKood": ""},
        )
    ).orderBy("pos")
    got = [
        (r["pos"], r["record_id"], r["stratum_code"], r["species_code"], r["share_pct"],
         r["stock_m3_ha"], r["inventory_age"], r["current_age"])
        for r in rows.collect()
    ]
    assert got == [
        (0, "5", "Y", "MA", 50.0, None, None, None),
        (2, "7:2", None, "KS", None, 10.0, 30.0, None),
        (3, "0", None, None, None, 0.0, None, None),
        (4, "a 1", None, None, None, None, None, None),
        (5, "unknown:5", None, None, None, None, None, None),
    ]


def test_raw_element_is_kept(spark):
    raw = {"id": 9, "tagavara": 41, "enamus": True, "mahtTm": 7.5}
    row = E.normalize_elements(details(spark, raw)).first()
    assert json.loads(row["raw_json"]) == raw


def stand(spark, **fields):
    row = {"id": "40817", "katastri_nr": "12345:001:0042", "eraldise_nr": "9"} | fields
    return E.build_stands(
        spark.createDataFrame([row], ", ".join(f"{name} string" for name in row)),
        F.lit(date(2026, 8, 9)),
    ).first()


def test_stand_fields(spark):
    row = stand(
        spark, invent_kp="2019-05-14Z", tagavara_1_ha="180", tagavara_2_ha="25", tagavara_y_ha="5",
        juurdekasv="2.6", kuivendatud="true", boniteedi_kood=" ", pindala="3.15",
    )
    assert (row["stand_id"], row["stand_number"], row["stock_m3_ha"]) == ("40817", 9, 210.0)
    assert row["inventory_date"] == date(2019, 5, 14)
    assert row["inventory_age_years"] == pytest.approx(7 + 87 / 365)
    assert (row["drained"], row["site_class"], row["area_ha"]) == (True, None, 3.15)


def test_unusable_components_stay_out_but_auditable(spark):
    row = stand(spark, tagavara_1_ha="nan", tagavara_2_ha="-3", tagavara_y_ha="4")
    assert (row["stock_layer_1"], row["stock_layer_2"], row["stock_young"]) == (None, None, 4.0)
    assert row["stock_m3_ha"] == 4.0
    assert row["raw_stock_inputs"] == {
        "tagavara_1_ha": "nan", "tagavara_2_ha": "-3", "tagavara_y_ha": "4",
    }


def test_no_component_means_unknown_stock(spark):
    assert stand(spark)["stock_m3_ha"] is None
    assert stand(spark, tagavara_1_ha="0")["stock_m3_ha"] == 0.0


def summary(spark, *rows):
    schema = (
        "stand_id string, pos long, species_code string, stock_m3_ha double, share_pct double, "
        "inventory_age double"
    )
    data = [("7", pos, *row) for pos, row in enumerate(rows)]
    return E.stand_detail_summary(spark.createDataFrame(data, schema)).first()


def test_summary_weights_by_stock(spark):
    row = summary(
        spark, ("MA", 100.0, None, 40.0), ("KS", 300.0, 10.0, None), ("KU", None, None, 9.0),
        ("HB", -1.0, 50.0, 9.0),
    )
    assert (row["n_species_rows"], row["volume_m3_ha"], row["main_species"]) == (2, 400.0, "Kask")
    assert row["weighted_age"] == 10.0
    assert row["weighted_density"] == pytest.approx((0.42 + 3 * 0.51) / 4)


def test_summary_falls_back_to_shares(spark):
    row = summary(spark, ("KS", None, 80.0, 45.0), ("KU", None, 80.0, 50.0))
    assert (row["volume_m3_ha"], row["main_species"], row["weighted_age"]) == (0.0, "Kask", None)
    assert row["weighted_density"] == 0.42


def test_later_document_wins(spark):
    docs = spark.createDataFrame(
        [("1", "2026-01-01", ["a"]), ("1", "2026-02-01", ["b"]), ("2", "2025-01-01", ["c"])],
        "stand_id string, at string, elements array<string>",
    )
    kept = {r["stand_id"]: r["elements"] for r in E.latest_details(docs, "at").collect()}
    assert kept == {"1": ["b"], "2": ["c"]}


def test_summary_rows_and_site(spark):
    schema = "stand_id string, pos long, species_code string, stock_m3_ha double, share_pct double"
    rows = [("7", 0, "KS", 3.0, None), ("7", 1, "MA", -1.0, 9.0), ("7", 2, "KU", None, 5.0), ("7", 3, "HB", None, 0.0)]
    got = E.usable_species(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [(r["species_code"], r["wood_density"]) for r in got] == [("KS", 0.51), ("KU", 0.40)]


def test_a_feed_may_carry_names_that_are_produced(spark):
    raw = spark.createDataFrame([("8.0", "8", "x", 1.0)], "id string, stand_id string, site_type string, minx double")
    row = E.build_stands(raw, F.lit(date(2026, 8, 9))).first()
    assert (row["stand_id"], row["site_type"], row["minx"]) == ("8", None, 1.0)


def test_an_object_is_parsed_once(spark):
    """Neither the filter for negative stocks nor a cast that fails costs a second reading."""
    rows = E.normalize_elements(details(spark, {"id": "1d", "tagavara": " +1.5e1 ", "vanus": "1e999"}))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("JsonToStructs") == 1
    row = rows.first()
    assert (row["record_id"], row["stock_m3_ha"], row["inventory_age"]) == ("1d", 15.0, None)
