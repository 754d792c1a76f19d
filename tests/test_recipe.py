"""The README's recipe, from files to CSV, with degrees, holes and collections; and packaging."""

import json
import os
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from standcarbon.operators.elements import build_stands, normalize_elements
from standcarbon.operators.lookup import stands_for_notices
from standcarbon.operators.overlay import prepare_geometry
from standcarbon.plans.analysis import analyze
from standcarbon.plans.reports import export_table
from standcarbon.sources.files import (
    read_details,
    read_features,
    snapshot_details,
    snapshot_features,
    write_csv,
)
from standcarbon.sources.layers import canonical_stands, load_notices

WEST, SOUTH, STEP = 24.5, 58.6, 0.004


def cell(x: float, y: float, w: float = 1, h: float = 1):
    x0, y0 = WEST + STEP * x, SOUTH + STEP * y
    x1, y1 = x0 + STEP * w, y0 + STEP * h
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def page(*features):
    return json.dumps(
        {"features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}
    )


STAND_PAGE = page(
    ({"id": "31.0", "katastri_nr": "A", "eraldise_nr": "1", "invent_kp": "2024-03-02Z",
      "tagavara_1_ha": "100", "kuivendatud": "t"}, polygon(cell(0, 0))),
    ({"id": "32", "katastri_nr": "B", "eraldise_nr": "9", "tagavara_1_ha": "nan"}, polygon(cell(1, 0))),
    ({"id": "33", "katastri_nr": "C", "eraldise_nr": "1"}, polygon(cell(500, 0))),
)
DETAIL = json.dumps(
    {"_stand_id": 31, "cached_at": "2026-01-01T00:00:00Z", "boniteediKood": "2",
     "elemendid": [{"id": 7, "puuliigiKood": "KS", "osakaal": 100, "tagavara": "100", "vanus": 40}]}
)


def layers(tmp_path):
    inner = {"type": "GeometryCollection", "geometries": [
        {"type": "GeometryCollection", "geometries": [polygon(cell(1, 0, 0.5, 1))]}]}
    pages = {
        "archive": page(
            ({"teatis_id": "n1", "registreeritud": "2026-02-03", "raie_maht": "10",
              "katastri_nr": "A", "eraldise_nr": "1"}, polygon(cell(0, 0, 0.5, 1))),
            ({"teatis_id": "n2", "registreeritud": "2026-02-03", "raie_maht": "4"}, inner),
        ),
        "current": page(
            ({"teatis_id": "n1", "registreeritud": "2027-02-03", "raie_maht": "99"}, polygon(cell(0, 0))),
        ),
    }
    for name, text in pages.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(text)
    return {name: str(tmp_path / name) for name in pages}


def test_recipe(spark, tmp_path):
    paths = layers(tmp_path)
    (tmp_path / "stands.json").write_text(STAND_PAGE)
    (tmp_path / "details.json").write_text(DETAIL)
    notices = load_notices(
        {name: read_features(spark, path) for name, path in paths.items()},
        date(2026, 1, 1), date(2026, 12, 31), 5000, "teatis_id",
    )
    # The current copy of n1 lies outside the period; the archived one counts.
    assert {(r["notice_id"], r["source_layer"]) for r in notices.collect()} == {("n1", "archive"), ("n2", "archive")}
    stands = build_stands(
        canonical_stands(read_features(spark, str(tmp_path / "stands.json"))), F.lit(date(2026, 8, 9))
    )
    needed = stands_for_notices(notices, stands, geographic=True)
    assert {r["stand_id"] for r in needed.collect()} == {"31", "32"}
    results, species = analyze(
        prepare_geometry(notices, geographic=True),
        prepare_geometry(needed, geographic=True),
        normalize_elements(read_details(spark, str(tmp_path / "details.json"))),
        F.lit(date(2026, 8, 9)),
    )
    rows = {r["notice_id"]: r for r in results.collect()}
    assert rows["n1"]["spatial_coverage_pct"] == pytest.approx(100, abs=1e-3)  # projected edges bend
    assert rows["n1"]["dominant_species"] == "Kask"
    assert rows["n1"]["planned_harvest_biomass_tco2"] == pytest.approx(10 * 0.51 * 1.3 * 0.5 * 44 / 12)
    assert rows["n1"]["standing_live_biomass_tco2"] == pytest.approx(
        rows["n1"]["area_ha"] * 100 * 0.51 * 1.3 * 0.5 * 44 / 12, rel=1e-5
    )
    assert rows["n2"]["spatial_coverage_pct"] == pytest.approx(100, abs=1e-3)  # projected edges bend
    assert rows["n2"]["standing_live_biomass_tco2"] is None
    assert {(r["notice_id"], r["source_record_id"]) for r in species.collect()} == {("n1", "7")}
    write_csv(export_table(results), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_snapshots_are_parsed_like_files(spark, tmp_path):
    rows = [("wfs", "k", "2026-01-01 00:00:00", STAND_PAGE), ("wfs", "bad", "2026-01-01 00:00:00", "{oops")]
    kept = spark.createDataFrame(rows, "namespace string, key string, cached_at string, payload string")
    kept = kept.withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    features = snapshot_features(kept, ["id", "katastri_nr"]).collect()
    assert [(r["key"], r["id"]) for r in features] == [("k", "31.0"), ("k", "32"), ("k", "33")]
    assert all(len(r["geometry"][0][0]) == 5 for r in features)
    details = kept.selectExpr("cached_at", f"'{DETAIL}' as payload").limit(1)
    row = snapshot_details(details).first()
    assert (row["stand_id"], row["site_class"], len(row["elements"])) == ("31", "2", 1)


def test_workers_get_the_package_wherever_the_driver_starts(tmp_path):
    """The polygon kernel runs in Python workers that are started in another folder."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from standcarbon.session import tune
spark = tune(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "1").getOrCreate())
from standcarbon.operators.overlay import overlay, prepare_geometry
ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))]
kind = " string, geometry array<array<array<struct<x:double,y:double>>>>"
side = lambda key: prepare_geometry(spark.createDataFrame([("1", [[ring]])], key + kind), False)
print("PAIRS", overlay(side("notice_id"), side("stand_id")).count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).parents[1])
    done = subprocess.run(
        [sys.executable, "-c", code, root], cwd=tmp_path, env=environment,
        capture_output=True, text=True, timeout=300,
    )
    assert "PAIRS 1" in done.stdout, done.stderr[-2000:]
