import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from standcarbon.sources import files, layers, snapshots


def test_column_resolution():
    resolve = layers.resolve_column
    assert resolve(["Teatise-ID", "id"], ["teatis_id", "teatise_id", "id"]) == "Teatise-ID"
    assert resolve(["x_esitamise_kuupaev_dt"], ["kuupaev"]) == "x_esitamise_kuupaev_dt"
    assert resolve(["my_date"], ["date"]) is None, "short names match whole names only"
    assert resolve(["A b", "a_B"], ["ab"]) == "a_B", "the last of equal names counts"
    assert resolve(["registreeritud_x", "date"], ["registreeritud", "date"]) == "date"


def test_period_is_inclusive_and_drops_junk(spark):
    days = ["2026-01-01", "2026-01-31T23:59:59Z", "2026-02-01", "junk", None, "2025-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    kept = layers.filter_period(df, date(2026, 1, 1), date(2026, 1, 31), "d").collect()
    assert [r["d"] for r in kept] == days[:2]
    with pytest.raises(ValueError):
        layers.filter_period(df, date(2026, 2, 1), date(2026, 1, 1), "d")


def test_period_reaches_the_scan(spark, tmp_path):
    spark.sql("select date '2026-01-01' as submitted_date, 1 as x").write.parquet(f"{tmp_path}/t")
    df = layers.filter_period(
        spark.read.parquet(f"{tmp_path}/t"), date(2026, 1, 1), date(2026, 1, 2)
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(submitted_date,2026-01-01)" in plan
    assert "LessThan(submitted_date,2026-01-03)" in plan


def test_latest_and_first(spark):
    rows = [("1", 1, "archive"), ("1", 2, "current"), (None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(rows, "id string, rank int, v string")
    latest = {(r["id"], r["v"]) for r in layers.dedupe_latest(df, ["id"], ["rank"]).collect()}
    assert latest == {("1", "current"), (None, "y")}
    first = {(r["id"], r["v"]) for r in layers.dedupe_first(df, ["id"], ["rank"]).collect()}
    assert first == {("1", "archive"), (None, "x")}
    plan = layers.dedupe_latest(df, ["id"], ["rank"])._jdf.queryExecution().executedPlan()
    assert plan.toString().count("WindowGroupLimit") == 2, "ranked before the shuffle too"


def test_first_by_geometry(spark):
    schema = "geometry array<array<array<struct<x:double,y:double>>>>, rank int"
    shape, other = [[[{"x": 1.0, "y": 2.0}]]], [[[{"x": 1.0, "y": 3.0}]]]
    df = spark.createDataFrame([(shape, 2), (shape, 1), (other, 3)], schema)
    kept = layers.dedupe_first(df, None, ["rank"]).collect()
    assert sorted(r["rank"] for r in kept) == [1, 3]


def test_union_of_layers(spark):
    a, b = spark.sql("select 1 as id, 'x' as p"), spark.sql("select 2 as id, 'y' as q")
    rows = layers.union_layers({"a": a, "b": b}).orderBy("id").collect()
    assert [(r["source_layer"], r["source_rank"], r["p"], r["q"]) for r in rows] == [
        ("a", 1, "x", None), ("b", 2, None, "y"),
    ]
    assert layers.union_layers({"a": RuntimeError("down"), "b": b}).count() == 1
    with pytest.raises(RuntimeError, match="down"):
        layers.union_layers({"a": RuntimeError("down")})


def test_cap_per_layer(spark):
    df = spark.range(10).selectExpr("id", "if(id < 7, 'a', 'b') as source_layer")
    def count(n):
        capped = layers.limit_per_layer(df, ["a", "b"], n, ["id"])
        return [(r["source_layer"], r["id"]) for r in capped.orderBy("source_layer", "id").collect()]
    assert count(2) == [("a", 0), ("a", 1), ("b", 7), ("b", 8)]
    assert len(count(None)) == 10
    other = df.selectExpr("id", "nullif(if(id < 2, 'a', if(id < 5, 'c', 'd')), 'd') as source_layer")
    kept = layers.limit_per_layer(other, ["a"], 1, ["id"]).collect()
    assert sorted(r["id"] for r in kept) == [0, 2, 3, 4, 5, 6, 7, 8, 9]


def test_date_column_by_name_else_by_content(spark):
    named = spark.sql("select 'x' as esitatud, '2026-01-01' as other")
    assert layers.detect_date_column(named, "other") == "esitatud"
    rows = [(i, "2026-01-01" if i % 5 else "junk", f"2026-01-0{i % 9 + 1}") for i in range(15)]
    df = spark.createDataFrame(rows, "k int, mostly string, fully string")
    assert layers.detect_date_column(df, "k") == "fully"
    with pytest.raises(ValueError):
        layers.detect_date_column(df.select("k", "mostly"), "k")


def test_canonical_tables(spark):
    notices = spark.sql(
        "select '7' as id, '2026-03-01Z' as registreeritud, '12.5' as raie_maht, 'LR' as raieliik, "
        "'12345:001:0042' as katastri_nr, '2.0' as eraldise_nr"
    )
    row = layers.canonical_notices(notices).first().asDict()
    assert row == {
        "notice_id": "7", "submitted_date": date(2026, 3, 1), "harvest_type": "LR",
        "cadastral_ref": "12345:001:0042", "stand_number": 2, "planned_volume_m3": 12.5,
    }
    stands = layers.canonical_stands(spark.sql("select '12.0' as eraldis_id")).first()
    assert (stands["id"], stands["stand_id"]) == ("12.0", "12")
    with pytest.raises(ValueError):
        layers.canonical_stands(spark.sql("select 1 as x"))


def test_snapshots_expire_and_clear(spark, tmp_path):
    path = str(tmp_path / "store")
    at = datetime(2026, 8, 8, 12)
    schema = "namespace string, key string, cached_at timestamp, payload string"
    for payload, hours in (("old", 0), ("new", 2)):
        rows = [("wfs", "k", at + timedelta(hours=hours), payload)]
        snapshots.write_snapshot(spark.createDataFrame(rows, schema), path)

    def read(hours):
        store = spark.read.schema(schema).parquet(path)
        as_of = F.lit(at + timedelta(hours=hours))
        rows = snapshots.fresh_snapshots(store, as_of, snapshots.LAYER_MAX_AGE).collect()
        return [r["payload"] for r in rows]

    assert (read(26), read(26.001)) == (["new"], [])
    snapshots.clear_snapshots(spark.read.schema(schema).parquet(path), path)
    assert spark.read.schema(schema).parquet(path).count() == 0


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_feature_pages(spark, tmp_path):
    shell = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]
    pages = [
        [feature("Polygon", [shell, hole], id=1, maht=2.5), feature("Point", [1, 1], id=2)],
        [feature("MultiPolygon", [[shell], [hole]], id="3", uus=True)],
        [],
    ]
    collection = {"type": "GeometryCollection", "geometries": [
        {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Polygon", "coordinates": [shell]},
    ]}
    pages[2].append({"type": "Feature", "properties": {"id": 4}, "geometry": collection})
    for number, features in enumerate(pages):
        (tmp_path / f"{number}.json").write_text(json.dumps({"features": features}, indent=1))
    rows = {r["id"]: r for r in files.read_features(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]
    assert (rows["1"]["maht"], rows["3"]["uus"], rows["2"]["geometry"]) == ("2.5", "true", None)
    assert [len(polygon) for polygon in rows["1"]["geometry"]] == [2]
    assert [len(polygon) for polygon in rows["3"]["geometry"]] == [1, 1]
    assert [len(polygon) for polygon in rows["4"]["geometry"]] == [1]
    assert tuple(rows["1"]["geometry"][0][0][2]) == (2.0, 2.0)


def test_detail_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_stand_id": 7, "cached_at": "2026-01-01T00:00:00Z",
        "elemendid": [{"id": 1, "tagavara": "3"}, "x"], "kuivendatud": True}))
    (tmp_path / "b.json").write_text(json.dumps({"_stand_id": "7.0", "cached_at": "2026-01-02T00:00:00Z",
        "elemendid": [{"id": 2}]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps({"_stand_id": "8"}))
    rows = {r["stand_id"]: r for r in files.read_details(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["7", "8"]
    assert [json.loads(e) for e in rows["7"]["elements"]] == [{"id": 2}]
    assert rows["8"]["elements"] == []


def test_csv_has_a_header(spark, tmp_path):
    files.write_csv(spark.sql("select 1 as a, 'õ' as b").coalesce(1), str(tmp_path / "out"))
    [part] = (tmp_path / "out").glob("*.csv")
    assert part.read_text(encoding="utf-8").splitlines() == ["a,b", "1,õ"]


def test_collections_nested_too_deep_fail_loudly(spark):
    from standcarbon.sources import files

    polygon = '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}'

    def nested(depth: int) -> str:
        return polygon if not depth else f'{{"type": "GeometryCollection", "geometries": [{nested(depth - 1)}]}}'

    parse = lambda d: spark.createDataFrame([(nested(d),)], "g string").select(files.parse_geometry(F.col("g")).alias("p")).first()["p"]
    assert len(parse(files.COLLECTION_DEPTH)) == 1
    with pytest.raises(Exception, match="nested more than"):
        parse(files.COLLECTION_DEPTH + 1)


def test_profile_reads_its_input_once(spark):
    from standcarbon.sources import layers

    df = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02}", "x", None if i < 5 else "2024-02-01") for i in range(100)], "id int, a string, b string, `c d` string")
    profile = layers.profile_dates(df, "id")
    rates = {r.column_name: r.parse_rate for r in profile.collect()}
    assert rates["a"] == 1.0 and rates["b"] == 0.0 and rates["c d"] == 1.0
    plan = profile._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ExistingRDD") == 1 and "WindowGroupLimit" in final


def test_equally_late_documents_are_chosen_by_content(spark):
    from standcarbon.operators.elements import latest_details

    rows = [("1", ["a"], "x", 5), ("1", ["b"], "w", 5), ("1", ["z"], "w", 4), ("2", ["a"], None, 1)]
    schema = "stand_id string, elements array<string>, site_class string, at int"
    for order in (rows, rows[::-1]):
        kept = latest_details(spark.createDataFrame(order, schema), "at").collect()
        assert {(r.stand_id, r.elements[0]) for r in kept} == {("1", "b"), ("2", "a")}


def test_layers_that_fail_while_read(spark, tmp_path):
    def page(i):
        return json.dumps({"features": [{"properties": {"teatis_id": str(i)}, "geometry": None}]})

    for name in ("good", "torn", "bad"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.json").write_text(page(i))
    (tmp_path / "torn" / "1.json").write_text(page(1)[:-9])
    (tmp_path / "bad" / "1.json.gz").write_bytes(b"no archive")
    read = lambda name: lambda seen: files.read_features(spark, f"{tmp_path}/{name}", ["teatis_id"], seen=seen)
    readers = {name: read(name) for name in ("good", "torn", "bad", "missing")}
    readers["uncounted"] = lambda seen: spark.sql("select 'u' as teatis_id")
    loaded, counts = layers.load_layers(readers)
    assert counts == {"good": {"documents": 3, "broken": 0}, "torn": {"documents": 3, "broken": 1}}
    assert [n for n, x in loaded.items() if isinstance(x, Exception)] == ["bad", "missing"]
    rows = layers.union_layers(loaded).groupBy("source_layer").count().collect()
    assert {r["source_layer"]: r["count"] for r in rows} == {"good": 3, "torn": 2, "uncounted": 1}
    with pytest.raises(RuntimeError, match="bad"):
        layers.union_layers({n: loaded[n] for n in ("bad", "missing")})


def test_details_are_counted(spark, tmp_path):
    lines = ['{"_stand_id": "1", "elemendid": ["a"]}', '{"_stand_id": ', '{"elemendid": []}', '{"_stand_id": "1"}']
    (tmp_path / "details.json").write_text("\n".join(lines))
    seen = Observation()
    read = files.read_details(spark, f"{tmp_path}/details.json", lines=True, seen=seen)
    assert [r.stand_id for r in read.collect()] == ["1"]
    assert seen.get == {"documents": 4, "broken": 1, "without_id": 1}
    plain = files.read_details(spark, f"{tmp_path}/details.json", lines=True)
    assert plain.collect() == read.collect()


def test_store_replaces(spark, tmp_path):
    path, at = f"file://{tmp_path}/store", datetime(2024, 1, 1)
    schema = "namespace string, key string, cached_at timestamp, payload string"

    def put(rows):
        snapshots.replace_snapshots(spark.createDataFrame(rows, schema), path, 4)

    def stored():
        kind = spark.createDataFrame([], schema).schema
        return sorted((r.namespace, r.key, r.payload) for r in snapshots.read_store(spark, path, kind).collect())

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}

    put([("a", str(i), at, "first") for i in range(40)] + [("b", "x", at, "b"), ("12", "y", at, "c")])
    assert len(files()) <= 3 * 4
    for day in range(1, 4):
        before = files()
        put([("a", "7", at + timedelta(days=day), f"day {day}"), ("a", "8", at - timedelta(days=1), "too old")])
        assert len(files()) <= 3 * 4 and len(before.items() & files().items()) >= len(before) - 2
    found = {(n, k): p for n, k, p in stored()}
    assert len(found) == len(stored()) == 42
    assert found["a", "7"] == "day 3" and found["a", "8"] == "first" and found["12", "y"] == "c"
    broken = spark.createDataFrame([("a", "7", at + timedelta(days=9), "x")], schema)
    with pytest.raises(Exception, match="broken"):
        snapshots.replace_snapshots(broken.withColumn("payload", F.raise_error(F.lit("broken")).cast("string")), path, 4)
    assert {(n, k): p for n, k, p in stored()} == found
    snapshots.clear_store(spark, path, broken.schema)
    assert stored() == []
    put([("a", "1", at, "again")])
    assert stored() == [("a", "1", "again")]
