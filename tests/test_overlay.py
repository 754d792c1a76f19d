"""Overlay against brute force, for any size mix, cell size and shape."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from standcarbon.functions import geometry as G
from standcarbon.operators.area_kernel import overlap_areas
from standcarbon.operators.grid import box_join
from standcarbon.operators.lookup import bbox_stands, stands_for_notices
from standcarbon.operators import area_kernel
from standcarbon.operators.overlay import _cut, overlay, overlay_polygons, prepare_geometry
from standcarbon.operators import skew
from standcarbon.operators.skew import crowded_keys, many_to_many

ORIGIN = 6_500_000.0


def boxes(spark, rows, key):
    return spark.createDataFrame(
        [(str(i), *map(float, row)) for i, row in enumerate(rows)],
        f"{key} string, minx double, miny double, maxx double, maxy double",
    )


def random_boxes(rng, count):
    out = []
    for _ in range(count):
        x, y = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
        size = 10 ** rng.uniform(0, 4)
        out.append((x, y, x + size * rng.uniform(0, 1), y + size * rng.uniform(0, 1)))
    return out


def brute(a, b):
    found = {}
    for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        if w > 0 and h > 0 and w * h > 1e-6:
            found[str(i), str(j)] = w * h / 10000
    return found


def pairs(df):
    rows = df.collect()
    found = {(r["notice_id"], r["stand_id"]): r["overlap_ha"] for r in rows}
    assert len(found) == len(rows), "a pair came twice"
    return found


@pytest.mark.parametrize("cell", [7.0, 512.0, 50_000.0])
def test_boxes_of_all_sizes_meet_once(spark, cell):
    rng = random.Random(int(cell))
    a, b = random_boxes(rng, 80), random_boxes(rng, 90)
    found = pairs(overlay(boxes(spark, a, "notice_id"), boxes(spark, b, "stand_id"), cell))
    assert found == pytest.approx(brute(a, b))


def test_one_huge_box_over_many_small_ones_splits_its_cell(spark, monkeypatch):
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 20)
    a = [(x * 10, 0, x * 10 + 5, 5) for x in range(300)]
    b = [(-1e6, -1e6, 1e6, 1e6), (0, 0, 20, 20)]
    left, right = boxes(spark, a, "notice_id"), boxes(spark, b, "stand_id")
    for first, second, flip in ((left, right, False), (right, left, True)):
        keys = ("stand_id", "notice_id") if flip else ("notice_id", "stand_id")
        got = box_join(first, second, *keys)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "_left_part" in plan and "_right_part" in plan
        ends = ("r_notice_id", "l_stand_id") if flip else ("l_notice_id", "r_stand_id")
        found = {tuple(r[end] for end in ends) for r in got.collect()}
        assert got.count() == len(found) and found == set(brute(a, b))


def test_touching_and_unplaced_boxes(spark):
    a = [(0, 0, 10, 10), (float("nan"), 0, 1, 1)]
    b = [(10, 0, 20, 10), (10, 10, 20, 20), (11, 0, 12, 1)]
    left, right = boxes(spark, a, "notice_id"), boxes(spark, b, "stand_id")
    assert overlay(left, right).count() == 0
    near = {(r["notice_id"], r["stand_id"]) for r in bbox_stands(left, right, pad=0.0).collect()}
    assert near == {("0", "0"), ("0", "1")}


def test_degree_sized_boxes_with_small_cells(spark):
    left = boxes(spark, [(24.47, 58.75, 24.471, 58.751)], "notice_id")
    right = boxes(spark, [(24.4725, 58.75, 24.473, 58.7505), (24.474, 58.75, 24.475, 58.7505)], "stand_id")
    near = bbox_stands(left, right, base_cell=0.01).collect()
    assert [r["stand_id"] for r in near] == ["0"]


def test_referenced_stands_first_then_neighbours_of_unmatched(spark):
    reference = "cadastral_ref string, stand_number long"
    notices = boxes(spark, [(0, 0, 1, 1), (100, 100, 101, 101)], "notice_id").join(
        spark.createDataFrame([("0", "K", 1), ("1", "Q", 9)], f"notice_id string, {reference}"),
        "notice_id",
    )
    stands = boxes(spark, [(500, 0, 501, 1), (0, 0, 1, 1), (101.5, 100, 102, 101)], "stand_id").join(
        spark.createDataFrame(
            [("0", "K", 1), ("1", "K", 2), ("2", None, None)], f"stand_id string, {reference}"
        ),
        "stand_id",
    )
    got = stands_for_notices(notices, stands, pad=1.0, geographic=False).orderBy("stand_id").collect()
    assert [(r["stand_id"], r["frame_rank"]) for r in got] == [("0", 0), ("2", 1)]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def shapes(spark, geometries, key):
    rows = [(str(i), g) for i, g in enumerate(geometries)]
    schema = f"{key} string, geometry array<array<array<struct<x:double,y:double>>>>"
    return prepare_geometry(spark.createDataFrame(rows, schema), False)


def area(spark, first, second):
    found = pairs(overlay(shapes(spark, [first], "notice_id"), shapes(spark, [second], "stand_id")))
    return found.get(("0", "0"), 0.0) * 10000


def test_shapes(spark):
    o = ORIGIN
    whole = [[square(o, o, o + 200, o + 200)]]
    clockwise = [[list(reversed(square(o, o, o + 200, o + 200)))]]
    holed = [[square(o, o, o + 200, o + 200), square(o + 50, o + 50, o + 150, o + 150)]]
    two = [[square(o, o, o + 100, o + 200)], [square(o + 300, o, o + 400, o + 100)]]
    notch = [[ring((o, o), (o + 200, o), (o + 200, o + 50), (o + 50, o + 50), (o + 50, o + 200), (o, o + 200))]]
    triangle = [[ring((o, o), (o + 200, o), (o, o + 200))]]
    east = [[square(o + 200, o, o + 300, o + 200)]]
    assert area(spark, whole, whole) == pytest.approx(40000)
    assert area(spark, clockwise, whole) == pytest.approx(40000)
    assert area(spark, whole, holed) == pytest.approx(30000)
    assert area(spark, holed, [[square(o + 60, o + 60, o + 140, o + 140)]]) == 0
    assert area(spark, two, [[square(o + 50, o, o + 350, o + 200)]]) == pytest.approx(15000)
    assert area(spark, notch, [[square(o + 60, o + 60, o + 300, o + 300)]]) == 0
    assert area(spark, notch, whole) == pytest.approx(50 * 200 + 150 * 50)
    assert area(spark, triangle, [[square(o + 50, o + 50, o + 150, o + 150)]]) == pytest.approx(5000)
    assert area(spark, whole, east) == 0


def star(rng, corners):
    angles = np.sort(rng.uniform(0, 2 * np.pi, corners))
    radius = rng.uniform(20, 100, corners)
    shift = rng.uniform(0, 60, 2)
    return np.stack([np.cos(angles) * radius + shift[0], np.sin(angles) * radius + shift[1]], axis=1)


def edges(points):
    following = np.roll(points, -1, axis=0)
    return np.concatenate([points, following], axis=1).ravel()


def inside(points, x, y):
    hit = np.zeros_like(x, dtype=bool)
    for (x1, y1), (x2, y2) in zip(points, np.roll(points, -1, axis=0), strict=True):
        crosses = (y1 > y) != (y2 > y)
        hit ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1 + 1e-300) + x1)
    return hit


def test_kernel_matches_sampling_and_is_symmetric():
    rng = np.random.default_rng(5)
    grid = (np.arange(1200) + 0.5) / 1200 * 320 - 120
    x, y = np.meshgrid(grid, grid)
    for _ in range(6):
        a, b = star(rng, 12), star(rng, 9)
        low = np.maximum(a.min(axis=0), b.min(axis=0))
        high = np.minimum(a.max(axis=0), b.max(axis=0))
        window = np.array([[*low, *high]])
        left, right = pa.array([edges(a)]), pa.array([edges(b)])
        exact = overlap_areas(left, right, window)[0]
        assert overlap_areas(right, left, window)[0] == pytest.approx(exact, abs=1e-9)
        sampled = (inside(a, x, y) & inside(b, x, y)).mean() * 320**2
        assert exact == pytest.approx(sampled, rel=0.02, abs=20)


def test_area_and_projection(spark):
    o = ORIGIN
    df = shapes(spark, [[[square(o, o, o + 200, o + 200), square(o, o, o + 100, o + 100)]]], "notice_id")
    assert df.first()["area_ha"] == pytest.approx(3.0)
    corner = [[ring((24.0, 57 + 31 / 60 + 3.19415 / 3600), (25.0, 58.0), (26.0, 59.0))]]
    geo = spark.createDataFrame(
        [("0", corner)], "notice_id string, geometry array<array<array<struct<x:double,y:double>>>>"
    )
    p = geo.select(G.to_metric(F.col("geometry")).alias("g")).first()["g"][0][0]
    assert (p[0]["x"], p[0]["y"]) == pytest.approx((500000.0, 6375000.0), abs=1e-6)
    # Scale is true on the standard parallels, here along 58 N.
    along = [[ring((24.0, 58.0), (24.001, 58.0), (24.0, 58.001))]]
    geo = spark.createDataFrame([("0", along)], geo.schema)
    q = geo.select(G.to_metric(F.col("geometry")).alias("g")).first()["g"][0][0]
    phi, e2 = np.radians(58.0), 0.00669438002290
    width = 6378137 / np.sqrt(1 - e2 * np.sin(phi) ** 2) * np.cos(phi) * np.radians(0.001)
    assert np.hypot(q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]) == pytest.approx(width, rel=1e-7)


def test_boxes_larger_than_any_fixed_level(spark):
    """A corner that is finite but absurd is one cell on a coarse level, not billions."""
    left = boxes(spark, [(-1e17, -1e17, 1e17, 1e17), (0, 0, 1, 1)], "notice_id")
    right = boxes(spark, [(0, 0, 10, 10), (-1e30, 0, 1e30, 5)], "stand_id")
    got = {(r["l_notice_id"], r["r_stand_id"]) for r in box_join(left, right, "notice_id", "stand_id").collect()}
    assert got == {("0", "0"), ("0", "1"), ("1", "0"), ("1", "1")}


def test_crowded_keys_on_both_sides(spark, monkeypatch):
    left = spark.range(300).selectExpr("case when id < 200 then 1 else id end as k", "id as a")
    right = spark.range(500).selectExpr("case when id < 150 then 1 when id < 200 then null else id end as k", "id as b")
    crowded = crowded_keys(left, right, ["k"], 100)
    assert [tuple(r) for r in crowded.collect()] == [(1, 20, 15)]
    plain = sorted(left.join(right, "k").select("k", "a", "b").collect())
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 100)
    dealt = many_to_many(left, right, ["k"], ["a"], ["b"])
    assert sorted(dealt.select("k", "a", "b").collect()) == plain and len(plain) == 200 * 150 + 100
    assert crowded_keys(left, right, ["k"], 10**6).isEmpty()


def test_adaptive_execution_splits_a_heavy_key(spark):
    """Joins with one row per key on one side rely on this."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(0, 60_000, 1, 6).selectExpr("if(id % 3 > 0, 1, id) as k", "id as a")
        one = spark.range(60_000).selectExpr("id as k", "id * 2 as b")
        joined = many.join(one, "k")
        assert len(joined.collect()) == 60_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def circle(n, x, y, radius):
    angle = np.arange(n) * 2 * np.pi / n
    return ring(*zip((x + np.cos(angle) * radius).tolist(), (y + np.sin(angle) * radius).tolist()))


def test_a_large_pair_spreads_over_strips(spark):
    """Same areas in strips, and only the strips that boxes share are measured."""
    o = ORIGIN
    left = [[[circle(400, o, o, 30_000.0)]], [[square(o - 100, o - 100, o + 5000, o + 100)]], [[square(o + 1e6, o, o + 1e6 + 1, o + 1)]]]
    right = [[[circle(500, o + 20_000, o, 30_000.0)]], [[square(o, o, o + 300, o + 300)]]]
    a, b = shapes(spark, left, "notice_id"), shapes(spark, right, "stand_id")
    whole = pairs(overlay_polygons(a, b))
    cut = overlay_polygons(a, b, strip_edges=50)
    assert pairs(cut) == pytest.approx(whole, rel=1e-9) and len(whole) == 4
    rows = _cut(a.select(F.col("notice_id").alias("key_notice"), "edges", (F.size("edges") > 200).alias("large")), "key_notice", "e")
    strips = rows.groupBy("key_notice").agg(F.count("strip").alias("n"), F.max(F.size("e")).alias("most")).collect()
    found = {r["key_notice"]: (r["n"], r["most"]) for r in strips}
    assert found["0"][0] in (15, 16) and found["0"][1] < 4 * 400 / 3 and found["1"][0] == 0


def test_crossing_edges_of_many_shapes():
    rng = np.random.default_rng(9)
    shapes_ = [star(rng, int(rng.integers(5, 40))) for _ in range(40)]
    rows = [(a, b) for a in shapes_[:20] for b in shapes_[20:]]
    window = np.array([[*np.maximum(a.min(axis=0), b.min(axis=0)), *np.minimum(a.max(axis=0), b.max(axis=0))] for a, b in rows])
    left, right = (pa.array([edges(r[i]) for r in rows]) for i in (0, 1))
    fast = overlap_areas(left, right, window)
    before, area_kernel.ALIKE = area_kernel.ALIKE, 0
    try:
        assert overlap_areas(left, right, window) == pytest.approx(fast, abs=1e-9)
    finally:
        area_kernel.ALIKE = before
    one = [overlap_areas(left[i : i + 1], right[i : i + 1], window[i : i + 1])[0] for i in range(0, 400, 37)]
    assert fast[::37] == pytest.approx(one, abs=1e-9)


def test_projection_there_and_back(spark):
    corner = [[ring((21.5, 57.4), (24.0, 58.5), (28.3, 59.9), (24.0, 57.5175539305))]]
    geo = spark.createDataFrame([(corner,)], "geometry array<array<array<struct<x:double,y:double>>>>")
    back = geo.select(G.to_geographic(G.to_metric(F.col("geometry"))).alias("g")).first()["g"][0][0]
    for got, want in zip(back, corner[0][0], strict=True):
        assert abs(got["x"] - want["x"]) < 1e-9 and abs(got["y"] - want["y"]) < 1e-9


def test_box_against_shape(spark):
    notch = [[ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]]
    holed = [[square(0, 0, 10, 10), square(2, 2, 8, 8)]]
    cases = [
        (notch, (5, 5, 9, 9), False), (notch, (3, 3, 5, 5), True), (notch, (4, 6, 9, 9), True),
        (notch, (4.01, 6, 9, 9), False), (notch, (1, 1, 2, 2), True), (notch, (-5, -5, 50, 50), True),
        (holed, (3, 3, 7, 7), False), (holed, (3, 3, 8, 7), True), (holed, (0.5, 0.5, 1, 1), True),
        (notch, (10, 10, 12, 12), False), (notch, (10, 4, 12, 12), True), ([], (0, 0, 1, 1), False),
        ([[ring((0, 10), (10, 0), (10, 10))]], (0, 0, 4.9, 4.9), False),
        ([[ring((0, 10), (10, 0), (10, 10))]], (0, 0, 5, 5), True),
        ([[ring((0, 5), (20, 5.5), (20, 6))]], (8, 0, 9, 50), True),
    ]
    rows = [(g, *map(float, box)) for g, box, _ in cases] + [(None, 0.0, 0.0, 1.0, 1.0)]
    schema = "g array<array<array<struct<x:double,y:double>>>>, a double, b double, c double, d double"
    df = spark.createDataFrame(rows, schema)
    found = [r.m for r in df.select(G.meets_box(F.col("g"), *map(F.col, "abcd")).alias("m")).collect()]
    assert found == [want for *_, want in cases] + [False]


def test_stands_whose_shape_is_apart_are_not_loaded(spark):
    notch = [[ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]]
    schema = "geometry array<array<array<struct<x:double,y:double>>>>"
    stands = boxes(spark, [(0, 0, 10, 10)], "stand_id").crossJoin(spark.createDataFrame([(notch,)], schema))
    notices = boxes(spark, [(7, 7, 8, 8), (5, 5, 8, 8)], "notice_id")
    near = bbox_stands(notices, stands, pad=1.5, geographic=False).collect()
    assert [r["notice_id"] for r in near] == ["1"]
    plain = bbox_stands(notices, stands.drop("geometry"), pad=1.5, geographic=False)
    assert plain.count() == 2
