import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from standcarbon.sources import stores

BOXES = "id string, minx double, miny double, maxx double, maxy double"


def spoil(file: Path) -> None:
    """What is no Parquet any more fails every reader that opens it."""
    file.write_bytes(b"not to be read")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


def test_details_open_only_parts_of_wanted_stands(spark, tmp_path):
    path = f"file://{tmp_path}/details"
    rows = [(str(i), [f"e{i}"]) for i in range(300)] + [("7", ["again"]), (None, ["nobody's"])]
    details = spark.createDataFrame(rows, "stand_id string, elements array<string>")
    stores.write_details(details, path, 32)
    wanted = spark.createDataFrame([("7",), ("8",), ("7",), ("none",), (None,)], "stand_id string")
    found = stores.details_of(spark, path, details.schema, wanted, 32)
    assert found.columns == ["stand_id", "elements"]
    assert sorted((r.stand_id, r.elements[0]) for r in found.collect()) == [
        ("7", "again"), ("7", "e7"), ("8", "e8"),
    ]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    touched = {r[0] for r in wanted.dropna().select(stores._bucket("stand_id", 32)).collect()}
    stored = list((tmp_path / "details").rglob("*.parquet"))
    for file in stored:
        if int(file.parent.name.split("=")[1]) not in touched:
            spoil(file)
    assert len(stored) >= 30 and stores.details_of(spark, path, details.schema, wanted, 32).count() == 3
    assert stores.details_of(spark, path, details.schema, wanted.filter("false"), 32).count() == 0


def test_details_of_one_hot_stand(spark, tmp_path):
    path = f"file://{tmp_path}/details"
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("stand_id"), "id")
    stores.write_details(rows, path, 8)
    hot = spark.createDataFrame([("hot",)], "stand_id string")
    assert stores.details_of(spark, path, rows.schema, hot, 8).count() == 3000


def test_curve_interleaves_bits(spark):
    rng = random.Random(5)
    numbers = [(rng.randrange(1 << 31),) for _ in range(50)] + [(0,), ((1 << 31) - 1,)]
    got = spark.createDataFrame(numbers, "v long").select("v", stores._spread(F.col("v"))).collect()
    assert all(s == sum((v >> i & 1) << 2 * i for i in range(31)) for v, s in got)


@pytest.fixture
def layer(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        x, y = rng.uniform(0, 1e5), rng.uniform(0, 1e5)
        rows.append((str(i), x, y, x + 100, y + 100))
    rows += [("large", -1e4, -1e4, 2e5, 2e5), ("none", None, None, None, None), ("nan", float("nan"), 1.0, 2.0, 2.0)]
    rows += [(f"same{i}", 5e4, 5e4, 5e4 + 10, 5e4 + 10) for i in range(300)]
    path = f"file://{tmp_path}/layer"
    stores.write_layer(spark.createDataFrame(rows, BOXES), path, "id", file_rows=100)
    return path, rows, tmp_path / "layer" / "rows"


def inside(row, region):
    _, *b = row
    return None not in b and b[0] == b[0] and (
        b[0] <= region[2] and b[2] >= region[0] and b[1] <= region[3] and b[3] >= region[1]
    )


def test_region_opens_few_files(spark, layer):
    path, rows, folder = layer
    assert spark.read.parquet(f"{path}/rows").count() == len(rows)
    for region in ((1e4, 1e4, 2e4, 2e4), (5e4, 5e4, 5e4, 5e4), (-1e9, -1e9, 1e9, 1e9), (1e6, 1e6, 2e6, 2e6)):
        got = stores.read_region(spark, path, region)
        assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in rows if inside(r, region))
    opened = stores.read_region(spark, path, (1e4, 1e4, 2e4, 2e4)).inputFiles()
    every = list(folder.glob("*.parquet"))
    assert len(every) >= 20 and 1 <= len(opened) <= len(every) / 4
    # Many rows on one place are several files' rows.
    assert len(stores.read_region(spark, path, (5e4, 5e4, 5e4, 5e4)).inputFiles()) >= 3


def test_near_opens_few_files(spark, layer):
    path, rows, folder = layer
    boxes = [("a", 1e4, 1e4, 1.1e4, 1.1e4), ("b", 8e4, 9e4, 8.01e4, 9.01e4), ("c", None, 0.0, 0.0, 0.0)]
    near = stores.read_near(spark, path, spark.createDataFrame(boxes, BOXES), "id", 500.0)
    got = {r.id for r in near.collect()}
    for _, a, b, c, d in boxes[:2]:
        assert {r[0] for r in rows if inside(r, (a - 500, b - 500, c + 500, d + 500))} <= got
    assert len(near.inputFiles()) <= len(list(folder.glob("*.parquet"))) / 3


def test_empty_layer(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    stores.write_layer(spark.createDataFrame([], BOXES), path, "id")
    assert stores.read_region(spark, path, (0, 0, 1, 1)).count() == 0
