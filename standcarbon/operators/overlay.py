"""Notice x stand overlay: one row per pair with a positive common area."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.functions import geometry as G
from standcarbon.operators.area_kernel import overlap_batches
from standcarbon.operators.grid import BASE_CELL, box_join
from standcarbon.schemas import MIN_OVERLAP_M2
from standcarbon.session import staged_together


def positive_overlap(pairs: DataFrame) -> DataFrame:
    """Border and point contacts are no overlaps; areas leave in hectares."""
    return pairs.filter(F.col("overlap_m2") > MIN_OVERLAP_M2).withColumn(
        "overlap_ha", F.col("overlap_m2") / 10000
    )


def overlay_boxes(
    notices: DataFrame, stands: DataFrame, base_cell: float = BASE_CELL
) -> DataFrame:
    """For axis-aligned rectangles given by minx, miny, maxx, maxy in metres."""
    pairs = box_join(
        notices.select("notice_id", *G.BOUNDS),
        stands.select("stand_id", *G.BOUNDS),
        "notice_id",
        "stand_id",
        base_cell,
    )
    width = F.least("l_maxx", "r_maxx") - F.greatest("l_minx", "r_minx")
    height = F.least("l_maxy", "r_maxy") - F.greatest("l_miny", "r_miny")
    measured = pairs.select(
        F.col("l_notice_id").alias("notice_id"),
        F.col("r_stand_id").alias("stand_id"),
        (width * height).alias("overlap_m2"),
    )
    return positive_overlap(measured).select("notice_id", "stand_id", "overlap_ha")


def prepare_geometry(df: DataFrame, geographic: bool) -> DataFrame:
    """Bounds, area and the edge list the kernel reads, of the metric geometry."""
    metric = G.to_metric(F.col("geometry")) if geographic else F.col("geometry")
    # Bounds come from the plain rings, so a job that needs only them does not orient anything.
    bounded = G.with_bounds(df.withColumn("_metric", metric), "_metric")
    return (
        bounded.withColumn("area_ha", G.area_m2(G.oriented(F.col("_metric"))) / 10000)
        # The kernel counts edges by parity, whichever way they run.
        .withColumn("edges", G.edge_list(G.closed(F.col("_metric"))))
        .drop("_metric")
    )


# Shapes of more edges are cut into vertical strips of so many metres.
STRIP_EDGES, STRIP_METRES = 2_000, 4_096.0


def _cut(shapes: DataFrame, key: str, name: str) -> DataFrame:
    """(key, strip, name): edges of each shape of `shapes`(key, edges, large), of a large one for
    every strip that they reach into, of others as they are, with strip NULL."""
    whole = shapes.filter(~F.col("large")).select(key, F.lit(None).cast("long").alias("strip"), F.col("edges").alias(name))
    numbers = F.sequence(F.lit(0), (F.size("edges") / 4).cast("int") - 1)
    quads = shapes.filter("large").select(
        key, F.explode(F.transform(numbers, lambda i: F.slice("edges", i * 4 + 1, F.lit(4)))).alias("e")
    )
    low, high = (F.floor(f("e.0", "e.2") / STRIP_METRES) for f in (_least, _greatest))
    reached = quads.withColumn("strip", F.explode(F.sequence(low, high)))
    # The edges of one shape in one strip.
    cut = reached.groupBy(key, "strip").agg(F.flatten(F.collect_list("e")).alias(name))
    return whole.unionByName(cut)


def _least(*places: str) -> Column:
    return F.least(*[F.col(p.split(".")[0])[int(p.split(".")[1])] for p in places])


def _greatest(*places: str) -> Column:
    return F.greatest(*[F.col(p.split(".")[0])[int(p.split(".")[1])] for p in places])


def overlay_polygons(
    notices: DataFrame,
    stands: DataFrame,
    base_cell: float = BASE_CELL,
    strip_edges: int | None = None,
) -> DataFrame:
    """For polygons of any shape; both sides come from `prepare_geometry`.

    A pair with a shape of more than `strip_edges` edges is measured strip by strip, so its work
    spreads over tasks, and only the edges in the strips that the pair's boxes share are fetched.
    """
    limit = 4 * (strip_edges or STRIP_EDGES)
    sides = [
        df.select(F.col(f"{kind}_id").alias(f"key_{kind}"), *G.BOUNDS, "edges", (F.size("edges") > limit).alias("large"))
        for kind, df in (("notice", notices), ("stand", stands))
    ]
    # Read several times below; what is staged already is not written again.
    if not (hasattr(notices, "_staged") and hasattr(stands, "_staged")):
        sides = staged_together(*sides)
    pairs = box_join(
        *[df.select(key, *G.BOUNDS, "large") for df, key in zip(sides, _KEYS, strict=True)],
        *_KEYS,
        base_cell,
    )
    boxes = pairs.select(
        F.col("l_key_notice").alias("key_notice"),
        F.col("r_key_stand").alias("key_stand"),
        F.greatest("l_minx", "r_minx").alias("x0"),
        F.greatest("l_miny", "r_miny").alias("y0"),
        F.least("l_maxx", "r_maxx").alias("x1"),
        F.least("l_maxy", "r_maxy").alias("y1"),
        F.coalesce("l_large", F.lit(False)).alias("l_large"),
        F.coalesce("r_large", F.lit(False)).alias("r_large"),
    )
    types = [df.schema[key].dataType.simpleString() for df, key in zip(sides, _KEYS, strict=True)]
    schema = f"key_notice {types[0]}, key_stand {types[1]}, overlap_m2 double"
    columns = ["key_notice", "key_stand", "left_edges", "right_edges", "x0", "y0", "x1", "y1"]
    # Edges are looked up for pairs whose boxes meet; they take no part in the cell join.
    small = [df.filter(~F.col("large")) for df in sides]
    plain = boxes.filter(~(F.col("l_large") | F.col("r_large")))
    for df, key, name in zip(small, _KEYS, ("left_edges", "right_edges"), strict=True):
        plain = plain.join(df.select(key, F.col("edges").alias(name)), key)
    measured = plain.select(*columns).mapInArrow(overlap_batches, schema)
    if all(df.filter("large").isEmpty() for df in sides):
        return _shown(measured)
    first, last = (F.floor(F.col(x) / STRIP_METRES) for x in ("x0", "x1"))
    stripped = boxes.filter(F.col("l_large") | F.col("r_large"))
    stripped = stripped.withColumn("at", F.explode(F.sequence(first, last)))
    stripped = stripped.withColumns(
        {
            "x0": F.greatest("x0", F.col("at") * STRIP_METRES),
            "x1": F.least("x1", (F.col("at") + 1) * STRIP_METRES),
        }
    )
    for df, key, side, name in zip(sides, _KEYS, "lr", ("left_edges", "right_edges"), strict=True):
        strip = F.when(F.col(f"{side}_large"), F.col("at")).alias("strip")
        stripped = stripped.withColumn("strip", strip)
        cut = _cut(df, key, name).withColumnsRenamed({key: "_k", "strip": "_s"})
        met = (F.col(key) == F.col("_k")) & (F.coalesce("strip", F.lit(-(1 << 40))) == F.coalesce("_s", F.lit(-(1 << 40))))
        stripped = stripped.join(cut, met).drop("_k", "_s", "strip")
    parts = stripped.select(*columns).mapInArrow(overlap_batches, schema)
    parts = parts.groupBy(*_KEYS).agg(F.sum("overlap_m2").alias("overlap_m2"))
    return _shown(measured.unionByName(parts))


_KEYS = ("key_notice", "key_stand")


def _shown(measured: DataFrame) -> DataFrame:
    return positive_overlap(measured).select(
        F.col("key_notice").alias("notice_id"), F.col("key_stand").alias("stand_id"), "overlap_ha"
    )


def overlay(notices: DataFrame, stands: DataFrame, base_cell: float = BASE_CELL) -> DataFrame:
    """(notice_id, stand_id, overlap_ha); by edges where both sides have them, else by box."""
    if "edges" in notices.columns and "edges" in stands.columns:
        return overlay_polygons(notices, stands, base_cell)
    return overlay_boxes(notices, stands, base_cell)
