"""Which stands belong to a set of notices: by reference, else by bounding box."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.functions.geometry import BOUNDS, meets_box, pad_bounds
from standcarbon.operators.grid import BASE_CELL, DEGREE_CELL, box_join
from standcarbon.schemas import BBOX_PAD_DEGREES
from standcarbon.session import staged
from standcarbon.sources.layers import dedupe_first

# The pad in degrees, on the ground.
BBOX_PAD_METRES = 220.0
REFERENCE = ["cadastral_ref", "stand_number"]


def _units(pad: float | None, base_cell: float | None, geographic: bool) -> tuple[float, float]:
    """Degrees or metres for both."""
    default = (BBOX_PAD_DEGREES, DEGREE_CELL) if geographic else (BBOX_PAD_METRES, BASE_CELL)
    return default[0] if pad is None else pad, default[1] if base_cell is None else base_cell


def references(df: DataFrame) -> DataFrame:
    return df.select(*REFERENCE).dropna().distinct()


def exact_stands(stands: DataFrame, notices: DataFrame) -> DataFrame:
    """Stands some notice refers to."""
    return stands.join(references(notices), REFERENCE, "left_semi")


def unmatched_notices(notices: DataFrame, stands: DataFrame) -> DataFrame:
    """Notices without a full reference, or whose reference no stand has."""
    complete = F.col("cadastral_ref").isNotNull() & F.col("stand_number").isNotNull()
    # Notices without reference need no lookup; in it they would all meet in one task.
    unknown = notices.filter(complete).join(references(stands), REFERENCE, "left_anti")
    return notices.filter(~complete).unionByName(unknown)


def bbox_stands(
    notices: DataFrame,
    stands: DataFrame,
    pad: float | None = None,
    base_cell: float | None = None,
    geographic: bool = True,
) -> DataFrame:
    """(notice_id, stand_id) where the stand meets the notice's padded box: its shape, where
    `stands` has a geometry in the units of the bounds, else its own box. Prepared geometry has
    metric bounds beside the original shape, so there the boxes decide.

    `geographic` says that bounds are degrees; it decides the pad and the cells together.
    """
    pad, base_cell = _units(pad, base_cell, geographic)
    pairs = box_join(
        pad_bounds(notices.select("notice_id", *BOUNDS), pad),
        stands.select("stand_id", *BOUNDS),
        "notice_id",
        "stand_id",
        base_cell,
        touching=True,
    )
    met = [F.col("l_notice_id").alias("notice_id"), F.col("r_stand_id").alias("stand_id")]
    if "geometry" not in stands.columns or "edges" in stands.columns:
        return pairs.select(*met)
    # Shapes are looked up for pairs whose boxes meet.
    shapes = stands.select(F.col("stand_id").alias("r_stand_id"), "geometry")
    shown = pairs.join(shapes, "r_stand_id")
    return shown.filter(meets_box(F.col("geometry"), *[F.col(f"l_{b}") for b in BOUNDS])).select(*met)


def stands_for_notices(
    notices: DataFrame,
    stands: DataFrame,
    pad: float | None = None,
    base_cell: float | None = None,
    geographic: bool = True,
) -> DataFrame:
    """Every stand needed, once: referenced ones, then those near notices left unmatched."""
    notices = staged(notices.select("notice_id", *REFERENCE, *BOUNDS))
    exact = staged(exact_stands(stands, notices).withColumn("frame_rank", F.lit(0)))
    unmatched = unmatched_notices(notices, exact)
    near = bbox_stands(unmatched, stands, pad, base_cell, geographic)
    fallback = stands.join(near.select("stand_id").distinct(), "stand_id", "left_semi")
    united = exact.unionByName(fallback.withColumn("frame_rank", F.lit(1)))
    return dedupe_first(united, ["stand_id"], ["frame_rank"])
