"""Bounding-box join on a hierarchy of grids.

A range predicate alone makes Spark compare every pair. Here each box goes to the grid level
whose cell is the smallest not smaller than the box, so it touches at most 2 x 2 cells however
large it is, and boxes meet in an ordinary hash join on the cell. A pair of boxes meets on the
coarser of its two levels: every box is also posted on the coarser levels the other side uses.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.functions.geometry import BOUNDS
from standcarbon.operators.skew import many_to_many
from standcarbon.session import staged_together

BASE_CELL = 512.0
# The same for coordinates in degrees: about half a kilometre of latitude.
DEGREE_CELL = 0.005
LEVEL_FACTOR = 4.0

_CELL = ["_grid", "_cx", "_cy"]


def _level(prefix: str, base_cell: float) -> Column:
    width = F.col(prefix + "maxx") - F.col(prefix + "minx")
    height = F.col(prefix + "maxy") - F.col(prefix + "miny")
    steps = F.ceil(F.log(F.greatest(width, height) / base_cell) / math.log(LEVEL_FACTOR))
    # log of 0 is NULL: a point belongs to the finest level.
    return F.greatest(F.coalesce(steps, F.lit(0)), F.lit(0)).cast("int")


def _boxes(df: DataFrame, prefix: str, base_cell: float) -> DataFrame:
    renamed = df.withColumnsRenamed({name: prefix + name for name in df.columns})
    known = F.lit(True)
    for name in BOUNDS:
        # A NaN or infinite corner is no place at all.
        known = known & (F.abs(F.col(prefix + name)) < float("inf"))
    return renamed.filter(known).withColumn(prefix + "level", _level(prefix, base_cell))


def _post(df: DataFrame, prefix: str, grids: Column, base_cell: float) -> DataFrame:
    """One row per grid and touched cell. Grid number = 2 * level + side that owns the level."""
    posted = df.withColumn("_grid", F.explode(grids))
    size = F.lit(base_cell) * F.pow(F.lit(LEVEL_FACTOR), F.floor(F.col("_grid") / 2))

    def cells(low: str, high: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(prefix + low) / size), F.floor(F.col(prefix + high) / size))
        )

    return posted.withColumn("_cx", cells("minx", "maxx")).withColumn("_cy", cells("miny", "maxy"))


def _levels(a: DataFrame, b: DataFrame) -> tuple[list[int], list[int]]:
    """Levels in use on either side: as many as a box can be doubled twice, a few hundred."""
    levels = a.select(F.lit(0).alias("side"), F.col("l_level").alias("level")).unionByName(
        b.select(F.lit(1).alias("side"), F.col("r_level").alias("level"))
    )
    found = sorted((row["side"], row["level"]) for row in levels.distinct().collect())
    return [n for side, n in found if side == 0], [n for side, n in found if side == 1]


def _grids(level: Column, own: list[int], other: list[int], side: int) -> Column:
    """Grids a box is posted on: the level of its own, and the coarser ones of the other side.

    Pairs on one level meet on the grid of side 0.
    """
    choices = F.lit(None).cast("array<int>")
    for mine in own:
        smaller = [theirs for theirs in other if theirs < mine or (theirs == mine and side == 0)]
        larger = [theirs for theirs in other if theirs > mine or (theirs == mine and side == 1)]
        grids = [2 * mine + side] * bool(smaller) + [2 * theirs + 1 - side for theirs in larger]
        choices = F.when(level == mine, F.array(*map(F.lit, grids)).cast("array<int>")).otherwise(
            choices
        )
    return choices


def box_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    base_cell: float = BASE_CELL,
    touching: bool = False,
) -> DataFrame:
    """Pairs of rows whose boxes overlap, each exactly once; columns get prefixes `l_` and `r_`.

    With `touching` shared borders count too. The keys tell the rows of a side apart. Both sides are
    staged first, so give ids and bounds only and look other columns up afterwards.
    """
    a, b = staged_together(_boxes(left, "l_", base_cell), _boxes(right, "r_", base_cell))
    left_levels, right_levels = _levels(a, b)
    a_cells = _post(a, "l_", _grids(F.col("l_level"), left_levels, right_levels, 0), base_cell)
    b_cells = _post(b, "r_", _grids(F.col("r_level"), right_levels, left_levels, 1), base_cell)
    met = many_to_many(a_cells, b_cells, _CELL, ["l_" + left_key], ["r_" + right_key])

    corner_x = F.greatest("l_minx", "r_minx")
    corner_y = F.greatest("l_miny", "r_miny")
    far_x, far_y = F.least("l_maxx", "r_maxx"), F.least("l_maxy", "r_maxy")
    meets = (
        (corner_x <= far_x) & (corner_y <= far_y)
        if touching
        else (corner_x < far_x) & (corner_y < far_y)
    )
    # Boxes sharing several cells are kept only in the cell of their common lower-left corner.
    size = F.lit(base_cell) * F.pow(F.lit(LEVEL_FACTOR), F.floor(F.col("_grid") / 2))
    home = (F.floor(corner_x / size) == F.col("_cx")) & (F.floor(corner_y / size) == F.col("_cy"))
    return met.filter(meets & home).drop(*_CELL, "l_level", "r_level")
