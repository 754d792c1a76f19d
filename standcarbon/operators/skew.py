"""Equi-join of many rows with many, that deals crowded keys out over tasks.

Adaptive execution splits a partition that is large. It cannot see that two small partitions hold
one key whose rows all pair up. Here the pairs of a key are counted beforehand.

Joins with at most one row per key on one side need none of this and are plain joins.
"""

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standcarbon.session import staged

PAIRS_PER_TASK = 200_000_000


def crowded_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    pairs: int | None = None,
    rows: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Keys with more than `pairs` pairs, and into how many parts to cut the rows of either side.

    One aggregation over the key columns, combined before its shuffle. All such keys, in a staged
    table: nothing is collected, and a later join broadcasts it only if it is small. `rows`, see
    `many_to_many`, are read in place of the two sides.
    """
    limit = pairs or PAIRS_PER_TASK
    side = isqrt(limit)
    a, b, count = (left, right, F.lit(1)) if rows is None else (*rows, F.col("rows"))
    both = a.select(*keys, count.alias("_l"), F.lit(0).alias("_r")).unionByName(
        b.select(*keys, F.lit(0).alias("_l"), count.alias("_r"))
    )
    counted = both.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    crowded = counted.filter(F.col("_l").cast("double") * F.col("_r") > limit)

    def parts(rows: str) -> Column:
        return F.ceil(F.col(rows) / side).cast("int")

    return staged(crowded.select(*keys, parts("_l").alias("_left"), parts("_r").alias("_right")))


def _dealt(
    df: DataFrame, crowded: DataFrame, keys: Sequence[str], spread: Sequence[str], own: str, other: str
) -> DataFrame:
    """Each row in one part of its own side, by a hash so that a retried task puts it where it
    was, and a copy for each part of the other side."""
    known = df.join(crowded, list(keys), "left")
    mine = F.pmod(F.xxhash64(*spread), F.coalesce(own, F.lit(1))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
    part = known.withColumn(f"{own}_part", mine).withColumn(f"{other}_part", others)
    return part.drop("_left", "_right")


def many_to_many(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    rows: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """`left` ⋈ `right` on `keys`; no task forms more than PAIRS_PER_TASK pairs of one key.

    The spread columns tell the rows of a key apart. Where the sides are costly to compute just to
    be counted, `rows` has a table (keys, rows) for each: rows of a key, which are added up.
    """
    crowded = crowded_keys(left, right, keys, rows=rows)
    if crowded.isEmpty():
        return left.join(right, list(keys))
    a = _dealt(left, crowded, keys, left_spread, "_left", "_right")
    b = _dealt(right, crowded, keys, right_spread, "_right", "_left")
    parts = ["_left_part", "_right_part"]
    return a.join(b, [*keys, *parts]).drop(*parts)
