"""Exact global ranks without sorting everything in one task: quantiles and row numbers.

Rows are dealt to tasks by ranges of the key; each part is ranked on its own and shifted by the
sizes of the parts before it. The parts are staged, so counting and ranking see the same ones.
"""

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from standcarbon.session import discard, staged


def _ranked(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """`df` with `_upto`: the running sum of `weight` in ascending order of `key`."""
    parted = staged(
        df.withColumn("_weight", weight)
        .repartitionByRange(F.col(key).asc())
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, that is per task.
    offsets = (
        parted.groupBy("_part")
        .agg(F.sum("_weight").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_part").orderBy(key)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parted.withColumn("_within", F.sum("_weight").over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn("_upto", F.col("_within") + F.col("_offset"))
        .drop("_part", "_within", "_offset", "_weight")
    )


# Rank error of the sketch, as a share of the rows.
SKETCH_ERROR = 1e-4


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row q1, q2, …: linearly interpolated quantiles of the finite values; NULL if none.

    A sketch of the ranks brackets each quantile, one pass counts what is below the brackets, and
    only the values inside them, a few ten-thousandths, are counted by value and ranked. A bracket
    that the counts show to miss its ranks is opened to all values on that side.
    """
    value = F.col("_v")
    values = df.select(F.col(column).cast("double").alias("_v")).filter(F.abs(value) < float("inf"))
    # Three passes read the values; a staged table is scanned for the one column.
    values = values if hasattr(df, "_staged") else staged(values)
    shares = [min(1.0, max(0.0, p + e)) for p in probabilities for e in (-2 * SKETCH_ERROR, 2 * SKETCH_ERROR)]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, shares)), round(1 / SKETCH_ERROR))
    n, ends = values.agg(F.count(F.lit(1)), sketch).first()
    if not n:
        discard(values)
        nothing = [F.lit(None).cast("double").alias(f"q{i}") for i in range(1, len(probabilities) + 1)]
        return df.sparkSession.range(1).select(*nothing)
    positions = [p * (n - 1) for p in probabilities]
    lows = [floor(position) for position in positions]
    brackets = list(zip(ends[::2], ends[1::2], strict=True))
    inside, counts = _count_brackets(values, brackets)
    missed = [(c["below"] > low, c["upto"] <= min(low + 1, n - 1)) for c, low in zip(counts, lows, strict=True)]
    if any(map(any, missed)):
        brackets = [
            (float("-inf") if too_high else start, float("inf") if too_low else end)
            for (start, end), (too_high, too_low) in zip(brackets, missed, strict=True)
        ]
        inside, counts = _count_brackets(values, brackets)
    counted = values.filter(inside).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    running = _ranked(counted, "_v", F.col("_n"))
    discard(values)

    quantiles = []
    for i, (position, low, (start, _), c) in enumerate(zip(positions, lows, brackets, counts, strict=True), 1):

        def at(rank: int, start=start, c=c) -> Column:
            # Ranks among all values: those below the bracket, and those of it.
            passed = F.col("_upto") - c["between"] + c["below"] > rank
            return F.min(F.when((value >= start) & passed, value))

        lower, upper = at(low), at(min(low + 1, n - 1))
        # From the nearer end, so that a whole position gives that value itself.
        part, step = position - low, upper - lower
        nearer = lower + step * part if part < 0.5 else upper - step * (1 - part)
        quantiles.append(nearer.alias(f"q{i}"))
    return running.agg(*quantiles)


def _count_brackets(values: DataFrame, brackets: list[tuple[float, float]]) -> tuple[Column, list[Row]]:
    """Whether a value is in any bracket, and for each bracket how many values are `below` it, `upto`
    its end, and below it but `between` others' ends."""
    value = F.col("_v")
    inside = reduce(lambda a, b: a | b, [value.between(start, end) for start, end in brackets])
    counts = [
        F.struct(
            F.count_if(value < start).alias("below"),
            F.count_if(value <= end).alias("upto"),
            F.count_if(inside & (value < start)).alias("between"),
        )
        for start, end in brackets
    ]
    return inside, list(values.agg(*counts).first())


def row_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers rows 1..n in the order of a unique `key`."""
    return _ranked(df, key, F.lit(1)).withColumnRenamed("_upto", name)
