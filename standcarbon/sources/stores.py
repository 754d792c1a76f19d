"""Stores that are read in part: details by stand, layers by place.

Details lie in partitions by a hash of the stand, and a run opens only those that its stands are
in. A layer's rows lie along a space-filling curve, so a file covers a small region; the boxes of
the files are a table of their own, and a run opens only the files whose box it meets.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from standcarbon.functions.geometry import BOUNDS, pad_bounds
from standcarbon.operators.grid import BASE_CELL, LEVEL_FACTOR, box_join

# Partitions of a detail store: more of them prune finer and make smaller files.
DETAIL_BUCKETS = 256
_BUCKET = "_bucket"

# Rows of a file of a layer store.
FILE_ROWS = 500_000
_CURVE_BITS = 31
_FILE = "_file"


# --- details by stand ---


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_details(
    details: DataFrame, path: str, buckets: int = DETAIL_BUCKETS, key: str = "stand_id"
) -> None:
    """Rows by hash of `key`, a file or a few per part; rows without key are rows of one part.

    The parts are rebalanced, not hashed to tasks, so a part that holds a third of all rows is
    written by several. `buckets` is needed again when reading.
    """
    parted = details.withColumn(_BUCKET, _bucket(key, buckets)).hint("rebalance", _BUCKET)
    # Sorted inside, so the statistics of a row group leave out most other stands.
    parted.sortWithinPartitions(_BUCKET, key).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)


def details_of(
    spark: SparkSession,
    path: str,
    schema: StructType,
    wanted: DataFrame,
    buckets: int = DETAIL_BUCKETS,
    key: str = "stand_id",
) -> DataFrame:
    """The rows stored, as `schema`, whose `key` is in `wanted`; only the parts that `wanted` touches are read.

    `wanted` is read twice, so give a staged table. The parts that it touches are at most
    `buckets` numbers, which is what is broadcast; the keys themselves meet in a shuffled join.
    Null keys are wanted by nobody. No row in `wanted` gives no row.
    """
    keys = wanted.select(key).dropna().distinct()
    # The condition holds for every part; without one the optimizer does not expect the join to
    # be worth a pruning filter.
    touched = keys.select(_bucket(key, buckets).alias(_BUCKET)).filter(F.col(_BUCKET) >= 0).distinct()
    parted = StructType([*schema.fields, StructField(_BUCKET, IntegerType())])
    stored = spark.read.schema(parted).parquet(path)
    near = stored.join(F.broadcast(touched), _BUCKET, "left_semi")
    return near.join(keys, key, "left_semi").select(*schema.names)


# --- layers by place ---


def _spread(value: Column) -> Column:
    """The bits of a number below 2 ** 31 at the even places of a long."""
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
        value = F.shiftleft(value, shift).bitwiseOR(value).bitwiseAND(F.lit(mask))
    return value


def curve_place(x: Column, y: Column, low: tuple[float, float], size: float) -> Column:
    """Place on the Z-curve over the square at `low` with sides of `size`; NULL off any place."""

    def cell(value: Column, start: float) -> Column:
        share = (value - start) / size if size > 0 else F.lit(0.0)
        top = (1 << _CURVE_BITS) - 1
        return F.least(F.greatest(F.floor(share * top), F.lit(0)), F.lit(top)).cast("long")

    place = _spread(cell(x, low[0])).bitwiseOR(F.shiftleft(_spread(cell(y, low[1])), 1))
    return F.when((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), place)


def _places(df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [F.abs(F.col(b)) < float("inf") for b in BOUNDS])


def write_layer(
    df: DataFrame, path: str, key: str, file_rows: int = FILE_ROWS, base_cell: float = BASE_CELL
) -> None:
    """A layer with bounds in files of about `file_rows` rows that lie near each other.

    Rows are dealt to tasks by ranges of (size class, place on the curve, hash of `key`): large
    boxes have files of their own, so they do not widen those of the small ones, and many rows on
    one place are still split. Rows without finite bounds are kept, in files that no region meets.
    """
    spark, known = df.sparkSession, _places(df)
    ends = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.when(known, F.col(b))).alias(b) for b in BOUNDS[:2]],
        *[F.max(F.when(known, F.col(b))).alias(b) for b in BOUNDS[2:]],
    ).first()
    low = (ends["minx"] or 0.0, ends["miny"] or 0.0)
    size = max((ends["maxx"] or 0.0) - low[0], (ends["maxy"] or 0.0) - low[1])
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) / base_cell
    level = F.when(known & (side > 1), F.ceil(F.log(side) / F.log(F.lit(LEVEL_FACTOR)))).when(known, 0)
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    order = [level, F.when(known, curve_place(x, y, low, size)), F.xxhash64(F.col(key))]
    files = max(1, -(-ends["n"] // file_rows))
    dealt = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{path}/rows")
    finite = [F.when(_places(stored), F.col(b)) for b in BOUNDS]
    boxes = stored.groupBy(F.col("_metadata.file_name").alias(_FILE)).agg(
        *[F.min(c).alias(b) for c, b in zip(finite[:2], BOUNDS[:2], strict=True)],
        *[F.max(c).alias(b) for c, b in zip(finite[2:], BOUNDS[2:], strict=True)],
        F.count(F.lit(1)).alias("rows"),
    )
    # One row per file.
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")


def _open(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The rows of these files; their names are no more than Spark lists for any scan of them."""
    names = sorted(row[_FILE] for row in files.select(_FILE).distinct().collect())
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{name}" for name in names])


def _meets(region: Sequence[float]) -> Column:
    west, south, east, north = (F.lit(float(v)) for v in region)
    return (
        (F.col("minx") <= east) & (F.col("maxx") >= west)
        & (F.col("miny") <= north) & (F.col("maxy") >= south)
    )


def read_region(spark: SparkSession, path: str, region: Sequence[float]) -> DataFrame:
    """The rows of a layer store whose box meets (minx, miny, maxx, maxy), borders included.

    Rows without finite bounds meet no region.
    """
    files = spark.read.parquet(f"{path}/boxes").filter(_meets(region))
    rows = _open(spark, path, files)
    return rows.filter(_places(rows) & _meets(region))


def read_near(
    spark: SparkSession, path: str, boxes: DataFrame, key: str, pad: float = 0.0
) -> DataFrame:
    """The rows of the files that some padded box of `boxes` meets: all rows near a box, and others
    that a join has to tell apart."""
    stored = spark.read.parquet(f"{path}/boxes").select(_FILE, *BOUNDS)
    near = pad_bounds(boxes.select(key, *BOUNDS), pad)
    met = box_join(near, stored, key, _FILE, touching=True)
    return _open(spark, path, met.select(F.col(f"r_{_FILE}").alias(_FILE)))
