"""Snapshots of source documents: (namespace, key, cached_at, payload)."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from standcarbon.session import discard, path_exists, staged
from standcarbon.sources.layers import dedupe_latest

LAYER_MAX_AGE = timedelta(hours=24)
DETAIL_MAX_AGE = timedelta(days=30)


def fresh_snapshots(df: DataFrame, as_of: Column, max_age: timedelta) -> DataFrame:
    """Latest entry per (namespace, key), if it is not older than `max_age`.

    An old entry never outlives a newer one, so stale rows can be dropped first, in the scan.
    """
    fresh = df.filter(F.col("cached_at") >= as_of - F.lit(max_age))
    return dedupe_latest(fresh, ["namespace", "key"], ["cached_at", "payload"])


def write_snapshot(df: DataFrame, path: str) -> None:
    """Append entries; the latest per key counts when read."""
    df.write.partitionBy("namespace").mode("append").parquet(path)


def clear_snapshots(df: DataFrame, path: str) -> None:
    """Empty the store, keeping its schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


# Parts that the keys of a namespace are dealt to in a store that replaces.
BUCKETS = 64
_BUCKET = "bucket"


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of a store written by `replace_snapshots`, one per key."""
    return spark.read.schema(_stored(schema)).parquet(path).select(*schema.names)


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(_BUCKET, IntegerType())])


def replace_snapshots(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Puts entries into a store that keeps the latest per key; what is older goes.

    The store is partitioned by namespace and a hash of the key. Only partitions that the entries
    touch are read and written again, each as one file, so the number of files is bounded by
    namespaces times buckets however often the store is written. New files replace old ones at the
    end of the write; one that fails leaves the store as it was. `buckets` may not change.
    """
    spark, schema = df.sparkSession, df.schema
    bucket = F.pmod(F.xxhash64("namespace", "key"), F.lit(buckets)).cast("int")
    new = staged(df.withColumn(_BUCKET, bucket))
    united = new
    if path_exists(spark, path):
        touched = new.select(F.col("namespace").alias("_n"), F.col(_BUCKET).alias("_b")).distinct()
        old = spark.read.schema(_stored(schema)).parquet(path)
        # Namespaces times buckets at most; its keys prune the partitions that are read.
        met = (old["namespace"].eqNullSafe(F.col("_n"))) & (old[_BUCKET] == F.col("_b"))
        united = old.join(F.broadcast(touched), met, "left_semi").unionByName(new)
    # Staged, as the files that it is read from are about to be replaced.
    kept = staged(dedupe_latest(united, ["namespace", "key"], ["cached_at", "payload"]))
    files = kept.repartition("namespace", _BUCKET).write.mode("overwrite")
    files = files.option("partitionOverwriteMode", "dynamic")
    files.partitionBy("namespace", _BUCKET).parquet(path)
    discard(new)
    discard(kept)


def clear_store(spark: SparkSession, path: str, schema: StructType) -> None:
    """Empties the store."""
    nothing = spark.createDataFrame([], _stored(schema))
    nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
