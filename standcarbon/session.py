"""Session settings and lineage cuts."""

import os
import tempfile
import zipfile
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; none of them fixes a cluster size."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split skewed join partitions even where that costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # The JVM does not compile methods over 8000 bytes; Spark then splits them instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # A batch that goes to Python ends at either bound, so long rows cannot pile up.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
        # A task that ranks or sums its rows before a shuffle holds them: Parquet rows unfold to ten
        # times the bytes and more, and a part of a file grows with it up to this bound.
        "spark.sql.files.maxPartitionBytes": str(16 << 20),
        # Filters reach the source of feature pages.
        "spark.sql.python.filterPushdown.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


@cache
def _archive() -> str:
    """This package as an archive that Python workers can import from."""
    package = Path(__file__).resolve().parent
    path = os.path.realpath(Path(tempfile.mkdtemp(prefix="standcarbon-")) / "standcarbon.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    return path


def _ship(spark: SparkSession) -> None:
    """Gives the workers this package, wherever the driver was started from."""
    context = spark.sparkContext
    if not getattr(context, "_standcarbon", False):
        context.addPyFile(_archive())
        context._standcarbon = True


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="standcarbon-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session inside one process gets a temporary one; on a cluster that
    would be a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, store = _hadoop_path(spark, path)
    return store.exists(target)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_folder(spark)}/standcarbon-{label}-{uuid4()}"
    target, store = _hadoop_path(spark, path)
    store.deleteOnExit(target)
    return path


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back from there.

    Cuts the lineage, survives the loss of executors, and later readers scan only the columns
    they use. The files go when the application ends, or with `discard`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "staged")
    df.write.option("compression", codec).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged = path
    return read


def staged_together(*dfs: DataFrame) -> list[DataFrame]:
    """Each table staged, all at the same time; what is staged already stays as it is.

    Small inputs are read by a task or two each, so one after the other they leave most cores idle.
    """
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(lambda df: df if hasattr(df, "_staged") else staged(df), dfs))


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    path = getattr(df, "_staged", None)
    if path:
        discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Deletes what is at `path`, if anything."""
    target, store = _hadoop_path(spark, path)
    store.delete(target, True)
