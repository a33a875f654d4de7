"""Session settings and the shared folder for intermediate tables."""

import functools
import gc
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings the library is designed for.  Adaptive execution coalesces small partitions and splits skewed ones, but
#: never raises the number it starts from, so that number is high.  Per-session sets are small: aggregates over
#: them stay hashed for more groups than the default before they fall back to sorting.
SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "clicktrail", **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **extra}
    if "spark.sql.shuffle.partitions" in extra:  # whoever names a number of partitions means it
        settings.pop("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


@functools.cache
def _ship(application: str) -> None:
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="clicktrail-zip-")
    archive = shutil.make_archive(f"{folder}/clicktrail", "zip", os.path.dirname(package), os.path.basename(package))
    SparkContext.getOrCreate().addPyFile(archive)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; Spark serves the archive to them itself."""
    _ship(spark.sparkContext.applicationId)


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="clicktrail-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a session in one process (``local[...]``, as in tests) may go without; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_by_context.get() if set_by_context.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _test_folder()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a Parquet table to the shared folder and go on from there.

    Lost executors then cost no recomputation, and readers of the table still
    prune columns and push filters down.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Remove shuffle files that no table needs any more: Spark does when the driver collects its garbage, which a driver with room seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
