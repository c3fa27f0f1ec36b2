"""Session settings the package is written for, and the package for executors."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Give this package to Python workers that do not have it installed, once per application."""
    context = spark.sparkContext
    if getattr(context, "_routelens_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="routelens-"), "routelens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._routelens_shipped = True


def build_session(app_name: str = "routelens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution, runtime skew handling and UTC display.

    AQE merges small shuffle partitions up to ``advisoryPartitionSizeInBytes`` and splits skewed joins, but
    it does not split ordinary shuffles: set ``spark.sql.shuffle.partitions`` (``partitions_for`` gives a
    number) so that a partition fits in memory before merging.  Keyword names use ``__`` for dots, so
    ``spark__driver__memory="8g"`` sets ``spark.driver.memory``.  Python workers get this package.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def partitions_for(input_bytes: int, per_partition: int = 256 * 1024 * 1024) -> int:
    """Shuffle partitions for jobs over that much input, at least Spark's own 200."""
    return max(200, -(-input_bytes // per_partition))
