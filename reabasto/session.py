"""Session settings the jobs rely on."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What a task reads of a shuffle. Sorted lines and counts by group take ten to twenty times
    # that in memory: Spark's 64 MB were up to 773 MB a task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session made elsewhere, as on a cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def configured(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, with the settings applied to whatever session it is given."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder)

    return run


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "reabasto"
) -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("REABASTO_DRIVER_MEMORY", "8g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
