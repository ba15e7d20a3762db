"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, app: str = "chartloom") -> SparkSession:
    """A session with adaptive execution on and UTC time.

    On a cluster leave every argument unset: master, memory and the initial partition number
    come from spark-submit, and adaptive execution coalesces or splits what it finds.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # windows-1252 note exports: the JVM charset list is needed to decode them
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false" if (master or "").startswith("local") else "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()
