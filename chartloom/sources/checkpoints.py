"""Cutting lineage at stage boundaries, in storage that outlives an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder
    that goes with the process; a cluster session uses the warehouse, which its executors share."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"
    if "path" not in _own:
        _own["path"] = tempfile.mkdtemp(prefix="chartloom-")
        atexit.register(shutil.rmtree, _own["path"], ignore_errors=True)
    return "file://" + _own["path"]


def materialise(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder as parquet and read it again: later branches prune columns."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
