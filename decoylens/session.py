"""Session settings shared by the jobs, the tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a running session accepts. AQE coalesces small shuffle partitions and splits skewed
# join partitions; the partial group limit keeps first-N windows small before their shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: str | None = None


def build_session(app: str = "decoylens", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench. A cluster passes its own session instead."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")  # halves the fixed cost of a job with Python workers
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "decoylens-warehouse"))
    )
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC above all) to a given session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    On one machine, where driver and executors are one process, a temporary folder takes its place if
    ``spark.checkpoint.dir`` is unset; it is removed when the process ends. On a cluster that is an error, as
    executors would write to disks of their own.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not shared:
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="decoylens-")
            atexit.register(shutil.rmtree, _local_scratch, True)
        shared = _local_scratch
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: what depends on it sees one and the same version."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
