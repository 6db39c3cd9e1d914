"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where the next step then shuffles again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.ui.enabled": "false",
    # No call-site capture per column expression: plans are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Small test data would otherwise be coalesced into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and benchmarks.

    On a cluster take the session it gives; there ``spark.checkpoint.dir`` must name a
    folder that all executors share.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("limitline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="limitline-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
