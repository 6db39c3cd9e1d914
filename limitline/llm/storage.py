"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing (single-machine tests) a temporary folder is chosen
    once and kept in the session; a cluster has to name one.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("limitline.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="limitline-llm-")
        spark.conf.set("limitline.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    path = f"{shared_folder(spark)}/limitline-{name}-{uuid.uuid4().hex}"
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written as Parquet and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
