"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "leadloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    Adaptive execution sizes shuffles and splits skewed joins at run time;
    the partition count below is only its starting point.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leadloom-"))
    return context.getCheckpointDir()


def new_work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return os.path.join(shared_folder(spark), "leadloom", f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that keeps fewer tasks than cores busy over all of them.

    What is done per row is bound by the processor, and one row group is one
    task however many splits its file has; so the splits with rows are counted,
    which reads no more than the files' footers.  A scan with enough of them is
    left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(max(cores, splits))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage at a stage edge: what reads the table several times does
    not compute it again, and a lost executor costs only its own tasks.
    """
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def child_numbers(spark: SparkSession, folder: str, finished: bool) -> list[int]:
    """Numbers n of the folders `<name>=<n>` in a folder; with `finished`, of those that Spark has written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    children = [status.getPath() for status in files.listStatus(path) if "=" in status.getPath().getName()]
    done = [c for c in children if not finished or files.exists(spark._jvm.org.apache.hadoop.fs.Path(c, "_SUCCESS"))]
    return [int(c.getName().rsplit("=", 1)[1]) for c in done]


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
