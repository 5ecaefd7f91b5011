"""Session settings: tasks in place of threads, and where intermediate tables go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def set_parallel(spark: SparkSession, tasks: int | None = None) -> int:
    """Sets the number of shuffle partitions; by default 80 % of the cores, at least one. The executors' own slots stay as configured."""
    tasks = tasks or max(1, round((os.cpu_count() or 1) * 0.8))
    if tasks < 1:
        raise ValueError("at least one task is needed")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    return tasks


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is unset, a local session takes a temporary folder and a cluster gets an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="strandlab-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
