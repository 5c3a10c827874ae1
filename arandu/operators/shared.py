"""Tables that a session keeps in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Where a local run's tables go if spark.checkpoint.dir is unset.
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; it is deleted when the driver ends."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {spark.sparkContext.master})")
        where = LOCAL_DIR
    folder = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
