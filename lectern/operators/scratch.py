"""Intermediate results that outlive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Sees to it that the context has a checkpoint folder: the one that the cluster names; without one, a folder of this machine if all of Spark runs in this process, else an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        place = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(place)


def new_folder(spark: SparkSession) -> str:
    """A new folder that all of Spark shares; it goes when the driver ends."""
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the checkpoint folder from then on; Spark drops them with the last reference."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder as Parquet, which is smaller than a checkpoint and read by column."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
