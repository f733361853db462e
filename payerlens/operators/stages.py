"""Settling intermediate results in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where none is named, a folder of this machine serves only a session whose
    driver and executors are one process (master local); on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_FOLDER
    raise ValueError("name a folder that all executors share in spark.checkpoint.dir")


def application_folder(spark: SparkSession) -> str:
    """The application's own part of the folder, which goes when the application ends."""
    context = spark.sparkContext
    folder = f"{checkpoint_folder(spark)}/payerlens-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def new_stage(spark: SparkSession) -> str:
    """A fresh path in the application's folder."""
    return f"{application_folder(spark)}/stage-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written table.

    Used where a result feeds several later steps: without it every step would
    repeat the work and the plan would grow with each of them. The table outlives
    lost executors. Runs a job when called.
    """
    path = new_stage(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
