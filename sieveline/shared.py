"""Tables in the cluster's shared folder: lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship_package


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set on a local master;
    on a cluster that would be one machine's own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sieveline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sieveline/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a shared table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a shared parquet table and read it back.

    Cuts the lineage, and a lost executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveline_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind a frame made by :func:`cut`."""
    path = getattr(df, "_sieveline_path", None)
    if path:
        drop_path(df.sparkSession, path)
