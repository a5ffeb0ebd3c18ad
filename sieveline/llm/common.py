"""Shared plumbing: table access, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..shared import cut, drop_cut, drop_path, shared_dir, shared_path

__all__ = ["cut", "drop_cut", "drop_path", "shared_dir", "shared_path", "ship_package", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, read through Spark's own readers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
