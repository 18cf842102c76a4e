"""Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEW_SPLITS = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet``; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use more cores on a scan of few splits. Only for plain scans: asking a
    plan with shuffles for its partitions would run it.

    A scan of fewer than ``FEW_SPLITS`` splits is a few gigabytes at most, so
    moving it once is cheap; any larger scan is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(min(cores, 4 * FEW_SPLITS)) if splits < min(cores, FEW_SPLITS) else df
