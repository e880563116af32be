"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A scan of fewer bytes than this is not worth a shuffle to spread it.
SPREAD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one test table; Catalyst prunes its columns and pushes its filters."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """The scan over all cores where its files give fewer tasks than there are cores, such as one file of one row group.

    A table of many files or row groups is returned as it is, however large.
    Projections and filters are still pushed below the exchange.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
