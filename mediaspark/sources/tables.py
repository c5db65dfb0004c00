"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a small input over the cores.

    A file with one row group is read by one task whatever its size.  When the
    scan has fewer splits than twice the cores, the input is small (at most
    that many splits) and one shuffle of it is cheap; a large table has more
    splits than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def read_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    return spread(spark.read.parquet(path), *keys)
