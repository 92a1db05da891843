"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The parquet table `name` under `sf_dir` (one file or a folder of part files).

    With `spread`, for work that is heavy per row, a table whose files give fewer splits than there are cores is dealt
    out evenly; larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
