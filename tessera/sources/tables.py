"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost far more to work on than to read.
TEXTS = ("documents",)


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: rows of a scan of fewer pieces than cores are dealt out, other scans stay as they are.

    A file is read by as many tasks as it has row groups, so a small table of one
    file would be worked on by one core. A table of many files is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table; with columns named, only those reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXTS and "text" in df.columns else df
